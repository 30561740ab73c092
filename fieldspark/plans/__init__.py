"""End-to-end jobs, and the operators bound to the given tables."""

from fieldspark.plans import (q_aggregates, q_jobs, q_joins, q_resample, q_scans,  # noqa: F401
                              q_series, q_stats, q_text)
from fieldspark.plans.registry import ORACLE, QUERIES  # noqa: F401
