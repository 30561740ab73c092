"""Plots that lack passes, in every combination: the queries still equal their SQL."""

from __future__ import annotations

import shutil
from pathlib import Path

import duckdb
import pytest
from check import TABLES, database, differences

FOLDER = "/root/testdata/sf0.01"
KEYS = ("line_anomaly", "cleared_fraction", "season_close", "horizon_curve", "forecast_scores", "rule_fires_split",
        "predictors", "best_by_group", "peak", "episode_sweep", "bootstrap_skill", "job_forecast", "job_backtest")


@pytest.fixture(scope="module")
def holed(tmp_path_factory):
    """The events without pass p of every plot whose number has bit p; some plots have none at all."""
    out = tmp_path_factory.mktemp("holed")
    for t in TABLES:
        if t != "events":
            shutil.copyfile(Path(FOLDER) / f"{t}.parquet", out / f"{t}.parquet")
    duckdb.execute(f"""COPY (SELECT * FROM '{FOLDER}/events.parquet' WHERE ((user_id % 64) >> ((day(ts) - 1) // 5)::INTEGER) & 1 = 0)
TO '{out}/events.parquet'""")
    return str(out)


@pytest.mark.parametrize("key", KEYS)
def test_missing_passes(key, spark, holed):
    assert differences(key, spark, database(holed), holed) == []
