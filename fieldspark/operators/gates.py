"""Fail-fast checks. A gate is one aggregate row of violation counts; ``require`` raises on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.lineage import derived_from
from fieldspark.operators.ordered import null_safe_join


class GateError(ValueError):
    """A quality gate found violations."""


def require(gate: DataFrame) -> dict:
    """Raise unless every count in the gate's single row is zero; returns the counts."""
    row = gate.first().asDict()
    bad = {k: v for k, v in row.items() if isinstance(v, (int, bool)) and v}
    if bad:
        raise GateError(", ".join(f"{k}={v}" for k, v in sorted(bad.items())))
    return row


def column_gate(df: DataFrame, expected: Sequence[str]) -> None:
    """Exact ordered columns; names what is missing and what is extra."""
    if list(df.columns) != list(expected):
        missing = sorted(set(expected) - set(df.columns))
        extra = sorted(set(df.columns) - set(expected))
        raise GateError(f"wrong columns: without {missing}, with {extra} too many, or out of order")


def schema_gate(df: DataFrame, key: str, solid: Sequence[str], category: str,
                allowed: Sequence[str], fractions: Sequence[str], value: str,
                bands: Mapping[str, tuple[float, float]], rows: int | None = None,
                key_range: tuple[int, int] | None = None) -> DataFrame:
    """Row count, unique keys in range, no null or infinity, allowed categories, fractions in
    0..1 and values inside their class band: all counts from two aggregates."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def bad_number(c: str) -> Column:
        x = F.col(c)
        return x.isNull() | ((F.isnan(x) | (F.abs(x) == float("inf"))) if c in numeric else F.lit(False))

    cat = F.col(category)
    lo = F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), F.lit(float(b[0])))])
    hi = F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), F.lit(float(b[1])))])
    v = F.col(value)
    inside = v.between(F.element_at(lo, cat), F.element_at(hi, cat))
    unsound = F.lit(False)
    for c in solid:
        unsound = unsound | bad_number(c)
    off = F.lit(False)
    for c in fractions:
        off = off | (F.col(c).isNotNull() & ~F.col(c).between(0, 1))
    outside_key = F.lit(False) if key_range is None else ~F.col(key).between(*key_range)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(unsound).alias("unsound_rows"),
        F.count_if(~cat.isin(*allowed)).alias("category_outside"),
        F.count_if(off).alias("fraction_outside"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("value_outside_band"),
        F.count_if(outside_key).alias("key_outside"))
    distinct = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.count_if(F.col("_c") > 1).alias("duplicate_keys"))
    out = null_safe_join(counts, distinct, [])
    wrong = F.lit(0) if rows is None else F.abs(F.col("_n") - rows)
    return out.withColumn("row_count_off", wrong.cast("long")).drop("_n")


def null_pattern_gate(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Nullable columns must be null exactly where the flag is false."""
    return df.agg(*[F.count_if(F.col(c).isNull() == F.col(flag)).alias(f"{c}_pattern") for c in columns])


def reconcile_gate(plots: DataFrame, rollup: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The rollup must equal the plot sums, class by class and overall."""
    sums = plots.withColumn("cls", F.explode(F.array(F.col("cls"), F.lit("ALL")))).groupBy("cls").agg(
        F.sum("production").alias("_p"), F.sum("weight").alias("_w"))
    j = sums.join(rollup.select("cls", "production", "weight"), "cls", "full")

    def off(a: str, b: str) -> Column:
        d = F.abs(F.col(a) - F.col(b))
        return F.count_if(F.coalesce(d > tolerance, F.lit(True)))

    return j.agg(off("production", "_p").alias("production_off"), off("weight", "_w").alias("weight_off"),
                 F.count(F.lit(1)).alias("_rows")).drop("_rows")


def plausible_gate(df: DataFrame, bands: Mapping[str, tuple[float, float]], value: str = "value",
                   cls: str = "cls") -> DataFrame:
    """Rows per class outside the class band; such rows fail the job, they are never clipped."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
                     for k, (a, b) in bands.items()])
    band = F.filter(rows, lambda s: s["k"] == F.col(cls))[0]
    out = ~F.coalesce(F.col(value).between(band["lo"], band["hi"]), F.lit(False))
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("n_outside"))


def complete_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def date_gate(meta: DataFrame, instant: str, declared: str) -> DataFrame:
    """The acquisition instant must fall on the declared date (``yyyyMMdd``)."""
    off = F.date_format(instant, "yyyyMMdd") != F.col(declared)
    return meta.agg(F.count_if(off).alias("date_mismatch"))


def grid_gate(cells: DataFrame) -> DataFrame:
    """Every pass must cover the same rows and columns."""
    ends = cells.groupBy("pass").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("r", "c") for f, n in ((F.min, "min"), (F.max, "max"))])
    return ends.agg((F.count_distinct("min_r", "max_r", "min_c", "max_c") - 1).alias("extra_extents"))


def reserved_gate(df: DataFrame, reserved: Sequence[str], consumer: str,
                  allowed: Sequence[str]) -> DataFrame:
    """How many values of each reserved column, renamed or computed ones too, a consumer can see.

    An allowed consumer gives zero; any other consumer must not have anything of the columns.
    """
    if consumer in allowed:
        return df.agg(*[F.lit(0).cast("long").alias(f"{c}_exposed") for c in reserved])
    held = derived_from(df, reserved)
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.agg(*[sum((F.count(F.col(f"_{i}")) for i in held[c]), F.lit(0).cast("long")).alias(f"{c}_exposed")
                          for c in reserved])


def stage_gates(*gates: DataFrame) -> DataFrame:
    """(gate, item, passed) rows of several checks, with the combined verdict on each."""
    rows = gates[0]
    for g in gates[1:]:
        rows = rows.unionByName(g)
    verdict = rows.agg(F.bool_and("passed").alias("all_passed"))
    return null_safe_join(rows, verdict, [])
