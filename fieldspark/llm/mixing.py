"""Mixing sources to target weights by iterative proportional fitting, in column functions only.

Token counts per cell (source, language, topic) are raked to target marginals: each pass scales the
cells so that one dimension meets its targets, then the next, until all agree. A document is then
kept with the probability that its cell's calibrated weight asks for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

PASSES = 6          # raking passes; the SQL twin runs as many
POWER = 0.7         # a category's target is its share to this power, renormalised
KEEP = 0.5          # tokens kept, as a share of all


def tokens(text: Column) -> Column:
    """Words between single spaces, which is what is weighed; none in a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of text: licence notes, tables, symbol noise, short or long prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("icense"), "licence").when(t.contains(" | "), "table")
            .when(t.contains("***") | t.contains("###") | t.contains("&&&"), "noise")
            .when(F.length(t) < 1000, "short").otherwise("long"))


def chance(doc_id: Column) -> Column:
    """Uniform number in [0, 1) from the id's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(cells: DataFrame, dims: Sequence[str], power: float = POWER) -> dict[str, DataFrame]:
    """Default targets per dimension: token shares to ``power``, renormalised to one."""
    out = {}
    for d in dims:
        share = cells.groupBy(d).agg(F.sum("base").alias("_t")).withColumn("_t", F.pow(F.col("_t").cast("double"), F.lit(power)))
        whole = share.agg(F.sum("_t").alias("_all"))
        out[d] = null_safe_join(share, whole, []).select(d, (F.col("_t") / F.col("_all")).alias("target"))
    return out


def rake(cells: DataFrame, dims: Sequence[str], goals: Mapping[str, DataFrame], total: float,
         passes: int = PASSES) -> DataFrame:
    """``cells`` (dims, base) with ``weight``: base scaled by factors per category so that every
    dimension's sums are its target share of ``total``, no cell giving more than it has.

    Each category's sum is pre-aggregated before it moves and joined back as a small table; every
    pass is a stage table, so the plan does not grow. What a full cell cannot give is asked of the
    others by the next pass. Categories without a target keep their share; cells of no tokens stay
    at zero.
    """
    now = cells.withColumn("weight", F.col("base").cast("double"))
    goals = {d: materialise(g) for d, g in goals.items()}
    for _ in range(passes):
        for d in dims:
            sums = null_safe_join(now.groupBy(d).agg(F.sum("weight").alias("_w")), goals[d], [d], "left")
            factor = sums.select(d, F.when(F.col("_w") > 0, F.col("target") * total / F.col("_w")).alias("_f"))
            now = null_safe_join(now, factor, [d], "left").withColumn("weight", F.least(
                F.col("weight") * F.coalesce("_f", F.lit(1.0)), F.col("base").cast("double"))).drop("_f")
        now = materialise(now)
    return now


def mix(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id",
        keep: float = KEEP, power: float = POWER, goals: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every row of ``docs`` in columns (row, tokens, topic, weight, p, kept): ``row`` holds the
    whole input row, ``weight`` the calibrated number of tokens its cell should give.

    A null source or language is a category of its own; a null text has no tokens and is kept.
    The draw depends on ``key`` alone, so equal ids share it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", tokens(F.col(f"row.`{text}`")).alias("tokens"), F.col(f"row.`{source}`").alias("source"),
                       F.col(f"row.`{lang}`").alias("lang"), topic(F.col(f"row.`{text}`")).alias("topic"))
    dims = ["source", "lang", "topic"]
    cells = materialise(rows.groupBy(*dims).agg(F.sum("tokens").alias("base")))
    whole = cells.agg(F.sum("base")).first()[0] or 0
    goals = goals or targets(cells, dims, power)
    solved = rake(cells, dims, goals, float(whole) * keep).withColumn(
        "p", F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(1.0))
    out = null_safe_join(rows, solved.select(*dims, "weight", "p"), dims, "left")
    return out.select("row", "tokens", "topic", "weight", "p",
                      (chance(F.col(f"row.`{key}`")) < F.col("p")).alias("kept"))
