"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds).cast("long"))


def bind(value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and hands it to the lambda ``body``.

    Without it the optimiser copies ``value`` into the body, where it would be evaluated for
    every element.
    """
    return f"transform(array({value}), {body})[0]"


def running_starts(lengths: str) -> str:
    """SQL array with the sum of all elements of ``lengths`` before each one; two-level, so its
    cost stays near-linear for long arrays."""
    block = 256
    def total(x: str) -> str:
        return f"aggregate({x}, 0L, (a, v) -> a + v)"
    before = bind(
        f"transform(sequence(0, (size(l) - 1) div {block}), b -> {total(f'slice(l, b * {block} + 1, {block})')})",
        f"t -> transform(sequence(0, size(t) - 1), b -> {total('slice(t, 1, b)')})")
    at = bind(before, f"o -> transform(sequence(0, size(l) - 1), i -> o[i div {block}] + "
                      f"{total(f'slice(l, (i div {block}) * {block} + 1, i % {block})')})")
    return bind(lengths, f"l -> if(size(l) = 0, cast(array() as array<bigint>), {at})")


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``; nodes without an edge are
    not listed.

    Alternating large-star and small-star steps: every step turns the links of a node into links
    to its smallest neighbour, so the number of links never grows and no node's links are ever
    gathered into one row. Each step is a stage table; ``rounds`` is a guard that raises.
    """
    now = materialise(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                      .where("u <> v").distinct())
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u"), F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        after = materialise(small)
        if now.exceptAll(after).isEmpty() and after.exceptAll(now).isEmpty():
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def small_batches(spark, rows: int = 500) -> None:
    """Let at most ``rows`` rows reach Python at once, so that very long texts fit in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def add_by_text(docs: DataFrame, key: str, text: str, work, columns: str) -> DataFrame:
    """(key, *columns) for every row: ``work`` takes a list of texts and gives a list per column.

    The key column passes through as it is, nulls and large numbers included. ``columns`` is DDL.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = work(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in got]], names=names)

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    names = [key, *[c.split()[0] for c in columns.split(",")]]
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {columns}")
