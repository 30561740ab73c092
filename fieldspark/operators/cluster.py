"""Clustering runs, their consensus, cluster rules and margins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldspark.operators.kmeans import kmeans_grid
from fieldspark.operators.ordered import null_safe_join
from fieldspark.operators.rollup import mode_low, zscore
from fieldspark.sources.stage import materialise

MATRIX = 1 << 20    # plots x labels that a task holds at once


def vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def kmeans_runs(df: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int],
                inits: int = 10, key: str = "plot_id") -> DataFrame:
    """(run, plot_id, cluster): one k-means per seed, the cheapest of ``inits`` starts, all fits in
    one chain of jobs. Runs are numbered as their seeds are listed."""
    grid = kmeans_grid(df, columns, {k: seeds}, inits, key)
    return grid.select((F.array_position(F.lit(list(seeds)), F.col("seed")) - 1).cast("int").alias("run"), key, "cluster")


def consensus(labels: DataFrame, key: str = "plot_id", by: Sequence[str] = ()) -> DataFrame:
    """Score of every run against all runs: sum over run pairs of squared contingency counts.

    This equals agreement with the co-association matrix, without any row-by-row matrix. Each
    plot carries its few run labels as one list; what is shuffled is the contingency table.
    """
    return scores(*contingency(labels, key, by), by)


def scores(runs: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    score = pairs.groupBy(*by, "run_a").agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    return null_safe_join(score, runs, list(by)).select(
        *by, F.col("run_a").alias("run"), (F.col("s") / F.col("runs")).alias("score"))


def contingency(labels: DataFrame, key: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    runs = labels.groupBy(*by).agg(F.count_distinct("run").alias("runs"))
    lists = labels.groupBy(*by, key).agg(F.collect_list(F.struct("run", "cluster")).alias("_l")).select(*by, "_l")
    kind = {f.name: f.dataType for f in labels.schema}
    sent = StructType([StructField(c, kind[c]) for c in by] + [StructField(n, kind[c]) for n, c in (
        ("run_a", "run"), ("run_b", "run"), ("a", "cluster"), ("b", "cluster"))] + [StructField("n", LongType())])
    pairs = lists.mapInArrow(counting(list(by)), sent).groupBy(*by, "run_a", "run_b", "a", "b").agg(F.sum("n").alias("n"))
    return runs, pairs


def numbered(columns: Sequence[pa.Array], n: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for every one of ``n`` rows, and the values that each number stands for."""
    code = np.zeros(n, np.int64)
    for c in columns:
        c = c.dictionary_encode(null_encoding="encode")
        code = code * len(c.dictionary) + c.indices.to_numpy()
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, list(zip(*[c.take(pa.array(first)).to_pylist() for c in columns])) if columns else [()]


def counting(by: Sequence[str]):
    """Plots' lists of (run, cluster) to the number of plots that each two of them share, one table a
    task: plots by labels as a matrix, times itself, so that no row per plot and pair is made."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict[tuple, int], np.ndarray]] = {}
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, lists = batch.schema, batch.column("_l")
            items = lists.flatten()
            plot = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            label, labels = numbered(items.flatten(), len(items))
            group, groups = numbered([batch.column(c) for c in by], batch.num_rows)
            for g, name in enumerate(groups):
                mine = np.flatnonzero(group[plot] == g)
                seen, column = np.unique(label[mine], return_inverse=True)
                where, table = held.get(name, ({}, np.zeros((0, 0), np.int64)))
                at = np.array([where.setdefault(labels[i], len(where)) for i in seen])
                if len(where) > len(table):
                    table = np.pad(table, (0, len(where) - len(table)))
                rows = max(1, MATRIX // max(len(seen), 1))
                _, row = np.unique(plot[mine], return_inverse=True)
                ends = np.searchsorted(row, np.arange(0, row[-1] + 1 + rows, rows))
                for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    spot = (row[lo:hi] - i * rows) * len(seen) + column[lo:hi]
                    marks = np.bincount(spot, minlength=rows * len(seen)).reshape(rows, len(seen)).astype(np.float64)
                    table[np.ix_(at, at)] += (marks.T @ marks).astype(np.int64)
                held[name] = where, table
        for name, (where, table) in held.items():
            labels, (a, b) = list(where), np.nonzero(table)
            run, cluster = schema.field("_l").type.value_type
            runs, clusters = pa.array([r for r, _ in labels], run.type), pa.array([c for _, c in labels], cluster.type)
            same = [pa.array([v], schema.field(c).type).take(pa.array(np.zeros(len(a), np.int64))) for c, v in zip(by, name)]
            a_at, b_at = pa.array(a), pa.array(b)
            yield pa.RecordBatch.from_arrays([*same, runs.take(a_at), runs.take(b_at), clusters.take(a_at), clusters.take(b_at), pa.array(table[a, b])],
                                             names=[*by, "run_a", "run_b", "a", "b", "n"])

    return count


def consensus_partition(labels: DataFrame, key: str = "plot_id", by: Sequence[str] = ()) -> DataFrame:
    """The run that agrees best with all runs, with each plot's stability in it; one per group of
    ``by`` (a setting), all in the same jobs."""
    by = list(by)
    runs, pairs = contingency(labels, key, by)
    # Staged, so that its real size decides how it meets the plots.
    runs, pairs = materialise(runs) if by else runs, materialise(pairs)
    best = scores(runs, pairs, by).groupBy(*by).agg(F.min_by("run", F.struct(-F.col("score"), F.col("run"))).alias("_best"))
    chosen = null_safe_join(labels, best, by).where(F.col("run") == F.col("_best"))
    mine = chosen.select(*by, key, F.col("run").alias("run_a"), F.col("cluster").alias("a"))
    other = labels.select(*by, key, F.col("run").alias("run_b"), F.col("cluster").alias("b"))
    size = mine.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("_size"))
    s = (mine.join(other, [*by, key]).join(pairs, [*by, "run_a", "run_b", "a", "b"])
         .groupBy(*by, key, "run_a", "a").agg(F.sum("n").alias("_n")).join(size, [*by, "a"]))
    return null_safe_join(s, runs, by).select(
        *by, key, F.col("run_a").alias("run"), F.col("a").alias("cluster"),
        (F.col("_n") / (F.col("runs") * F.col("_size"))).alias("stability"))


def cluster_profile(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Mean descriptors per cluster, standardised across the clusters of a group of ``by``."""
    prof = df.groupBy(*by, cluster).agg(*[F.avg(c).alias(c) for c in columns])
    return zscore(prof, columns, by=by)


def rule_scores(profile: DataFrame, rules: Mapping[str, Mapping[str, float]],
                cluster: str = "cluster") -> DataFrame:
    """Sum of coefficient times z-score per cluster and class."""
    rows = F.array(*[F.struct(
        F.lit(cls).alias("cls"),
        sum((F.col(f) * float(w) for f, w in r.items()), F.lit(0.0)).alias("score"))
        for cls, r in rules.items()])
    return profile.select(cluster, F.explode(rows).alias("_s")).select(cluster, "_s.*")


def assign_tier1(profile: DataFrame, level: str = "level_T3", drop: str = "d34",
                 first: str = "Rice", second: str = "Cotton") -> Column:
    """Clear signatures only: bright and falling gives the first class, rising the second."""
    return (F.when((F.col(level) >= 1.0) & (F.col(drop) <= 0.0), first)
             .when(F.col(drop) >= 1.0, second))


def cluster_margin(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", cls: str = "cls",
                   key: str = "plot_id", fit: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """How much closer a row is to its own centre than to the nearest centre of another class.

    ``fit`` marks the rows that centres are means of, all if not given; a cluster's class is its
    commonest over all rows. The centres (one row per cluster) travel as a single list per group of
    ``by``, so rows never multiply.
    """
    by = list(by)
    point = F.array(*[F.col(c) for c in columns])
    base = df if fit is None else df.where(fit)
    centres = base.groupBy(*by, cluster).agg(F.array(*[F.avg(c) for c in columns]).alias("v"))
    named = centres.join(mode_low(df, [*by, cluster], cls, "_k"), [*by, cluster])
    table = named.groupBy(*by).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "v", F.col("_k").alias("k"))).alias("_all"))
    d = null_safe_join(df, materialise(table) if by else table, by)

    def dist(v: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(point, v, lambda a, b: (a - b) * (a - b)),
                                  F.lit(0.0), lambda acc, x: acc + x))

    mine = F.get(F.filter("_all", lambda s: s["c"] == F.col(cluster)), F.lit(0))
    d = d.withColumn("_own", mine)
    other = F.filter("_all", lambda s: s["k"] != F.col("_own.k"))
    d = d.withColumns({"own": dist(F.col("_own.v")),
                       "nearest_other": F.array_min(F.transform(other, lambda s: dist(s["v"])))})
    return d.select(*by, key, "own", "nearest_other", F.try_divide(
        F.col("nearest_other") - F.col("own"), F.col("nearest_other") + F.col("own")).alias("margin"))


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance (Spark's definition)."""
    data = vectors(df, columns).withColumn("prediction", F.col(cluster).cast("int"))
    value = ClusteringEvaluator(predictionCol="prediction").evaluate(data)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(float(value)).alias("silhouette"))


def neighbour_label(points: DataFrame, edges: DataFrame, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Screened rows take the majority cluster of their nearest kept rows, in every group of ``by``."""
    donors = points.select(*by, F.col("plot_id").alias("donor_id"), F.col(cluster))
    votes = edges.join(donors, "donor_id")
    return mode_low(votes.withColumnRenamed("query_id", "plot_id"), [*by, "plot_id"], cluster, cluster)
