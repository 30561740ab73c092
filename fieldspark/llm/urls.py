"""URL filters: host rules, and a path-template tree for what no rule decides.

Every URL becomes a chain of nodes: host, then a template for each path segment. A segment that
varies (digits in it, or as many values as pages under the same parent) turns into a wildcard.
Branches under hosts of the same suffix that carry the same template and whose label rates do not
differ by more than chance are merged. A template's purity is its share of blocked labels, smoothed
by its parent: template and host, merged template, host, suffix, everything. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

# The rules as (host, path prefix, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEPTH = 12          # levels of the tree; the segments below share the last one
VARIED = 0.5        # distinct segments per page from which a segment varies
LEAST_PAGES = 4     # pages under a parent before that share counts
SMOOTHING = 4.0     # pages that the parent's purity counts for
APART = 2.0         # standard errors between label rates from which branches stay apart
CUT = 0.5           # purity from which a template is rejected


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as (rule, verdict); null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def shape(segment: Column) -> Column:
    """A segment with its digits and long hexadecimal runs generalised."""
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9a-fA-F]{16,}", "*"), r"[0-9]+", "*")


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``pages`` with host and path, plus ``template``: the path with variable segments as ``*``.

    The tree is built level by level from the top: whether a segment varies is decided under its
    own host and parent template, so all values of a varied parent share one subtree. Segments
    deeper than ``depth`` count as one.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    head = F.when(F.size(parts) <= depth, parts).otherwise(
        F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, 1 << 30), "/"))))
    rows = pages.withColumn("_s", F.transform(head, shape)).withColumn("template", F.lit(""))
    levels = rows.agg(F.max(F.size("_s"))).first()[0] or 0
    for i in range(levels):
        here = F.get(F.col("_s"), F.lit(i))
        values = rows.where(F.size("_s") > i).groupBy("host", "template", here.alias("s")).agg(F.count(F.lit(1)).alias("n"))
        varied = materialise(values.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
                             .where((F.col("n") >= LEAST_PAGES) & (F.col("kinds") >= VARIED * F.col("n")))
                             .select("host", "template", F.lit(True).alias("_v")))
        step = F.concat("template", F.lit("/"), F.when(F.col("_v"), "*").otherwise(here))
        rows = rows.join(varied, ["host", "template"], "left").withColumn(
            "template", F.when(F.size("_s") > i, step).otherwise(F.col("template"))).drop("_v")
    return rows.drop("_s")


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def purities(rows: DataFrame) -> DataFrame:
    """(host, template, purity, merged) for the templates of ``rows``.

    ``rows`` has host, template and bad (1, 0 or null for no label). Counts are taken per host and
    template once; everything above is summed from them.
    """
    leaf = materialise(rows.groupBy("host", "template").agg(
        F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("b"))
        .withColumn("suffix", suffix(F.col("host"))))

    def smooth(b: str, n: str, prior) -> Column:
        return (F.col(b) + SMOOTHING * prior) / (F.col(n) + SMOOTHING)

    def level(keys: Sequence[str], mark: str) -> DataFrame:
        return leaf.groupBy(*keys).agg(F.sum("n").alias(f"n_{mark}"), F.sum("b").alias(f"b_{mark}"))

    out = null_safe_join(leaf.withColumn("_one", F.lit(1)), materialise(level([], "all")), [])
    out = out.join(level(["suffix"], "suf"), "suffix").join(level(["host"], "host"), "host")
    out = out.join(level(["suffix", "template"], "pool"), ["suffix", "template"]).join(level(["template"], "same"), "template")
    rate = F.col("b_pool") / F.greatest(F.col("n_pool"), F.lit(1))
    gap = F.abs(F.col("b") / F.greatest(F.col("n"), F.lit(1)) - rate)
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("n"), F.lit(1)))
    merged = (F.col("n") == 0) | (gap <= APART * error + 1e-12)
    every = smooth("b_all", "n_all", F.lit(0.5))
    same = smooth("b_same", "n_same", every)
    suf = smooth("b_suf", "n_suf", same)
    host = smooth("b_host", "n_host", suf)
    pool = smooth("b_pool", "n_pool", host)
    own = F.when(merged, smooth("b", "n", pool)).otherwise(smooth("b", "n", host))
    return out.select("host", "template", own.alias("purity"), merged.alias("merged"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, cut: float = CUT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages``.

    A rule's verdict stands, and labels the page for the tree; other pages are rejected where
    their template's smoothed purity reaches ``cut``. A null URL has empty host and path and is
    judged like any other. Rows that repeat are each judged.
    """
    url = pages.select("page_id", F.col("url"))
    rows = url.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    rows = templates(rows).withColumn("bad", F.when(F.col("_r.verdict") == "block", 1).when(F.col("_r.verdict") == "allow", 0))
    known = purities(rows)
    out = null_safe_join(rows, known, ["host", "template"], "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("purity") >= cut, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
