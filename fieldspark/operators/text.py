"""Tracing numbers in prose to the lines of a log, word budgets and pattern guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

# What counts as a numeric token, and as a decimal in a log line.
TOKEN = r"\d+(?:\.\d+)?(?:e[+-]?\d+)?"
DECIMAL = r"\d+\.\d+"
# Longest stretch of characters a token can be part of.
RUN = r"[0-9.e+-]*[0-9][0-9.e+-]*"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(TOKEN), F.lit(0))


def numeric_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct numeric tokens; duplicates are dropped inside each text first."""
    return docs.select(F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token")).distinct()


def distinct_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens, longest first."""
    return numeric_tokens(docs, text).withColumn("length", F.length("token")).orderBy(
        F.col("length").desc(), "token")


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line) with commas removed."""
    clean = F.replace(F.col(text), F.lit(","), F.lit(""))
    return docs.select(key, F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))


def trace_tokens(tokens: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """First line that holds each token verbatim, else the first whose decimal rounds to it.

    A token inside a line is a piece of an unbroken stretch of number characters, so pieces of
    the lengths that tokens have are cut from those stretches and met by an equi join. Whole
    numbers and exponents only match verbatim.
    """
    tok = materialise(tokens.select("token").distinct())
    sizes = tok.agg(F.sort_array(F.collect_set(F.length("token"))).alias("_sizes"))
    stretch = lines.select(key, "line_no", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("line"), F.lit(RUN), F.lit(0)))).alias("_run"))
    sized = null_safe_join(stretch, sizes, []).select(
        key, "line_no", "_run", F.explode(F.filter("_sizes", lambda n: n <= F.length("_run"))).alias("_n"))
    pieces = sized.select(key, "line_no", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_run") - F.col("_n") + 1),
        lambda i: F.substring(F.col("_run"), i, F.col("_n"))))).alias("token"))
    where = F.struct(F.col(key), F.col("line_no"))
    verbatim = materialise(pieces.join(tok, "token", "left_semi").groupBy("token")
                           .agg(F.min(where).alias("_at")).withColumn("how", F.lit("verbatim")))

    places = F.length(F.element_at(F.split("token", r"\."), -1))
    rest = materialise(tok.join(verbatim, "token", "left_anti")
                       .where(F.col("token").contains(".") & ~F.col("token").contains("e"))
                       .withColumn("_places", places))
    digits = rest.agg(F.sort_array(F.collect_set("_places")).alias("_all"))
    decimals = lines.select(key, "line_no", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("line"), F.lit(DECIMAL), F.lit(0)))).alias("_d"))
    rounded = null_safe_join(decimals, digits, []).select(
        key, "line_no", "_d", F.explode("_all").alias("_places"))
    rounded = rounded.withColumn("token", fixed_text(F.col("_d"), F.col("_places")))
    by_value = (rounded.join(rest.select("token", "_places"), ["token", "_places"], "left_semi")
                .groupBy("token").agg(F.min(where).alias("_at")).withColumn("how", F.lit("rounded")))
    found = verbatim.unionByName(by_value)
    return tok.join(found, "token", "left").select(
        "token", F.col(f"_at.{key}").alias(key), F.col("_at.line_no").alias("line_no"),
        F.coalesce("how", F.lit("missing")).alias("how"))


def fixed_text(number: Column, places: Column) -> Column:
    """Decimal text rounded half up to a number of places, as text with exactly that many.

    Works on digits: no binary rounding, and any length.
    """
    def let(value: Column, body) -> Column:
        # Each step is computed once, however often the next one reads it.
        return F.transform(F.array(value), body)[0]

    whole = F.split_part(number, F.lit("."), F.lit(1))
    part = F.split_part(number, F.lit("."), F.lit(2))
    following = F.coalesce(F.ascii(F.substring(part, places + 1, F.lit(1))), F.lit(0))

    def raised(kept: Column, stem: Column) -> Column:
        # One more in the last digit turns the nines after it into zeros.
        zeros = F.repeat(F.lit("0"), F.length(kept) - F.length(stem))
        last = (F.ascii(F.right(stem, F.lit(1))) - 47).cast("string")
        return F.when(stem == "", F.concat(F.lit("1"), zeros)).otherwise(
            F.concat(F.substring(stem, F.lit(1), F.length(stem) - 1), last, zeros))

    def padded(digits: Column) -> Column:
        # At least one digit before the point.
        return F.when(F.length(digits) <= places, F.lpad(digits, places + 1, F.lit("0"))).otherwise(digits)

    def pointed(digits: Column) -> Column:
        n = F.length(digits) - places
        return F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, places))

    digits = let(F.concat(whole, F.rpad(F.substring(part, F.lit(1), places), places, F.lit("0"))),
                 lambda kept: F.ltrim(F.when(following >= 53, let(F.rtrim(kept, F.lit("9")), lambda stem: raised(kept, stem)))
                                      .otherwise(kept), F.lit("0")))
    return let(let(digits, padded), pointed)


def word_budget(docs: DataFrame, limit: int, key: str, text: str = "text") -> DataFrame:
    """Words split on white space, against a limit."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return docs.select(key, words.alias("words"), (words <= limit).alias("within"))


def pattern_guard(files: DataFrame, pattern: str, allowed: DataFrame | None, key: str,
                  text: str = "text") -> DataFrame:
    """Files outside the allow-list that match, with the first matching line and how many."""
    kept = files if allowed is None else files.join(allowed.select(key), key, "left_anti")
    # The whole text is tested first, so only matching files are split into lines.
    hit = kept.where(F.col(text).rlike(pattern)).select(
        key, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    return (hit.where(F.col("_line").rlike(pattern)).groupBy(key)
            .agg(F.min(F.col("_i") + 1).alias("first_line"), F.count(F.lit(1)).alias("lines")))
