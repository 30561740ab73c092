"""Document fingerprints by winnowing, in column functions only.

A text is cut into words (runs of other than white space). A run of over ``PIECE`` code points, as
in scripts without spaces or encoded data, counts as its overlapping pieces of ``ROLL`` code points,
one from each code point on, so that where a passage stands in its run does not matter. Every ``k`` consecutive words give a hash that rolls on word by word, every
``w`` consecutive hashes give a window, and of each window the smallest hash is kept, the rightmost
on ties, with its position. So any passage of ``w + k - 1`` equal words that two texts share leaves
a common hash in both fingerprints; inside long runs that holds for any ``ROLL + w + k - 2`` equal
code points. A text of fewer than ``k`` words is one gram, one of fewer than
``w`` grams one window; a null or blank text has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import bind
from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

K, W = 5, 4
PIECE, ROLL = 64, 8
# A window's minimum is taken over hash and position in one number: 40 bits and 23 bits.
HASH_BITS, PLACE_BITS = 40, 23
BUCKET_ROWS, MOST_BUCKETS = 256, 40_000


def fingerprint(text: str, k: int = K, w: int = W) -> str:
    """SQL array of longs, ascending in position: hash * 2^23 + (2^23 - 1 - position of the word).

    Texts of over 2^23 words wrap their positions, which costs ties their order and nothing else.
    """
    last = (1 << PLACE_BITS) - 1
    words = f"transform(filter(regexp_extract_all({text}, r'\\S+', 0), x -> x <> ''), x -> xxhash64(x))"
    rolled = (f"flatten(transform(filter(regexp_extract_all({text}, r'\\S+', 0), x -> x <> ''), x -> if(length(x) <= {PIECE}, array(xxhash64(x)), "
              f"transform(regexp_extract_all(x, r'(?=(\\S{{{ROLL}}}))\\S', 1), y -> xxhash64(y)))))")
    words = f"if({text} RLIKE r'(?<!\\S)\\S{{{PIECE + 1}}}', {rolled}, {words})"
    grams = ("if(size(h) < {k}, if(size(h) = 0, cast(array() as array<bigint>), array(xxhash64(h))), "
             "transform(sequence(0, size(h) - {k}), i -> xxhash64({at})))").format(
                 k=k, at=", ".join(f"h[i + {j}]" for j in range(k)))
    coded = (f"transform(g, (x, i) -> shiftleft(x & {(1 << HASH_BITS) - 1}L, {PLACE_BITS}) + ({last}L - i % {last + 1}L))")
    least = "least(" + ", ".join(f"c[i + {j}]" for j in range(w)) + ")" if w > 1 else "c[i]"
    windows = (f"if(size(c) <= {w}, if(size(c) = 0, c, array(array_min(c))), "
               f"array_distinct(transform(sequence(0, size(c) - {w}), i -> {least})))")
    return bind(words,
                "h -> " + bind(grams, "g -> " + bind(coded, f"c -> {windows}")))


def hashes(print_: str) -> str:
    """SQL: the distinct hashes of a fingerprint."""
    return f"array_distinct(transform({print_}, x -> shiftright(x, {PLACE_BITS})))"


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two distinct hash arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        both / (F.size(a) + F.size(b) - both))


def printed(print_: str) -> str:
    """SQL: a fingerprint as text, ``position:hash`` in hexadecimal, comma-joined."""
    last = (1 << PLACE_BITS) - 1
    return (f"array_join(transform({print_}, x -> concat(hex({last}L - (x & {last}L)), ':', "
            f"hex(shiftright(x, {PLACE_BITS})))), ',')")


def with_next(rows: DataFrame, key: str, columns: dict[str, str], derived=None) -> DataFrame:
    """Rows with columns of the row that follows in descending ``key`` (nulls last; ties by
    ``text``); the first row follows the last.

    ``columns`` maps a new name to the column it is taken from. Rows are dealt into buckets of
    consecutive keys, whose bounds are estimated quantiles, in one shuffle; the head of the next
    bucket joins each bucket as a guest. ``derived``, if given, is applied to rows and guests
    between the first column and the others, so that they can use it.
    """
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k")).first()
    n = max(1, min(MOST_BUCKETS, stats["n"] // BUCKET_ROWS))
    probs = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx(key, probs, max(10_000, 4 * n)).alias("b")).first()["b"] if probs and stats["k"] else []
    bounds = sorted(set(bounds or []))
    # Two-level search: first among every 200th bound, then among the 200 that follow it.
    step = 200
    coarse = bounds[::step]
    k = F.col(key)
    if bounds:
        c = F.size(F.filter(F.array(*[F.lit(x) for x in coarse]), lambda x: x <= k))
        fine = F.array(*[F.array(*[F.lit(x) for x in bounds[i:i + step]]) for i in range(0, len(bounds), step)])
        place = F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(fine[c - 1], lambda x: x <= k)))
    else:
        place = F.lit(0)
    bucket = F.when(k.isNull(), -1).otherwise(place)
    cells = rows.withColumn("_b", bucket)
    # Heads: the first row of each bucket in the order, found on slim columns first.
    slim = materialise(cells.groupBy("_b").agg(F.max(key).alias("_h")))
    heads = null_safe_join(cells, slim.select("_b", F.col("_h").alias("_hk")), ["_b"])
    heads = heads.where(F.col(key).eqNullSafe(F.col("_hk"))).drop("_hk")
    heads = materialise(heads.groupBy("_b").agg(F.min(F.struct("text", *[c for c in rows.columns if c != "text"])).alias("_r")))
    marks = sorted((r["_b"] for r in slim.select("_b").collect()), reverse=True)
    after = {b: marks[(i + 1) % len(marks)] for i, b in enumerate(marks)}
    to = {v: u for u, v in after.items()}
    if to:
        pairs = F.create_map(*[x for b, u in to.items() for x in (F.lit(b), F.lit(u))])
        guests = heads.select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns], pairs[F.col("_b")].alias("_b"), F.lit(1).alias("_g"))
    else:
        guests = cells.withColumn("_g", F.lit(1)).limit(0)
    w = Window.partitionBy("_b").orderBy("_g", F.col(key).desc_nulls_last(), "text")
    out = cells.withColumn("_g", F.lit(0)).unionByName(guests)
    names = list(columns.items())
    out = out.withColumn(names[0][0], F.lead(names[0][1]).over(w))
    if derived is not None:
        out = derived(out)
    for new, old in names[1:]:
        out = out.withColumn(new, F.lead(old).over(w))
    return out.where("_g = 0").drop("_b", "_g")
