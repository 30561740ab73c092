"""Language-model scores by deleted interpolation of word unigrams and bigrams.

Counts are exact and as many as the corpus has: each task turns a block of documents into the
distinct n-grams in it with their counts, hashed to keys and dealt by key; one task per bucket of
keys adds up the counts and answers each block. A frequent n-gram therefore sends one number per
block and never gathers its occurrences. Maximum-likelihood estimates of both orders and a uniform
one are mixed with weights that depend on how often the context was seen; the weights are learned
by expectation-maximisation on held-out counts, each training token being left out of the counts
it is predicted from.

Keys have 40 bits more than buckets need, so two n-grams share a key about once in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise

BLOCK_TOKENS = 3 << 19      # tokens of a block, unless a single text has more
BUCKET_KEYS = 1 << 21       # keys that a bucket is sized for
REST_BITS = 40
CLASSES = 24                # context-frequency classes: unseen, 1, 2-3, 4-7, ...
STEP = 4                    # steps per octave in which estimates are told apart when weights are learned
ROUNDS = 60
FLOOR = 1e-6                # least weight of the uniform estimate
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TABLE = 400_000             # word hashes that a task remembers


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def words(text: str | None) -> list[bytes]:
    """Tokens but for the end: A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def pair_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; ``first`` marks tokens that open a text."""
    before = np.concatenate([[START], tokens[:-1]])
    before[first] = START
    with np.errstate(over="ignore"):
        k = before * np.uint64(0xD6E8FEB86659FD93) + tokens
        k ^= k >> np.uint64(32)
        k *= np.uint64(0xD6E8FEB86659FD93)
        k ^= k >> np.uint64(29)
    return k


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per block: its texts, and its tokens as places in the sorted list of its words."""
    table = Hashes()
    docs: list[tuple] = []
    held: list[np.ndarray] = []
    size, serial = 0, 0

    def row() -> pd.DataFrame:
        tokens = np.concatenate(held)
        hashes, codes = np.unique(tokens, return_inverse=True)
        ids, n, train, part = zip(*docs)
        return pd.DataFrame({"part": [part[0]], "serial": [serial], "ids": [list(ids)], "n": [list(n)], "train": [list(train)],
                             "size": [len(tokens)], "kinds": [len(hashes)],
                             "hashes": [packed(hashes)], "codes": [packed(codes.astype("<u4"))]})

    for frame in batches:
        for part, doc_id, train, text in zip(frame["part"], frame["doc_id"], frame["train"], frame["text"]):
            found = words(text)
            hashed = np.empty(len(found) + 1, dtype=np.uint64)
            hashed[:-1] = np.fromiter(map(table.__getitem__, found), dtype=np.uint64, count=len(found))
            hashed[-1] = END
            docs.append((doc_id, len(hashed), bool(train), part))
            held.append(hashed)
            size += len(hashed)
            if size >= BLOCK_TOKENS:
                yield row()
                docs.clear()
                held.clear()
                size, serial = 0, serial + 1
    if docs:
        yield row()


BLOCKS = "part int, serial int, ids array<string>, n array<int>, train array<boolean>, size long, kinds long, hashes binary, codes binary"


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, codes, first, train per token, and lengths of a block's row."""
    n = np.asarray(row["n"], dtype=np.int64)
    hashes = unpacked(row["hashes"], "<u8", row["kinds"])
    codes = unpacked(row["codes"], "<u4", row["size"])
    first = np.zeros(row["size"], dtype=bool)
    first[np.cumsum(n) - n] = True
    return hashes, codes, first, np.repeat(np.asarray(row["train"], dtype=bool), n), n


def keys_of(row, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, distinct keys, place of each token's key, token is for training) of a block."""
    hashes, codes, first, train, _ = opened(row)
    cut = np.uint64(64 - REST_BITS - bits)
    # Words are hashed by another function than pairs, so their keys are mixed once more.
    with np.errstate(over="ignore"):
        one = (hashes * np.uint64(0xFF51AFD7ED558CCD)) >> cut
    kinds, at = np.unique(one, return_inverse=True)
    yield 1, kinds, at[codes], train
    kinds, at = np.unique(pair_keys(hashes[codes], first) >> cut, return_inverse=True)
    yield 2, kinds, at, train


def deal(blocks_: DataFrame, bits: int) -> DataFrame:
    """(part, serial, order, bucket, keys, counts): a block's distinct keys of each bucket."""
    rest = np.uint64(REST_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.to_dict("records"):
                out = []
                for order, kinds, at, train in keys_of(row, bits):
                    counts = np.bincount(at[train], minlength=len(kinds)).astype("<u4")
                    bucket = (kinds >> rest).astype(np.int64)
                    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                    low = kinds.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :REST_BITS // 8]
                    for a, b in zip(edges, [*edges[1:], len(kinds)]):
                        out.append((row["part"], row["serial"], order, int(bucket[a]), low[a:b].tobytes(), packed(counts[a:b])))
                yield pd.DataFrame(out, columns=["part", "serial", "order", "bucket", "keys", "counts"])

    return blocks_.mapInPandas(run, "part int, serial int, order int, bucket long, keys binary, counts binary")


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks for each block's keys, and one row with the number of kinds."""
    width = REST_BITS // 8
    sizes = [len(k) // width for k in group["keys"]]
    raw = np.frombuffer(b"".join(group["keys"]), dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :width] = raw
    kinds, at = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    counts = np.concatenate([unpacked(c, "<u4", n) for c, n in zip(group["counts"], sizes)])
    sums = np.bincount(at, weights=counts, minlength=len(kinds)).astype("<i8")
    ends = np.cumsum(sizes)
    order, bucket = int(group["order"].iloc[0]), int(group["bucket"].iloc[0])
    out = [(p, s, order, bucket, n, packed(sums[at[e - n:e]]), None)
           for p, s, n, e in zip(group["part"], group["serial"], sizes, ends)]
    out.append((-1, -1, order, bucket, 0, None, int((sums > 0).sum())))
    return pd.DataFrame(out, columns=["part", "serial", "order", "bucket", "n", "sums", "seen"]).astype({"seen": "Int64"})


ANSWERS = "part int, serial int, order int, bucket long, n long, sums binary, seen long"


def class_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its binary logarithm."""
    out = np.zeros(len(context), dtype=np.int64)
    seen = context > 0
    out[seen] = np.minimum(1 + np.log2(context[seen]).astype(np.int64), CLASSES - 1)
    return out


def cells(c1: np.ndarray, c2: np.ndarray, context: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Held-out estimates of training tokens, rounded to steps: (cell, how many tokens)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        f2 = np.where(context > 1, (c2 - 1) / np.maximum(context - 1, 1), 0.0)
        f1 = (c1 - 1) / max(whole - 1, 1)
        q2 = np.where(f2 > 0, np.rint(-np.log2(np.where(f2 > 0, f2, 1)) * STEP), 1023).astype(np.int64)
        q1 = np.where(f1 > 0, np.rint(-np.log2(np.where(f1 > 0, f1, 1)) * STEP), 1023).astype(np.int64)
    return np.unique((class_of(np.maximum(context - 1, 0)) * 1024 + np.minimum(q2, 1023)) * 1024 + np.minimum(q1, 1023), return_counts=True)


def joined(whole: int, starts: int, bits: int):
    """Function for a block and its answers: counts per token and the held-out cells."""
    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=COUNTED_NAMES)
        row = left.iloc[0]
        got = {}
        for order, part in right.sort_values("bucket").groupby("order"):
            got[order] = np.concatenate([unpacked(s, "<i8", n) for s, n in zip(part["sums"], part["n"])])
        _, _, first, train, _ = opened(row)
        per = {order: got[order][at] for order, _, at, _ in keys_of(row, bits)}
        context = np.concatenate([[starts], per[1][:-1]])
        context[first] = starts
        cell, n = cells(per[1][train], per[2][train], context[train], whole)
        return pd.DataFrame({"ids": [row["ids"]], "n": [row["n"]], "size": [row["size"]], "c1": [packed(per[1].astype("<i8"))],
                             "c2": [packed(per[2].astype("<i8"))], "cell": [cell], "cell_n": [n]})
    return run


COUNTED = "ids array<string>, n array<int>, size long, c1 binary, c2 binary, cell array<long>, cell_n array<long>"
COUNTED_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def learn(cell: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """Weights (class, [bigram, unigram, uniform]) by expectation-maximisation."""
    q1, q2, k = cell % 1024, cell // 1024 % 1024, cell // (1024 * 1024)
    f = np.stack([np.where(q2 < 1023, 2.0 ** (-q2 / STEP), 0), np.where(q1 < 1023, 2.0 ** (-q1 / STEP), 0),
                  np.full(len(cell), 1.0 / (kinds + 1))], axis=1)
    out = np.tile([0.3, 0.6, 0.1], (CLASSES, 1))
    out[0] = [0.0, 0.9, 0.1]
    for _ in range(ROUNDS):
        p = out[k] * f
        p *= (n / p.sum(1))[:, None]
        mass = np.stack([np.bincount(k, weights=p[:, i], minlength=CLASSES) for i in range(3)], axis=1)
        # One token's worth of the old weights keeps classes without tokens as they are.
        out = (mass + out) / (mass.sum(1) + 1.0)[:, None]
    out[:, 2] = np.maximum(out[:, 2], FLOOR)
    return out / out.sum(1, keepdims=True)


def scored(weights: np.ndarray, whole: int, kinds: int, starts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.to_dict("records"):
                n = np.asarray(row["n"], dtype=np.int64)
                c1, c2 = (unpacked(row[c], "<i8", row["size"]) for c in ("c1", "c2"))
                at = np.cumsum(n) - n
                context = np.concatenate([[starts], c1[:-1]])
                context[at] = starts
                w = weights[class_of(context)]
                p = (w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(whole, 1) + w[:, 2] / (kinds + 1))
                base = np.log10((c1 + 1.0) / (whole + kinds + 1))
                yield pd.DataFrame({"doc_id": row["ids"], "n_tokens": n, "n_known": np.add.reduceat((c1 > 0).astype(np.int64), at),
                                    "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at)})
    return run


def score(docs: DataFrame, train: str = "train") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``docs`` has doc_id, text and the boolean column ``train``, which says whose text the counts
    come from. A null text is empty: its only token is the end. With no training text every
    estimate is the uniform one. Rows that repeat are counted and scored each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"),
                       F.coalesce(F.col(train), F.lit(False)).alias("train"), "text")
    held = materialise(rows.mapInPandas(blocks, BLOCKS))
    trained = F.expr("aggregate(zip_with(n, train, (a, b) -> if(b, cast(a as bigint), 0L)), 0L, (a, v) -> a + v)")
    size = held.agg(F.sum("size").alias("all"), F.sum(trained).alias("whole"),
                    F.sum(F.expr("cast(size(filter(train, t -> t)) as bigint)")).alias("starts")).first()
    every, whole, starts = (int(x or 0) for x in size)
    bits = min(24, max(5, int(np.ceil(np.log2(max(2 * every, 1) / BUCKET_KEYS)))))
    answers = materialise(deal(held, bits).groupBy("order", "bucket").applyInPandas(answer, ANSWERS))
    kinds = int(answers.where("order = 1").agg(F.sum("seen")).first()[0] or 0)
    counted = materialise(held.groupBy("part", "serial").cogroup(
        answers.where("part >= 0").groupBy("part", "serial")).applyInPandas(joined(whole, starts, bits), COUNTED))
    got = (counted.select(F.explode(F.arrays_zip("cell", "cell_n")).alias("x"))
           .groupBy("x.cell").agg(F.sum("x.cell_n").alias("n")).orderBy("cell").collect())
    # A bounded table: classes by steps of either estimate.
    weights = learn(np.array([r["cell"] for r in got], dtype=np.int64), np.array([r["n"] for r in got], dtype=float), kinds)
    out = counted.mapInPandas(scored(weights, whole, kinds, starts),
                              "doc_id string, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known",
                      F.lit(whole).cast("long").alias("train_tokens"), "base_score", "score")
