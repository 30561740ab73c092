"""Packing documents into fixed sequences with a controlled mixture.

Every source is a queue of tokens. Deficit round-robin gives each queue, in each window, the whole
tokens of its share plus what was left over before; the rest of the share is its deficit and is
carried to the next window. A queue that runs out leaves its share to the others. What a queue has
sent by the end of a window is therefore a function of the window's number alone, so no task needs
another task's state: with the tokens each task holds per queue summed up once, every piece of
every document finds its window, sequence and offset by arithmetic, across windows and partitions.

Tokens are laid out window by window and, in a window, queue by queue; sequences are cut from that
stream, so only the last one is padded.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

LENGTH = 1024
WINDOW = 64         # sequences per window
QUEUES = 1024       # of more sources than that the small ones share queues by hash
END = 0             # id that closes a document
SPECIAL = "<|endoftext|>"


class Tokens:
    """Ids of texts by the vocabulary of ``json_path``.

    ``ranks_path`` is the same vocabulary as ranks, which a faster encoder reads whole texts by; a
    text with the special token in it goes to the slower one.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(json_path)
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.encode = lambda s: self.whole.encode(s, add_special_tokens=False).ids
        if ranks_path and pattern:
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned ids, of as many bytes as the vocabulary needs."""
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        return np.array(self.encode(text), dtype=self.kind)


@lru_cache(maxsize=2)
def tokens_for(json_path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    """The vocabulary, kept by a Python worker from task to task."""
    return Tokens(json_path, ranks_path, pattern)


def queues(docs: DataFrame, weights: Mapping[str, float] | None = None) -> Column:
    """The queue of each row: ``s`` and its source, or ``q`` and a number.

    A source with a weight always has a queue of its own. Without weights, half of ``QUEUES`` go to
    the largest sources where there are more sources than queues, and the rest share the others by
    hash. With weights only sources that come last share queues.
    """
    source = F.coalesce("source", F.lit(""))
    own = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    if docs.select(own).distinct().limit(QUEUES + 1).count() <= QUEUES:
        return own
    if weights:
        alone = [s for s, w in weights.items() if w > 0]
    else:
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
        alone = [r["s"] for r in docs.groupBy(source.alias("s")).agg(size.alias("n")).orderBy(F.desc("n"), "s").limit(QUEUES // 2).collect()]
    shared = F.concat(F.lit("q"), F.pmod(F.xxhash64(source), F.lit(max(QUEUES // 2, 1))).cast("string"))
    return F.when(source.isin(alone), own).otherwise(shared)


def tokenised(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
              weights: Mapping[str, float] | None = None) -> DataFrame:
    """Stage table of (part, doc_id, queue, before, n, ids): a row per document in the order its
    task met it, with the tokens of its queue before it in that task."""
    queue = queues(docs, weights)
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"),
                       queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sent = tokens_for(json_path, ranks_path, pattern), {}
        for frame in batches:
            before, n, ids = [], [], []
            for q, text in zip(frame["queue"], frame["text"]):
                got = np.append(coder.ids(text), np.array(END, dtype=coder.kind))
                at = sent.get(q, 0)
                before.append(at)
                n.append(len(got))
                sent[q] = at + n[-1]
                ids.append(got.tobytes())
            yield pd.DataFrame({"part": frame["part"], "doc_id": frame["doc_id"], "queue": frame["queue"],
                                "before": before, "n": n, "ids": ids})

    return materialise(rows.mapInPandas(run, "part int, doc_id string, queue string, before long, n long, ids binary"))


class Rounds:
    """What each queue has sent by the end of each window."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, float] | None, window: int):
        self.names = sorted(totals)
        self.at = {q: i for i, q in enumerate(self.names)}
        self.total = np.array([totals[q] for q in self.names], dtype=np.int64)
        w = np.array([float((weights or totals).get(q, 0.0)) for q in self.names])
        w[w <= 0] = 1e-9 * (w.max() if len(w) and w.max() > 0 else 1.0)
        self.w, self.window = w / w.sum() if len(w) else w, window
        self.whole = int(self.total.sum())
        self.windows = -(-self.whole // window)
        # The stream's length as a function of virtual time is linear between the times at which
        # queues run out.
        out = self.total / self.w if len(w) else self.w
        self.times = [0.0, *sorted(out)]
        self.sent = [0.0]
        for a, b in zip(self.times, self.times[1:]):
            self.sent.append(self.sent[-1] + (b - a) * float(self.w[out >= b].sum()))
        self.cache: dict[int, np.ndarray] = {}

    def upto(self, k: int) -> np.ndarray:
        """Tokens sent per queue by the end of window ``k``, counted from 1: whole ones only."""
        if k <= 0:
            return np.zeros_like(self.total)
        if k >= self.windows:
            return self.total
        got = self.cache.get(k)
        if got is None:
            goal = float(k * self.window)
            i = min(bisect_right(self.sent, goal), len(self.sent) - 1)
            a, b = self.sent[i - 1], self.sent[i]
            v = self.times[i - 1] + (self.times[i] - self.times[i - 1]) * ((goal - a) / (b - a) if b > a else 1.0)
            got = np.minimum(self.total, np.floor(self.w * v + 1e-9).astype(np.int64))
            if len(self.cache) > 4096:
                self.cache.clear()
            self.cache[k] = got
        return got

    def window_of(self, q: int, c: int) -> int:
        """The window, from 1, in which queue ``q`` sends its token ``c``."""
        low, high = 1, self.windows
        while low < high:
            mid = (low + high) // 2
            if self.upto(mid)[q] > c:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, queue: str, start: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the tokens from ``start`` on of a queue."""
        q, c, end = self.at[queue], start, start + n
        k = self.window_of(q, c)
        while c < end:
            was, now = self.upto(k - 1), self.upto(k)
            stop = min(end, int(now[q]))
            at = int(was.sum()) + int((now - was)[:q].sum()) + c - int(was[q])
            while c < stop:
                m = min(stop - c, length - at % length)
                yield c - start, m, at // length, at % length
                c, at = c + m, at + m
            k += 1


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
         weights: Mapping[str, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    ``weights`` are the target token proportions by source, the shares of the corpus if not given;
    sources without one come last. A null text is empty and leaves the closing id alone, a null
    source is a queue of its own, repeated rows are packed each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    staged = tokenised(docs, json_path, ranks_path, pattern, weights)
    held = materialise(staged.groupBy("queue", "part").agg(F.sum("n").alias("held")))
    # One row per task and queue, whatever the number of documents.
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("queue", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in held.groupBy("queue").agg(F.sum("held").alias("n")).collect()}
    rounds = Rounds(totals, {"n" if s is None else f"s{s}": w for s, w in weights.items()} if weights else None, window * length)
    rows = null_safe_join(staged, materialise(offsets), ["queue", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc_id, queue, at, n, ids in zip(*(frame[c] for c in ("doc_id", "queue", "at", "n", "ids"))):
                wide = np.frombuffer(ids, dtype=f"<u{len(ids) // int(n)}").astype("<u4", copy=False)
                for start, m, sequence, offset in rounds.pieces(queue, int(at), int(n), length):
                    out.append((doc_id, start, m, zlib.crc32(wide[start:start + m].tobytes()), int(n), sequence, offset))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = rows.mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
