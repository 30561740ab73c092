"""Phrase collocations counted in quotient filters.

A word of a language has an id of as many bits as the vocabulary needs for ids to be unique, which
is checked, so counts are exact. The ids of an n-gram are packed side by side and permuted by an
invertible function. The leading bits of the result are the quotient, all the others the remainder:
a filter keeps the sorted remainders, how many there are per quotient (in unary), and a counter
each, and nothing is lost. Each task counts into a filter of bounded size, cuts it by ranges of
quotients and sends the pieces away; a range merges its sorted pieces as they stream in. Since the
permutation spreads n-grams evenly, no language, word or phrase makes a range larger than others,
and a frequent phrase is one counter per filter. Inverting the permutation gives back the ids.

Words are counted first, then pairs of frequent words, then triples of frequent pairs: a phrase
can't be more frequent than its parts. Bloom filters of bounded size keep most others out of the
filters; what they let through is counted like the rest and fails the threshold then.

Null texts are empty, a null language is ``und``, repeated rows count each, very long texts are
read whole. Ties in score go to the higher count, then to the phrase that comes first in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise

LEAST = 10              # occurrences of a candidate
SHADOW = 50             # per cent of a phrase's count at which a longer candidate replaces it
TOP = 2000
SHARD_KEYS = 1 << 20    # n-grams that a task counts before it sends its filter
RANGE_KEYS = 1 << 22    # n-gram occurrences that a range of quotients is sized for
TABLE = 300_000         # words that a task remembers
MARKS = 1 << 27         # bits of a Bloom filter at most
SEEDS = 8               # hash functions tried until no two words share an id
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
BREAK = np.uint64(0)    # stands between pieces; no word has this id
ALL = (1 << 64) - 1


# --- the filter ---------------------------------------------------------------------------------

def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def permute(limbs: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """Feistel rounds over words of ``bits`` bits: one-to-one, undone by ``back``."""
    mask, out = np.uint64((1 << bits) - 1), list(limbs)
    order = [(r, i) for r in range(2) for i in range(len(out))]
    for r, i in reversed(order) if back else order:
        key = np.uint64(0x9E3779B97F4A7C15 * (r * len(out) + i + 1) & ALL)
        mix = np.zeros_like(out[0])
        for j in range(len(out)):
            if j != i:
                mix = scramble(mix * np.uint64(3) + out[j] + key)
        out[i] = out[i] ^ (mix & mask)
    return out


@dataclass
class Filter:
    """Counts of n-grams in order of their permuted words ``limbs``."""
    limbs: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def of(cls, limbs: list[np.ndarray], counts: np.ndarray) -> Filter:
        """From permuted n-grams in any order, equal ones added up."""
        if not len(counts):
            return cls(limbs, counts)
        order = np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.zeros(len(counts), dtype=bool)
        new[0] = True
        for x in limbs:
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        return cls([x[at] for x in limbs], np.add.reduceat(counts[order], at))

    def merged(self, other: Filter) -> Filter:
        return Filter.of([np.concatenate(p) for p in zip(self.limbs, other.limbs)],
                         np.concatenate([self.counts, other.counts]))

    def __len__(self) -> int:
        return len(self.counts)

    def slice(self, a: int, b: int) -> Filter:
        return Filter([x[a:b] for x in self.limbs], self.counts[a:b])

    def packed(self, bits: int, quotient: int, base: int) -> bytes:
        """``quotient`` leading bits, counted from ``base``, as one 1 per n-gram and one 0 per
        quotient; the remainder in whole bytes; counters of one byte, larger ones apart."""
        rest = bits - quotient
        q = (self.limbs[0] >> np.uint64(rest)).astype(np.int64) - base
        unary = np.zeros(len(q) + (int(q[-1]) + 1 if len(q) else 0), dtype=np.uint8)
        unary[q + np.arange(len(q))] = 1
        large = np.flatnonzero(self.counts >= 255)
        tails = [narrow(self.limbs[0] & np.uint64((1 << rest) - 1), rest), *[narrow(x, bits) for x in self.limbs[1:]]]
        body = [np.packbits(unary).tobytes(), *tails, np.minimum(self.counts, 255).astype(np.uint8).tobytes(),
                self.counts[large].astype("<i8").tobytes()]
        return np.array([len(self), len(unary), len(large)], dtype="<i8").tobytes() + b"".join(body)

    @classmethod
    def unpacked(cls, raw: bytes, words: int, bits: int, quotient: int, base: int) -> Filter:
        n, m, _ = (int(v) for v in np.frombuffer(raw, dtype="<i8", count=3))
        rest, at = bits - quotient, 24
        unary = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-m // 8), offset=at), count=m)
        at += -(-m // 8)
        q = (np.flatnonzero(unary) - np.arange(n) + base).astype(np.uint64) << np.uint64(rest)
        limbs = []
        for i in range(words):
            size = -(-(bits if i else rest) // 8)
            limbs.append(widened(raw, at, n, size))
            at += n * size
        limbs[0] = limbs[0] | q
        counts = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw, dtype="<i8", offset=at + n)
        return cls(limbs, counts)


def narrow(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)]).tobytes()


def widened(raw: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# --- words --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Ids:
    """How words get ids: ``bits`` of a hash of language and word."""
    bits: int
    seed: int

    def table(self, lang: str) -> dict[bytes, int]:
        start, cut, seed = lang.encode("utf-8", "surrogatepass") + b"\x00", 64 - self.bits, self.seed

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                # 0 is kept for breaks.
                got = self[word] = 0 if word == b"\n" else xxhash.xxh64_intdigest(start + word, seed) >> cut or 1
                return got

        return Known()


def pieces(text: str | None) -> list[bytes]:
    """Words of a text, with a line break where a piece ends."""
    if not text:
        return []
    plain = text.encode("utf-8", "surrogatepass").lower().translate(CUTS)
    return [w for w in plain.replace(b"\n", b" \n ").split(b" ") if w]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of the words that a task has met since it last gave any."""
    from collections import Counter
    seen: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        langs = [lang for lang, c in seen.items() for _ in range(len(c))]
        return pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()), pa.array([w for c in seen.values() for w in c], pa.binary()),
            pa.array([f for c in seen.values() for f in c.values()], pa.int64())], names=["lang", "word", "f"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(pieces(text))
        if sum(map(len, seen.values())) > SHARD_KEYS // 2:
            for c in seen.values():
                c.pop(b"\n", None)
            yield rows()
            seen.clear()
    for c in seen.values():
        c.pop(b"\n", None)
    if seen:
        yield rows()


def hashed(bits: int, seed: int):
    """mapInArrow function that adds ``id`` to (lang, word, f)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for b in batches:
            if sum(map(len, tables.values())) > TABLE:
                tables.clear()
            langs, words = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                tables.setdefault(lang, Ids(bits, seed).table(lang))
            ids = [tables[lang][w] for lang, w in zip(langs, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], names=["lang", "word", "f", "id"])
    return run


def vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, Ids]:
    """Words of at least ``least`` occurrences (lang, word, f, id), words per language (lang, n),
    and how ids are made. Every id of the whole vocabulary is one word's alone, or another hash is
    tried, so that rare words can't be counted as frequent ones."""
    every = materialise(docs.mapInArrow(count_words, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")))
    size = every.count()
    bits = min(62, max(24, 2 * max(size, 1).bit_length() + 6))
    for seed in range(SEEDS):
        ids = every.mapInArrow(hashed(bits, seed), "lang string, word binary, f long, id long")
        if ids.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"words share ids under {SEEDS} hash functions of {bits} bits")
    return (materialise(ids.where(F.col("f") >= least)), materialise(every.groupBy("lang").agg(F.sum("f").alias("n"))), Ids(bits, seed))


# --- Bloom filters of what is frequent -----------------------------------------------------------

def mark_key(limbs: list[np.ndarray]) -> np.ndarray:
    k = np.zeros_like(limbs[0])
    for x in limbs:
        k = scramble(k * np.uint64(5) + x + np.uint64(1))
    return k


def places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(key >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 21, 37)]


def marked(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Bloom filter of the id ``columns``, at most ``MARKS`` bits whatever the number of rows."""
    bits = 1 << min(MARKS.bit_length() - 1, max(16, (16 * rows.count()).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mark_key([c.to_numpy(zero_copy_only=False).astype(np.uint64) for c in b.columns])
            at = np.unique(np.concatenate(places(key, bits)))
            w, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(w):
                ored = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(ored.view(np.int64))], names=["w", "b"])

    got = rows.select(*columns).mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def maybe(limbs: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
    key, ok = mark_key(limbs), None
    for p in places(key, 64 * len(marks)):
        bit = ((marks[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        ok = bit if ok is None else ok & bit
    return ok


# --- counting -----------------------------------------------------------------------------------

def shards(words: int, ids: Ids, ranges: int, quotient: int, marks: np.ndarray):
    """mapInArrow function: filters of a task's n-grams, cut by range of quotients."""
    span = 1 << (quotient - (ranges - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        held: list[Filter] = []

        def sent() -> pa.RecordBatch:
            whole = held[0]
            for f in held[1:]:
                whole = whole.merged(f)
            held.clear()
            part = (whole.limbs[0] >> np.uint64(ids.bits - quotient)).astype(np.int64) // span
            kinds, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(whole)]
            blobs = [whole.slice(a, b).packed(ids.bits, quotient, int(r) * span) for r, a, b in zip(kinds, first, ends)]
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(blobs, pa.binary())], names=["range", "filter"])

        for b in batches:
            if sum(map(len, tables.values())) > TABLE:
                tables.clear()
            flat = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = pieces(text)
                if len(found) >= words:
                    known = tables.get(lang)
                    if known is None:
                        known = tables[lang] = ids.table(lang)
                    flat.append(np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)))
                    flat.append(np.zeros(1, dtype=np.uint64))
            if not flat:
                continue
            x = np.concatenate(flat)
            m = len(x) - words + 1
            limbs = [x[i:i + m] for i in range(words)]
            ok = np.ones(m, dtype=bool)
            for v in limbs:
                ok &= v != BREAK
            # Every part of one word less has to be frequent.
            good = maybe([x[i:len(x) - words + 2 + i] for i in range(words - 1)], marks)
            ok &= good[:-1] & good[1:]
            limbs = permute([v[ok] for v in limbs], ids.bits)
            held.append(Filter.of(limbs, np.ones(len(limbs[0]), dtype=np.int64)))
            # Filters of like size are merged, so every n-gram is merged a few times only.
            while len(held) > 1 and len(held[-2]) < 2 * len(held[-1]):
                last = held.pop()
                held[-1] = held[-1].merged(last)
            if sum(map(len, held)) > SHARD_KEYS:
                yield sent()
        if sum(map(len, held)):
            yield sent()
    return run


def merge(words: int, ids: Ids, ranges: int, quotient: int, least: int):
    """mapInArrow function over rows sorted by range: merges a range's filters as they come and
    gives the ids and counts of the frequent n-grams."""
    span = 1 << (quotient - (ranges - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def frequent() -> pa.RecordBatch:
            whole = held[0]
            for f in held[1:]:
                whole = whole.merged(f)
            keep = whole.counts >= least
            back = permute([x[keep] for x in whole.limbs], ids.bits, back=True)
            return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in back], pa.array(whole.counts[keep])],
                                              names=[*[f"w{i + 1}" for i in range(words)], "a"])

        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if r != now and held:
                    yield frequent()
                    held.clear()
                now = r
                held.append(Filter.unpacked(raw.as_py(), words, ids.bits, quotient, r * span))
                while len(held) > 1 and len(held[-2]) < 2 * len(held[-1]):
                    last = held.pop()
                    held[-1] = held[-1].merged(last)
        if held:
            yield frequent()
    return run


def counted(docs: DataFrame, words: int, ids: Ids, total: int, frequent: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Stage table (w1, ..., a) of the n-grams of ``words`` words with at least ``least``
    occurrences; ``frequent`` holds the parts of one word less, ``total`` bounds occurrences."""
    ranges = max(1, math.ceil(total / RANGE_KEYS))
    quotient = min(ids.bits - 1, max(8, min(total, SHARD_KEYS).bit_length()) + (ranges - 1).bit_length())
    sent = docs.mapInArrow(shards(words, ids, ranges, quotient, marked(frequent, columns)), "range long, filter binary")
    whole = ", ".join(f"w{i + 1} long" for i in range(words)) + ", a long"
    return materialise(sent.repartition("range").sortWithinPartitions("range").mapInArrow(merge(words, ids, ranges, quotient, least), whole))


# --- scores -------------------------------------------------------------------------------------

def cut_score(a: str, left: str, right: str) -> Column:
    big = "decimal(38, 0)"
    return F.expr(f"cast((cast(1000000 as {big}) * cast({a} as decimal(19, 0)) * {a}) div (cast({left} as decimal(19, 0)) * {right}) as bigint)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, shadow: int = SHADOW, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, n, ids = vocabulary(rows, least)
    total = n.agg(F.sum("n")).first()[0] or 0
    two = counted(rows, 2, ids, total, words, ["id"], least)
    three = counted(rows, 3, ids, total, two, ["w1", "w2"], least)

    def word(i: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))

    pairs = materialise(two.join(word(1), "w1").join(word(2), "w2"))
    pair = pairs.select("w1", "w2", F.col("a").alias("f12"))
    triples = (three.join(word(1), "w1").join(word(2).drop("f2"), "w2").join(word(3), "w3").join(pair, ["w1", "w2"])
               .join(pair.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f12").alias("f23")), ["w2", "w3"]))
    longer = three.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    longest = longer.groupBy("p.w1", "p.w2").agg(F.max("a").alias("over"))
    short = (pairs.join(longest, ["w1", "w2"], "left").where(F.coalesce(F.lit(100) * F.col("over") < F.lit(shadow) * F.col("a"), F.lit(True)))
             .select("lang", F.concat("t1", F.lit(b" "), "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                     cut_score("a", "f1", "f2").alias("score")))
    cuts = triples.withColumn("s1", cut_score("a", "f1", "f23")).withColumn("s2", cut_score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    long = cuts.select("lang", F.concat("t1", F.lit(b" "), "t2", F.lit(b" "), "t3").alias("phrase"), "a",
                       F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
                       F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.union(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
