"""Language identification by word-first backoff.

A word that is known scores its log frequency in each language. A word that is not falls back to
character n-grams, the longest first, and to shorter ones where too few of those are known. The sum
over the words of a text decides.

Word counts cover every training text. What is bounded is the table kept of them: the ``SPELLED``
most frequent words of all, the most frequent ones of each language (``SPELLED`` over the number of
languages, about), so that a small language has words too, and of each length the ``GRAMS`` most
frequent n-grams of these words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import add_by_text
from fieldspark.sources.stage import materialise

WORD = re.compile(r"[^\W\d_]+")
SPELLED, GRAMS, LANGUAGES = 100_000, 60_000, 256
LONGEST = 5         # n-grams from this length down to one character
FOUND = 0.5         # share of a word's n-grams that must be known at a length
SMOOTHING = 0.1
FLUSH, CHUNK, CACHE, CACHE_NUMBERS = 200_000, 20_000, 300_000, 20_000_000
STEPS = 8           # levels of frequency per doubling, by which a language's own words are chosen


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n), summed over as much of a partition as fits."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pd.DataFrame:
        out = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        return pd.DataFrame(out, columns=["lang", "word", "n"])

    for frame in batches:
        for lang, text in zip(frame["lang"], frame["text"]):
            # A long text is counted piece by piece.
            found = words(text)
            for i in range(0, len(found), FLUSH):
                seen[lang].update(found[i:i + FLUSH])
                if sum(map(len, seen.values())) > FLUSH:
                    yield rows()
                    seen.clear()
    if seen:
        yield rows()


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies per language: rows of ``logs``, found by word in ``known`` and by n-gram in
    ``parts``."""

    def __init__(self, langs: list[str], prior: np.ndarray, known: dict[str, int], parts: dict[str, int], logs: np.ndarray):
        self.langs, self.prior, self.known, self.parts, self.logs = langs, prior, known, parts, logs
        self.rows: Rows | None = None   # made by each task for itself

    def vector(self, word: str) -> np.ndarray | None:
        """Log likelihoods of one word, by the longest n-grams of which enough are known."""
        got = self.known.get(word)
        if got is not None:
            return self.logs[got]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            all_ = grams(word, n)
            hits = [v for v in map(self.parts.get, all_) if v is not None]
            if hits and len(hits) >= FOUND * len(all_):
                return self.logs[hits].sum(0) / len(hits)
        return None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores. Words are looked up once: ``rows`` remembers where each one's log
        likelihoods stand."""
        if self.rows is None:
            self.rows = Rows(self)
        rows, langs, scores = self.rows, [], []
        for text in texts:
            found = words(text)
            # Numeric signs like a half are word characters and no letters.
            if not self.langs or not any(c.isalpha() for w in found for c in w):
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.prior.copy()
            for i in range(0, len(found), CHUNK):
                total += rows.sum(found[i:i + CHUNK])
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return langs, scores


class Rows(dict):
    """Places of words in ``table``; a word met for the first time is worked out and added."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.known)
        self.most = max(CHUNK, min(CACHE, CACHE_NUMBERS // max(len(model.langs), 1)))
        self.table = np.zeros((self.base + self.most + CHUNK + 1, len(model.langs)))
        self.table[:self.base] = model.logs[:self.base]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.model.known)
        self.used = self.base

    def __missing__(self, word: str) -> int:
        at = self[word] = self.used
        got = self.model.vector(word)
        self.table[at] = 0.0 if got is None else got
        self.used += 1
        return at

    def sum(self, found: list[str]) -> np.ndarray:
        if self.used > self.base + self.most:
            self.reset()
        return self.table[np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))].sum(0)


def own_words(counts: DataFrame, langs: list[str], most: int) -> Column:
    """Whether a row of ``counts`` (word, lang, n) is among about the ``most`` most frequent words
    of its language. Words of the level of frequency that is cut are chosen by a hash."""
    level = F.floor(F.log2("n") * STEPS).cast("long")
    by = defaultdict(list)
    for r in counts.groupBy("lang", level.alias("level")).count().orderBy("lang", F.desc("level")).collect():
        by[r["lang"]].append((r["level"], r["count"]))
    pairs = []
    for lang in langs:
        left, least, share = most, 0, 1.0
        for at, n in by[lang]:
            least, share = at, min(1.0, left / n)
            left -= n
            if left <= 0:
                break
        pairs += [F.lit(lang), F.struct(F.lit(least).cast("long").alias("least"), F.lit(share).alias("share"))]
    cut = F.create_map(*pairs)[F.col("lang")]
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / float(1 << 20)
    return F.coalesce((level > cut["least"]) | ((level == cut["least"]) & (place < cut["share"])), F.lit(False))


def train(samples: DataFrame) -> Model:
    """Fit on ``samples`` (text, lang); rows without language or text teach nothing.

    Every row is counted. Ties in frequency are broken by spelling, so the model depends on the
    rows alone.
    """
    rows = samples.select("lang", "text").where("lang is not null and text is not null")
    counts = materialise(rows.mapInPandas(count_words, "lang string, word string, n long")
                         .groupBy("word", "lang").agg(F.sum("n").alias("n")))
    docs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r["lang"] for r in docs)
    at = {x: i for i, x in enumerate(langs)}
    if not langs:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    n_docs = np.zeros(len(langs))
    for r in docs:
        n_docs[at[r["lang"]]] = r["count"]
    # Bounded by parameter: at most about twice SPELLED words, one array of counts each.
    by = F.collect_list(F.struct("lang", "n")) if len(langs) > 16 else F.array(*[
        F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs])
    each = counts.withColumn("own", own_words(counts, langs, SPELLED // len(langs))).groupBy("word").agg(
        F.sum("n").alias("n"), by.alias("by"), F.max("own").alias("own"))
    top = each.orderBy(F.desc("n"), "word").limit(SPELLED).collect()
    most = {r["word"] for r in top}
    if len(top) == SPELLED:
        top += sorted((r for r in each.where("own").collect() if r["word"] not in most), key=lambda r: (-r["n"], r["word"]))
    table = {}
    for r in top:
        if len(langs) <= 16:
            table[r["word"]] = np.array(r["by"], dtype=float)
            continue
        v = table[r["word"]] = np.zeros(len(langs))
        for x in r["by"]:
            if x["lang"] in at:
                v[at[x["lang"]]] = x["n"]
    whole = np.zeros(len(langs))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        if r["lang"] in at:
            whole[at[r["lang"]]] = r["n"]
    order = [r["word"] for r in top]
    counts_of = np.array([table[w] for w in order]).reshape(len(order), len(langs))
    room = SMOOTHING * max(len(order), 1)
    known = {w: i for i, w in enumerate(order)}
    logs = [np.log((counts_of + SMOOTHING) / (whole + room))]
    parts: dict[str, int] = {}
    at_row = len(known)
    for n in range(1, LONGEST + 1):
        seen: dict[str, int] = {}
        place, word = [], []
        for i, w in enumerate(order):
            for g in grams(w, n):
                place.append(seen.setdefault(g, len(seen)))
                word.append(i)
        if not seen:
            continue
        sums = np.zeros((len(seen), len(langs)))
        np.add.at(sums, np.array(place), np.log1p(counts_of)[np.array(word)])
        # The most frequent ones; ties keep the order of the words they come from.
        best = np.argsort(-sums.sum(1), kind="stable")[:GRAMS]
        names = list(seen)
        parts.update({names[j]: at_row + k for k, j in enumerate(best)})
        logs.append(np.log((sums[best] + SMOOTHING) / (sums.sum(0) + SMOOTHING * len(seen))))
        at_row += len(best)
    return Model(langs, np.log((n_docs + 1) / (n_docs.sum() + len(langs))), known, parts, np.concatenate(logs))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row; ``und`` where the text is null or has no letter."""
    return add_by_text(docs, key, text, model.predict, "lang_pred string, score double")
