"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (one word each), prefix voters (how a word begins, which
catches inflected and joined forms) and fixed patterns. A generative label model estimates from
their votes alone how accurate each one is and which of them say the same thing, takes the
annotators' labels as one more voter, and gives every training text a posterior. A linear
classifier on the votes is trained on those posteriors and scores every text.

Lexicon and prefixes are mined from counts over all labelled rows: keys of toxic rows first, then
those of them that are frequent enough in the others. The label model and the
classifier are fitted on at most about ``FIT_ROWS`` of them, drawn per class, toxic rows first, and
weighted so that each class stands for all its rows; scores cover all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import add_by_text
from fieldspark.llm.ngram_join import marked as ids_marked
from fieldspark.llm.ngram_join import maybe
from fieldspark.sources.stage import materialise

FIT_ROWS = 20_000
VOTERS = 240        # mined voters at most
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_ROWS = 3      # toxic rows that a mined voter must be seen in
PRECISE = 0.6       # smoothed share of toxic rows among the rows it is seen in
ROUNDS = 25
FLUSH = 300_000
MARKS = 1 << 26     # bits of the filter of keys that toxic rows hold
TABLE = 200_000     # words that a task remembers
WORD = re.compile(r"[^\W\d_]+")
# A small public lexicon and patterns that vote without any training.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown", "dumb", "imbecile")
PATTERNS = {
    "address": re.compile(r"\byou(?:'re| are)? (?:an? )?(?:%s)s?\b" % "|".join(SEEDS)),
    "wish": re.compile(r"\b(?:shut up|go to hell|drop dead|kill yourself|get lost)\b"),
    "masked": re.compile(r"\b[a-z]\*{2,}[a-z]?\b"),
    "shouting": re.compile(r"\b(?:[A-Z]{4,}\s+){3,}[A-Z]{4,}!"),
}
# What a text has to hold for a pattern to be tried; all but the last look at it in lower case.
NEEDS = {"address": ("you",), "wish": ("shut up", "go to hell", "drop dead", "kill yourself", "get lost"), "masked": ("**",), "shouting": ("!",)}
LEET = str.maketrans("013457@$", "oieastas")
ODD, LETTER = re.compile("[013457@$]"), re.compile("[a-z]")


def keys_of(word: str) -> list[str]:
    """What the mined voters can look for in a word: itself and its beginnings."""
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


class Known(dict):
    """Word to its keys, those that pass ``test``; forgets all when it grows too large."""

    def __init__(self, test=None):
        self.test = test

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= TABLE:
            self.clear()
        got = self[word] = [k for k in keys_of(word) if self.test is None or self.test(k)]
        return got


def place(key: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(key) & (bits - 1)


def count_keys(marks: np.ndarray | None = None):
    """mapInPandas function: (key, n) rows of ``text`` that hold the key, of those keys that are
    among ``marks`` if given."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = 8 * len(marks) if marks is not None else 0
        raw = marks.tobytes() if bits else b""

        def test(key: str) -> bool:
            p = place(key, bits)
            return raw[p >> 3] >> (p & 7) & 1 == 1

        known, seen = Known(test if bits else None), Counter()
        for frame in batches:
            for text in frame["text"]:
                if text:
                    seen.update({k for w in set(WORD.findall(text.lower())) for k in known[w]})
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})
    return run


def marked(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, at most ``MARKS``. They only spare work: what passes without being
    among the keys is dropped when the counts are joined."""
    bits = 1 << min(MARKS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            at = np.fromiter((place(k, bits) for k in frame["key"]), dtype=np.int64, count=len(frame))
            w, first = np.unique(np.sort(at) >> 6, return_index=True)
            if len(w):
                ones = np.uint64(1) << (np.sort(at) & 63).astype(np.uint64)
                yield pd.DataFrame({"w": w, "b": np.bitwise_or.reduceat(ones, first).view(np.int64)})

    got = keys.select("key").mapInPandas(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype="<i8")
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


class Votes:
    """Which voters fire on a text: mined keys, then seeds, then patterns, then a masked lexicon."""

    def __init__(self, mined: list[str]):
        self.mined = mined
        self.names = [*mined, *(f"seed:{s}" for s in SEEDS), *PATTERNS, "leet"]
        at = {k: i for i, k in enumerate(mined)}
        base = len(mined)
        seeds = {s: base + i for i, s in enumerate(SEEDS)}
        self.leet, self.seeds = len(self.names) - 1, set(SEEDS)
        self.patterns = [(base + len(SEEDS) + i, n != "shouting", NEEDS[n], p) for i, (n, p) in enumerate(PATTERNS.items())]

        class Voters(dict):
            def __missing__(self, word: str) -> list[int]:
                if len(self) >= TABLE:
                    self.clear()
                got = self[word] = [at[k] for k in keys_of(word) if k in at] + [seeds[w] for w in (word,) if w in seeds]
                return got

        self.by_word = Voters

    def __getstate__(self):
        return {"mined": self.mined}

    def __setstate__(self, state):
        self.__init__(state["mined"])

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        if isinstance(self.by_word, type):
            self.by_word = self.by_word()
        low, known = text.lower(), self.by_word
        out = {i for w in set(WORD.findall(low)) for i in known[w]}
        for i, lower, needs, pattern in self.patterns:
            where = low if lower else text
            if any(n in where for n in needs) and pattern.search(where):
                out.add(i)
        odd = {w.translate(LEET) for w in low.split() if not w.isalpha() and ODD.search(w) and LETTER.search(w)}
        if odd & self.seeds:
            out.add(self.leet)
        return sorted(out)


def label_model(hits: np.ndarray, gold: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and weight of each voter.

    ``hits`` is rows x voters (0 or 1), ``gold`` the annotators' votes, ``n`` how many texts a row
    stands for. Expectation-maximisation
    over a two-class model; a voter's evidence is divided by how much it correlates, given the
    class, with the others, so that voters which repeat each other count about once.
    """
    v = np.column_stack([hits, gold]).astype(float)
    q = 0.05 + 0.9 * gold.astype(float)
    weight = np.ones(v.shape[1])
    every = 0.5 * (n @ v) / n.sum()
    for r in range(rounds):
        q1, q0 = n * q, n * (1 - q)
        prior = np.clip(q1.sum() / n.sum(), 1e-3, 1 - 1e-3)
        n1, n0 = q1.sum() + 1.0, q0.sum() + 1.0
        # One imagined row per class keeps rates inside (0, 1).
        a = np.clip((q1 @ v + every) / n1, 1e-5, 1 - 1e-5)
        b = np.clip((q0 @ v + every) / n0, 1e-5, 1 - 1e-5)
        if r in (1, 6):
            mean = np.outer(q, a) + np.outer(1 - q, b)
            rest = v - mean
            cov = (rest * n[:, None]).T @ rest / n.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = np.abs(cov / np.outer(sd, sd))
            np.fill_diagonal(corr, 1.0)
            corr[corr < 0.1] = 0.0
            weight = 1.0 / corr.sum(1)
            weight[-1] = 1.0
        on, off = weight * np.log(a / b), weight * np.log((1 - a) / (1 - b))
        z = np.log(prior / (1 - prior)) + v @ (on - off) + off.sum()
        q = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    return q, weight[:-1]


def linear(hits: np.ndarray, soft: np.ndarray, n: np.ndarray, ridge: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Logistic regression with soft labels by Newton steps; the intercept comes last."""
    x = np.column_stack([hits.astype(float), np.ones(len(hits))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - soft)) + penalty * w
        h = (x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, votes: Votes, weights: np.ndarray):
        self.votes, self.weights = votes, weights

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in self.votes.of(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


class Samples:
    """Labelled texts: (text, toxic) in one frame."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.where("toxic is not null").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))

    def sizes(self) -> dict[int, int]:
        return {r["toxic"]: r["count"] for r in self.rows.groupBy("toxic").count().collect()}

    def texts(self, kind: int, share: float = 1.0) -> DataFrame:
        """Texts of a class, or the part of them whose hash is below ``share``."""
        return drawn(self.rows.where(F.col("toxic") == kind), share).select("text")

    def counts(self, kind: int, marks: np.ndarray | None = None) -> DataFrame:
        """(key, n): texts of a class that hold the key."""
        return total(self.texts(kind), marks)


class Joined(Samples):
    """Labelled texts whose labels are in another table, (key, text) and (key, toxic), one row per key.

    Texts stay where they are read: a bounded Bloom filter of a class's keys lets its rows through
    and few others. Where texts are few, they are joined with the labels after that. Counts over a
    large class are taken over all rows let through; those let through wrongly are found by their
    keys alone, and what they hold is taken off again.
    """

    def __init__(self, docs: DataFrame, marks: DataFrame):
        self.docs = docs.where("key is not null").select(F.xxhash64("key").alias("tk"), "key", F.coalesce("text", F.lit("")).alias("text"))
        marks = materialise(marks.select("key", F.col("toxic").cast("int").alias("toxic")).where("key is not null and toxic is not null"))
        self.marks = {k: marks.where(F.col("toxic") == k).select("key") for k in (0, 1)}
        self.filters = {k: ids_marked(m.select(F.xxhash64("key").alias("tk"))) for k, m in self.marks.items()}

    def sizes(self) -> dict[int, int]:
        return {k: self.docs.select("key").join(m, "key").count() for k, m in self.marks.items()}

    def near(self, rows: DataFrame, marks: np.ndarray) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                yield batch.filter(pa.array(maybe(batch.column(0).to_numpy(zero_copy_only=False), marks)))
        return rows.mapInArrow(run, rows.schema)

    def texts(self, kind: int, share: float = 1.0) -> DataFrame:
        return self.near(drawn(self.docs, share), self.filters[kind]).join(self.marks[kind], "key").select("text")

    def counts(self, kind: int, marks: np.ndarray | None = None) -> DataFrame:
        through = total(self.near(self.docs, self.filters[kind]), marks)
        wrong = materialise(self.near(self.docs.select("tk", "key"), self.filters[kind]).join(self.marks[kind], "key", "left_anti").distinct())
        if wrong.isEmpty():
            return through
        off = total(self.near(self.docs, ids_marked(wrong)).join(wrong.select("key"), "key"), marks).withColumn("n", -F.col("n"))
        return through.union(off).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


def drawn(rows: DataFrame, share: float) -> DataFrame:
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    return rows if share >= 1 else rows.where(at < share)


def total(rows: DataFrame, marks: np.ndarray | None) -> DataFrame:
    return rows.select("text").mapInPandas(count_keys(marks), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(samples: DataFrame | Samples, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``samples``, one row (text, toxic) per labelled text; rows without a label teach
    nothing, null texts count as empty. Without both classes only the seeds speak.
    """
    rows = samples if isinstance(samples, Samples) else Samples(samples)
    sizes = rows.sizes()
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        votes = Votes([])
        return Model(votes, np.array([4.0] * len(votes.names) + [-3.0]))
    # Toxic texts are the fewer; of the others only keys that toxic texts hold are counted.
    toxic = materialise(total(rows.texts(1), None).withColumnRenamed("n", "t").where(F.col("t") >= LEAST_ROWS))
    clean = rows.counts(0, marked(toxic)).withColumnRenamed("n", "c")
    counts = materialise(toxic.join(clean, "key", "left").na.fill(0, ["c"]))
    ratio = n1 / n0
    precise = (F.col("t") + 0.5 * ratio) / (F.col("t") + F.col("c") + 0.5)
    # Mutual evidence of a key: rows it explains times how pure it is; the longer key loses a tie.
    gain = F.col("t") * F.ln(precise / (n1 / (n1 + n0)))
    best = (counts.where(precise >= PRECISE).orderBy(gain.desc(), F.length("key"), "key").limit(4 * VOTERS).collect())
    mined: list[str] = []
    for r in best:
        k = r["key"]
        # A word that a chosen beginning already covers adds nothing.
        if any(k[2:].startswith(m[2:]) for m in mined if m[:2] != "w:"):
            continue
        mined.append(k)
        if len(mined) == VOTERS:
            break
    votes = Votes(mined)

    def fired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"on": [votes.of(t) for t in frame["text"]]})

    def votes_of(kind: int, share: float) -> list[tuple]:
        """Rows with equal votes are one row with a count."""
        got = rows.texts(kind, share).mapInPandas(fired, "on array<int>").groupBy("on").count().collect()
        # Where a few texts are copied many times, none of them may be drawn.
        return [(kind, r["on"], r["count"]) for r in got] if got or share >= 1 else votes_of(kind, 1.0)

    # Half of the rows at least are the toxic ones', or all of those where they are fewer.
    k1 = min(n1, max(fit_rows // 2, fit_rows - n0))
    got = votes_of(1, k1 / n1) + votes_of(0, min(1.0, (fit_rows - k1) / n0))
    held = Counter()
    for kind, _, count in got:
        held[kind] += count
    n = np.array([count * (sizes[kind] / held[kind]) for kind, _, count in got])
    hits = np.zeros((len(got), len(votes.names)))
    for i, (_, on, _) in enumerate(got):
        hits[i, on] = 1.0
    gold = np.array([kind for kind, _, _ in got])
    order = np.lexsort((gold, *hits.T))
    hits, gold, n = hits[order], gold[order], n[order]
    soft, _ = label_model(hits, gold, n)
    return Model(votes, linear(hits, soft, n))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, null and empty texts included."""
    return add_by_text(docs, key, text, lambda texts: ([model.score(t) for t in texts],), "score double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``cut``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([model.score(t.as_py()) < cut for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
