"""Similarity join of texts on word n-grams by MinHash banding.

Texts with equal n-gram sets form a class and are represented once. Each class gets a MinHash
signature in bands; classes that share a band are candidates; candidates are verified on their full
n-gram sets. A pair is verified in the first band that it shares and in no other. A bucket with many
classes is cut into blocks and every pair of blocks is a unit of work of its own, so no group is
gathered whole. Pairs are never emitted: a unit of work returns how many links each member has and
a spanning forest, both no longer than its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import components
from fieldspark.llm.ngram_lm import Hashes
from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
HASHES = 128        # MinHash functions at most
BLOCK = 512         # classes of a bucket that are compared at once
SLOT_ROWS, SLOT_BYTES = 20_000, 16 << 20
CHUNK = 2048
MARKS = 1 << 27     # bits of the filter of texts that are read again
SEED = 20


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest false candidates, with which a pair
    of this similarity shares a band with at least this probability."""
    best = None
    for rows in range(1, hashes + 1):
        p = similarity ** rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("not enough hash functions for this recall")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def shingles(text: str | None, table: Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, a blank one none."""
    found = text.split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((table[w.encode("utf-8", "surrogatepass")] for w in found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        k = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for i in range(n):
            k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(k)


class Signer:
    def __init__(self, bands: int, rows: int):
        r = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        """One 64-bit number per band."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(shingle), CHUNK):
                low = np.minimum(low, (shingle[i:i + CHUNK, None] * self.a + self.b).min(0))
            low = low.reshape(self.bands, self.rows)
            out = np.arange(self.bands, dtype=np.uint64)
            for j in range(self.rows):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
        return out.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(id, tk, cls, n, bands): id and text key of every row, its n-gram set by hash, signature."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sign = Hashes(), Signer(bands, rows)
        for frame in batches:
            cls, n, sig = [], [], []
            for text in frame["text"]:
                s = shingles(text, table, words)
                cls.append(xxhash.xxh128_digest(s.tobytes()))
                n.append(len(s))
                sig.append(sign(s).tolist() if len(s) else [])
            yield pd.DataFrame({"id": frame["id"], "tk": frame["tk"], "cls": cls, "n": n, "bands": sig})

    rows_ = docs.select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("tk"), "text")
    return rows_.mapInPandas(run, "id string, tk long, cls binary, n long, bands array<long>")


def dealt(members: DataFrame, block: int) -> DataFrame:
    """Rows of buckets copied to their units of work (band, h, i, j): one for each block of the
    bucket that the member's own block meets, itself included."""
    blocks = F.ceil(F.col("m") / block)
    own = F.pmod(F.xxhash64("cid", F.lit(SEED)), blocks)
    cut = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "m")


def units(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The units of work in a slot."""
    frame = frame.sort_values(["band", "h", "i", "j", "own", "cid"], ignore_index=True)
    key = frame[["band", "h", "i", "j"]].to_numpy()
    edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(frame) else []
    for a, b in zip(edges, [*edges[1:], len(frame)]):
        yield frame.iloc[a:b]


def open_pairs(unit: pd.DataFrame, sig: np.ndarray, x: int) -> np.ndarray:
    """Members after ``x`` that this unit has to compare it with: those of the other block, or the
    later ones of its own, that share no earlier band with it."""
    band, own = int(unit["band"].iloc[0]), unit["own"].to_numpy()
    i, j = int(unit["i"].iloc[0]), int(unit["j"].iloc[0])
    if i == j:
        ok = np.arange(len(unit)) > x
    else:
        ok = (own == j) if own[x] == i else np.zeros(len(unit), dtype=bool)
    if band:
        ok &= ~(sig[:, :band] == sig[x, :band]).any(1)
    return ok


def useful(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a slot that have anything to compare in their unit."""
    keep = []
    for unit in units(frame):
        sig = np.stack(unit["bands"])
        mark = np.zeros(len(unit), dtype=bool)
        for x in range(len(unit)):
            ok = open_pairs(unit, sig, x)
            if ok.any():
                mark |= ok
                mark[x] = True
        keep.append(unit[mark])
    out = pd.concat(keep) if keep else frame
    return out[["band", "h", "i", "j", "own", "cid", "n"]]


def verified(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for unit in units(frame.drop_duplicates(["band", "h", "i", "j", "own", "cid"])):
            sig, cid, size = np.stack(unit["bands"]), unit["cid"].to_numpy(), unit["size"].to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in unit["set"]]
            n = np.array([len(s) for s in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.cumsum(n) - n
            flag = np.zeros(int(flat.max()) + 1, dtype=bool)
            links, parent = np.zeros(len(unit), dtype=np.int64), list(range(len(unit)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x in range(len(unit)):
                ok = open_pairs(unit, sig, x)
                if not ok.any():
                    continue
                mine = flat[start[x]:start[x] + n[x]]
                flag[mine] = True
                both = np.add.reduceat(flag[flat], start)
                flag[mine] = False
                hit = np.flatnonzero(ok & (both >= similarity * (n + n[x] - both) - 1e-9))
                links[x] += size[hit].sum()
                links[hit] += size[x]
                for y in hit:
                    p, q = root(x), root(int(y))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((0, int(cid[x]), int(cid[y])))
            out += [(1, int(c), int(k)) for c, k in zip(cid, links) if k]
        return pd.DataFrame(out, columns=["kind", "a", "b"])
    return run


def places(tk: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = tk.view(np.uint64)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def marked(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``tk``, of at most ``MARKS`` bits. It only spares work: what it
    lets through is joined exactly."""
    bits = 1 << min(MARKS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
    low = F.col("tk").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("tk", 32).bitwiseAND(F.lit(bits - 1))
    at = keys.select(F.explode(F.array(low, high)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def maybe(tk: np.ndarray, marks: np.ndarray) -> np.ndarray:
    ok = np.ones(len(tk), dtype=bool)
    for p in places(tk.astype(np.int64), 64 * len(marks)):
        ok &= (marks[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
         recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes and their members.

    Members: (id, tk, cls) for every row, id as text and tk the hash of its text. Classes: (cls,
    size, id, tk, component, others, first_id, first_tk): the least row of the class, the number of
    rows of other classes linked to each of its rows, and the least row of its component. Null ids
    come last. Blank and null texts are one class, linked with nothing else.
    """
    bands, rows = bands_for(similarity, recall)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    staged = materialise(signed(texts, bands, rows, words))
    kind = docs.schema[key].dataType.simpleString()
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(kind).alias("id"), F.col("tk").alias("tk"))
    classes = materialise(staged.groupBy("cls").agg(
        F.count(F.lit(1)).alias("size"), F.min(order).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()))
    slim = classes.select("cid", F.posexplode("bands").alias("band", "h"))
    shared = slim.groupBy("band", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(slim.join(shared, ["band", "h"]))
    # Only the bands before a unit's own are read there.
    earlier = F.slice("bands", F.lit(1), F.col("band"))
    copies = dealt(members.join(classes.select("cid", "n", "bands"), "cid").withColumn("bands", earlier), block)
    dealt_rows = members.agg(F.sum(F.ceil(F.col("m") / block))).first()[0] or 0
    slots = max(1, math.ceil(dealt_rows / SLOT_ROWS))
    slot = F.pmod(F.xxhash64("band", "h", "i", "j"), F.lit(slots))
    wanted = materialise(copies.withColumn("slot", slot).groupBy("slot").applyInPandas(
        useful, "band int, h long, i long, j long, own long, cid long, n long"))
    need = wanted.select("cid").distinct().join(classes.select("cid", "least"), "cid").select(
        "cid", F.col("least.id").alias("id"), F.col("least.tk").alias("tk"))

    need = materialise(need)
    marks = marked(need)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Hashes()
        for frame in batches:
            frame = frame[maybe(frame["tk"].to_numpy(), marks)]
            yield pd.DataFrame({"id": frame["id"], "tk": frame["tk"], "set": [shingles(t, table, words).tobytes() for t in frame["text"]]})

    # Texts do not move: what is not among the marks is dropped where it is read.
    found = (texts.select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("tk"), "text")
             .mapInPandas(sets, "id string, tk long, set binary"))
    need = need.withColumn("id", F.col("id").cast("string"))
    full = null_safe_join(found, need, ["id", "tk"]).select("cid", "set").join(classes.select("cid", "size", "bands"), "cid")
    size = wanted.agg(F.sum("n")).first()[0] or 0
    slots = max(1, math.ceil(8 * size / SLOT_BYTES))
    slot = F.pmod(F.xxhash64("band", "h", "i", "j"), F.lit(slots))
    edges = materialise(wanted.drop("n").join(full, "cid").withColumn("bands", earlier).withColumn("slot", slot).groupBy("slot").applyInPandas(
        verified(similarity), "kind int, a long, b long"))
    groups = components(edges.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = edges.where("kind = 1").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    flat = (classes.select("cid", "cls", "size", "least").join(counts, "cid", "left")
            .join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left")
            .withColumn("component", F.coalesce("component", "cid")))
    flat = materialise(flat)
    firsts = flat.groupBy("component").agg(F.min("least").alias("first"))
    out = flat.join(firsts, "component").select(
        "cls", "size", F.col("least.id").alias("id"), F.col("least.tk").alias("tk"), "component",
        F.coalesce("others", F.lit(0)).alias("others"), F.col("first.id").alias("first_id"), F.col("first.tk").alias("first_tk"))
    return materialise(out), staged.select(F.col("id").cast(kind).alias("id"), "tk", "cls")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, class_id, component_id, n_links, kept) of every row: the least key of its class and of
    its component, how many other rows link to it directly, and whether it is the component's
    least row. Rows equal to that one in key and text are all marked kept."""
    classes, members = join(docs, key, text, **how)
    out = members.select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), "cls").join(classes, "cls")
    return out.select(F.col("_id").alias(key), F.col("id").alias("class_id"), F.col("first_id").alias("component_id"),
                      (F.col("size") - 1 + F.col("others")).cast("long").alias("n_links"),
                      (F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_tk") == F.col("first_tk"))).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs``, all columns, with one row of each component: its least in key and text.

    Rows that stay do not move. Those that go, and those that share key and text with another row,
    are marked in a bounded filter; what it catches is joined exactly.
    """
    classes, members = join(docs, key, text, **how)
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tk") == F.col("first_tk"))
    seen = members.join(classes.select("cls", "first_id", "first_tk"), "cls").groupBy("id", "tk").agg(
        F.count(F.lit(1)).alias("n"), F.first(stays).alias("_stays")).where("n > 1 OR NOT _stays")
    doubtful = materialise(seen.select(F.col("id").alias("_f_id"), F.col("tk").alias("_f_tk"), "_stays"))
    marks = marked(doubtful.select(F.xxhash64("_f_id", "_f_tk").alias("tk")))
    rows = docs.withColumns({"_f_id": F.col(key), "_f_tk": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    rows = rows.withColumn("_f_mark", F.xxhash64("_f_id", "_f_tk"))

    def those(caught: bool) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                at = batch.schema.get_field_index("_f_mark")
                hit = maybe(batch.column(at).to_numpy(zero_copy_only=False), marks)
                yield batch.filter(pa.array(hit == caught))
        return rows.mapInArrow(run, rows.schema)

    exact = null_safe_join(those(True), doubtful, ["_f_id", "_f_tk"], "left").where(F.coalesce("_stays", F.lit(True)))
    return those(False).select(*docs.columns).unionByName(
        exact.dropDuplicates(["_f_id", "_f_tk"]).select(*docs.columns))
