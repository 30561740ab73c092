"""Near-duplicate vectors by a cover tree traversed against itself.

The tree's nodes come from a bounded sample of distinct directions: nested levels whose radii halve,
every point of a level within that level's radius of its parent. Every vector, not just the
sample, descends to a node, and each node's covering radius is measured over all vectors under it.
Two nodes can hold a linked pair only if the distance of their centres is at most the linking
distance plus both covering radii; all other pairs of nodes are pruned. What is left is compared
exactly, in double precision, block against block.

Where no bound prunes, as for points spread evenly in many dimensions, every pair of blocks is
compared, which takes time in the square of the number of distinct vectors. Memory stays bounded by
two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import components
from fieldspark.sources.stage import materialise

COSINE = 0.9
SAMPLE = 4096       # directions that the tree is built from
NODES = 512         # leaves at most
LEVELS = 6          # radii 2, 1, 1/2, ... on the unit sphere
BLOCK = 8192        # vectors of a block
ROWS = 512          # rows multiplied at a time
SLACK = 1e-9        # of distances, against rounding; the exact test decides


class Tree:
    """Nested levels of centres. ``levels[i]`` has (centres, parent of each)."""

    def __init__(self, points: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(points):
            return
        centres, parents = points[:1], np.zeros(1, dtype=np.int64)
        self.levels.append((centres, parents))
        for i in range(1, LEVELS):
            radius = 2.0 / (1 << (i - 1))
            above = self.levels[-1][0]
            # Nesting: every centre stays a centre, and is its own parent.
            chosen = list(range(len(above)))
            picked, up = [*above], [*chosen]
            gap = np.full(len(points), np.inf)
            for c in above:
                gap = np.minimum(gap, dist(points, c))
            while len(picked) < NODES and gap.max() > radius / 2:
                far = int(np.argmax(gap))
                p = points[far]
                up.append(int(np.argmin(dist(above, p))))
                picked.append(p)
                gap = np.minimum(gap, dist(points, p))
            self.levels.append((np.array(picked), np.array(up)))
            if len(picked) >= NODES:
                break

    def leaves(self) -> np.ndarray:
        return self.levels[-1][0] if self.levels else np.zeros((0, 1))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``: at every level the nearest child of the node it is at."""
        at = np.zeros(len(x), dtype=np.int64)
        for centres, parents in self.levels[1:]:
            near = x @ centres.T
            near[parents[None, :] != at[:, None]] = -np.inf
            at = np.argmax(near, axis=1)
        return at


def dist(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(1), 0.0))


def chord(cosine: float) -> float:
    """Distance on the unit sphere at a cosine."""
    return float(np.sqrt(max(2.0 - 2.0 * cosine, 0.0)))


def unit(vectors: pd.Series) -> tuple[np.ndarray, list[int]]:
    """Unit vectors, and the places they come from; null, zero and non-finite ones are left out."""
    rows, at = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        a = np.array([np.nan if x is None else x for x in v], dtype=np.float64)
        norm = np.sqrt(a @ a) if np.isfinite(a).all() else 0.0
        if norm > 0 and np.isfinite(norm):
            rows.append(a / norm)
            at.append(i)
        elif np.isfinite(a).all() and np.abs(a).max(initial=0) > 0:
            a = a / np.abs(a).max()
            rows.append(a / np.sqrt(a @ a))
            at.append(i)
    return rows, at


def directions(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dims, unit) of the usable vectors; ``unit`` holds doubles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows, at = unit(frame["vector"])
            yield pd.DataFrame({"id": frame["id"].to_numpy()[at] if at else np.zeros(0, dtype=np.int64),
                                "dims": [len(r) for r in rows], "unit": [r.tobytes() for r in rows]})

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
    return rows.mapInPandas(run, "id long, dims int, unit binary")


def near_links(classes: DataFrame, cosine: float, tree: Tree, block: int) -> DataFrame:
    """(kind, a, b): kind 0 links two ids of a spanning forest, kind 1 gives ``b`` links of ``a``.

    ``classes`` has (id, size, unit) of one dimension: distinct directions and how many vectors
    share each.
    """
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = tree.leaves()
        for frame in batches:
            if len(frame):
                x = np.frombuffer(b"".join(frame["unit"])).reshape(len(frame), -1)
                node = tree.descend(x)
                yield frame.assign(node=node, far=np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, leaves[node]), 0)))

    held = materialise(classes.mapInPandas(placed, "id long, size long, unit binary, node long, far double"))
    # One row per node, of which there are at most NODES.
    nodes = held.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("node").collect()
    many = len(tree.leaves())
    radius, count = np.full(many, -1.0), np.zeros(many, dtype=np.int64)
    for r in nodes:
        radius[r["node"]], count[r["node"]] = r["radius"], r["n"]
    centres = tree.leaves()
    gap = np.sqrt(np.maximum(2 - 2 * np.clip(centres @ centres.T, -1, 1), 0))
    meets = gap <= chord(cosine) + radius[:, None] + radius[None, :] + SLACK + 1e-7
    meets &= (radius[:, None] >= 0) & (radius[None, :] >= 0)
    # Blocks of about ``block`` vectors: small nodes share one, large ones are dealt over several.
    first, parts, fill, serial = np.zeros(many, dtype=np.int64), np.ones(many, dtype=np.int64), 0, 0
    for i in range(many):
        if count[i] > block:
            serial += fill > 0
            parts[i] = -(-count[i] // block)
            first[i], serial, fill = serial, serial + parts[i], 0
        else:
            if fill + count[i] > block:
                serial, fill = serial + 1, 0
            first[i] = serial
            fill += count[i]
    total = int(serial + (fill > 0))
    owners: list[list[int]] = [[] for _ in range(total)]
    for i in range(many):
        for b in range(first[i], first[i] + parts[i]):
            if count[i] and b < total:
                owners[b].append(i)
    row = {i: np.flatnonzero(meets[i]) for i in range(many)}
    partners: list[list[int]] = []
    for b in range(total):
        near = {o for i in owners[b] for j in row[i] for o in range(first[j], first[j] + parts[j])}
        partners.append(sorted(near))
    low = {(min(b, o), max(b, o)) for b in range(total) for o in partners[b]}
    by_block = {b: sorted({p for p in low if b in p}) for b in range(total)} if total <= 64 else None

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            split = pd.util.hash_array(frame["id"].to_numpy().astype(np.int64)) % parts[frame["node"]].astype(np.uint64)
            yield frame.assign(block=first[frame["node"]] + split.astype(np.int64))

    def bundle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node", "id"])
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "ids": [frame["id"].tolist()], "sizes": [frame["size"].tolist()],
                             "nodes": [frame["node"].tolist()], "units": [b"".join(frame["unit"])]})

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.to_dict("records"):
                b = r["block"]
                for i, j in (by_block[b] if by_block is not None else sorted((min(b, o), max(b, o)) for o in partners[b])):
                    yield pd.DataFrame([{"i": i, "j": j, **r}])

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        rows = {r["block"]: r for r in frame.to_dict("records")}
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        a, b = opened_block(rows[i]), opened_block(rows[j])
        return links(a, b, i == j, cosine, meets)

    layout = "block long, ids array<long>, sizes array<long>, nodes array<long>, units binary"
    bundles = (held.mapInPandas(dealt, "id long, size long, unit binary, node long, far double, block long")
               .groupBy("block").applyInPandas(bundle, layout))
    return (bundles.mapInPandas(copies, "i long, j long, " + layout)
            .groupBy("i", "j").applyInPandas(compared, "kind int, a long, b long"))


def opened_block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(r["ids"], dtype=np.int64)
    return ids, np.asarray(r["sizes"], dtype=np.int64), np.asarray(r["nodes"], dtype=np.int64), np.frombuffer(r["units"]).reshape(len(ids), -1)


def links(a, b, same: bool, cosine: float, meets: np.ndarray) -> pd.DataFrame:
    """Counts and a spanning forest of the links between two blocks, or within one."""
    (ida, sa, na, xa), (idb, sb, nb, xb) = a, b
    count: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for at in range(0, len(ida), ROWS):
        part = slice(at, at + ROWS)
        # Only columns of nodes that some row's node can meet.
        live = np.flatnonzero(meets[np.unique(na[part])].any(0)[nb])
        if not len(live):
            continue
        near = xa[part] @ xb[live].T if len(live) < len(idb) else xa[part] @ xb.T
        r, c = np.nonzero(near >= cosine)
        r, c = r + at, live[c]
        if same:
            keep = r < c
            r, c = r[keep], c[keep]
        for x, n in ((r, sb[c]), (c, sa[r])):
            ids = ida if x is r else idb
            sums = np.bincount(x, weights=n, minlength=len(ids))
            for k in np.flatnonzero(sums):
                count[int(ids[k])] = count.get(int(ids[k]), 0) + int(sums[k])
        for u, v in zip(ida[r].tolist(), idb[c].tolist()):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
                tree.append((0, u, v))
    return pd.DataFrame(tree + [(1, k, n) for k, n in count.items()], columns=["kind", "a", "b"])


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing.
    Vectors of different lengths never link. Equal directions are compared once and counted by how
    many share them. A null key has no links; keys that repeat count as one vector each but share
    their row's result.
    """
    spark = vectors.sparkSession
    units = materialise(directions(vectors, key, vector))
    same = units.groupBy("dims", "unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialise(same)
    members = units.join(classes, ["dims", "unit"]).select("id", "rep", "size")
    found = None
    for d in sorted(r["dims"] for r in classes.select("dims").distinct().collect()):
        one = classes.where(F.col("dims") == d).select(F.col("rep").alias("id"), "size", "unit")
        sample = one.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("unit").toPandas()["unit"]
        tree = Tree(np.array([np.frombuffer(u) for u in sample]))
        part = near_links(one, cosine, tree, block)
        found = part if found is None else found.union(part)
    found = materialise(found if found is not None else spark.createDataFrame([], "kind int, a long, b long"))
    groups = components(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    by_id = (members.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
             .select("id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")).groupBy("id")
             .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    out = vectors.select(F.col(key).alias("_key")).join(by_id, F.col("_key") == F.col("id"), "left")
    component = F.coalesce("component_id", F.col("_key").cast("long"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"))
