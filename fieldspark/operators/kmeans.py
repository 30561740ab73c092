"""Many k-means fits in one chain of jobs.

All fits (cluster counts, seeds, starts) advance together: each scan of the points updates every fit
that has not settled, and a task sends one row of sums per lane of fits, whatever the number of
points. After the first rounds few points change their centre, so the numbers of all points' centres
are held from some round on, and a scan sums the points that have changed since. So the number of jobs depends on the greatest cluster count and on how long the slowest fit
takes, not on how many fits there are; what the driver holds is the centres. Points are dealt over
all cores once, as their file may be too small for Spark to split while the work on it is not.

Starts are drawn by squared distance, exactly and in parallel: every point races with an exponential
time divided by its squared distance to the nearest centre so far, and the first one wins. Times are
hashes of (key, seed, start, step), so neither partitions nor retries change a result. They do not
depend on the cluster count, so the starts of a smaller count are the first of a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.sources.stage import materialise

ROUNDS = 300
SETTLED = 1e-10     # largest move of a centre, relative to its size, in a fit that has settled
CELLS = 1 << 18     # points x fits that a task holds at once
CODES = 1 << 22     # the same where only the centres' numbers are held
LANE = 16           # fits whose sums travel as one row
TILE, STRIP = 100, 512      # fits and points whose distances are found at once
PAIRS = 1024        # pairs of point and fit that are decided in double precision at once
FIRST = 4           # rounds in which too many points change their centre to keep it
STALE = 1 / 20      # share of pairs that have changed, from which the centres are kept anew


def uniform(h: np.ndarray, stream: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) by hash of row and stream."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64) + (np.asarray(stream, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest centre and its number (the first of equals), points x fits."""
    least = own = None
    for j in range(centres.shape[1]):
        c = centres[:, j]
        far = x @ (-2.0 * c.T)
        far += (c * c).sum(1)
        if least is None:
            least, own = far, np.zeros(far.shape, np.int16)
        else:
            np.copyto(own, j, where=far < least)
            np.minimum(least, far, out=least)
    least += (x * x).sum(1)[:, None]
    return np.maximum(least, 0.0, out=least), own


class Screen:
    """Numbers of the nearest centres of a group of fits, found in single precision.

    A number is written as ``base`` + number. Distances are taken less the one to the last centre,
    which leaves a product of points and centres. Where single precision can't tell the nearest
    centre from another one, by a bound on its error, the sum of theirs is not the code of any: such
    pairs of point and fit are decided in double precision.
    """

    def __init__(self, centres: np.ndarray, base: int, kind: type):
        self.centres, self.base, self.kind = centres, base, kind
        fits, self.k, d = centres.shape
        square = (centres * centres).sum(2)
        way, rise = centres[:, :-1] - centres[:, -1:], square[:, :-1] - square[:, -1:]
        error = 2.5 * (d + 6) * 2.0 ** -24
        with np.errstate(over="ignore"):
            self.by_length, self.always = (
                (error * np.abs(v).max(1, initial=1e-30)).astype(np.float32) for v in (2.0 * np.sqrt((way * way).sum(2)), rise))
            # (number of the centre, fit, column), for a tile of fits after the other
            table = np.concatenate([-2.0 * way, rise[..., None]], axis=2).transpose(1, 0, 2).astype(np.float32)
            self.tiles = [(slice(lo, lo + TILE), np.ascontiguousarray(table[:, lo:lo + TILE])) for lo in range(0, fits, TILE)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Fits x points; the pairs that are not told apart hold no code of a centre."""
        out = np.zeros((len(self.centres), len(x)), self.kind)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((x * x).sum(1)).astype(np.float32)
            points = np.ascontiguousarray(np.hstack([x, np.ones((len(x), 1))]).astype(np.float32).T)
            for at, table in self.tiles:
                fits = table.shape[1]
                for lo in range(0, len(x), STRIP):
                    part = np.ascontiguousarray(points[:, lo:lo + STRIP])
                    if not lo or part.shape[1] < STRIP:
                        shape = fits, part.shape[1]
                        far, edge, near = np.empty((len(table) * fits, shape[1]), np.float32), np.empty(shape, np.float32), np.empty(shape, bool)
                        code, term = np.empty(shape, self.kind), np.empty(shape, self.kind)
                    np.matmul(table.reshape(len(far), len(part)), part, out=far)
                    edge[:] = 0.0
                    for one in far.reshape(len(table), *shape):
                        np.minimum(edge, one, out=edge)
                    edge += self.by_length[at, None] * length[lo:lo + STRIP] + self.always[at, None]
                    np.multiply((edge >= 0.0).view(np.uint8), self.kind(self.base + self.k - 1), out=code)
                    for j, one in enumerate(far.reshape(len(table), *shape)):
                        np.less_equal(one, edge, out=near)
                        np.multiply(near.view(np.uint8), self.kind(self.base + j), out=term)
                        code += term
                    out[at, lo:lo + STRIP] = code
        return out

    def decided(self, x: np.ndarray, fit: np.ndarray, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """``code`` of these pairs, with the ones that were not told apart decided (the first of equals)."""
        code = code.copy()
        open_ = np.flatnonzero((code < self.base) | (code >= self.base + self.k))
        for lo in range(0, len(open_), PAIRS):
            at = open_[lo:lo + PAIRS]
            gap = x[row[at], None] - self.centres[fit[at]]
            code[at] = self.base + (gap * gap).sum(2).argmin(1)
        return code

    def own(self, x: np.ndarray) -> np.ndarray:
        """The code of the nearest centre, fits x points."""
        out = self.codes(x)
        fit, row = np.divmod(np.flatnonzero((out < self.base) | (out >= self.base + self.k)), len(x))
        out[fit, row] = self.decided(x, fit, row, out[fit, row])
        return out


def code_of(k: int) -> tuple[int, type]:
    """Base and type of codes for up to ``k`` centres, so that no sum of two or more is one of them."""
    return (16, np.uint8) if k <= 12 else (256, np.uint16) if k <= 128 else (1 << 16, np.uint32)


def chunks(batches: Iterator[pa.RecordBatch], width: int, cells: int = CELLS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, cells // max(width, 1))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def points_of(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    whole = None
    for c in columns:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        whole = ok if whole is None else whole & ok
    rows = df.where(whole).select(F.col(key).alias("key"), F.xxhash64(key).alias("h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    spark = df.sparkSession
    return materialise(rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def seeded(points: DataFrame, k: int, streams: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Starting centres, fits x k x columns, of fits with these random streams. ``counts`` may ask
    for fewer than ``k`` of a fit; the others are zeros."""
    counts = np.full(len(streams), k) if counts is None else counts
    centres: np.ndarray | None = None
    for step in range(k):
        open_ = np.flatnonzero(counts > step)
        now = None if centres is None else centres[open_, :step]
        salts = streams[open_].astype(np.uint64) + np.uint64(step)

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            time, who, at = np.full(len(salts), np.inf), np.zeros(len(salts), np.int64), None
            for part, x in chunks(batches, len(salts)):
                h = part.column("h").to_numpy()
                t = -np.log(uniform(h[:, None], salts[None, :]))
                if now is not None:
                    with np.errstate(divide="ignore"):
                        t = t / nearest(x, now)[0]
                first = t.argmin(0)
                t, g = t[first, np.arange(len(salts))], h[first]
                won = (t < time) | ((t == time) & (g < who))
                if at is None:
                    at, won = np.zeros((len(salts), x.shape[1])), np.ones(len(salts), bool)
                time[won], who[won], at[won] = t[won], g[won], x[first[won]]
            if at is not None:
                yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(salts)), pa.int32()), "t": time, "h": who, "x": list(at)})

        first = points.mapInArrow(race, "fit int, t double, h long, x array<double>").groupBy("fit").agg(F.min_by("x", F.struct("t", "h")).alias("x"))
        won = {r["fit"]: r["x"] for r in first.collect()}
        if not won:
            return np.zeros((len(streams), k, 0))
        new = np.array([won[f] for f in range(len(open_))])
        if centres is None:
            centres = np.zeros((len(streams), k, new.shape[1]))
        centres[open_, step] = new
    return centres


def settled(points: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres after Lloyd's steps, and each fit's sum of squared distances to the ones before the last."""
    return settled_groups(points, [centres], rounds)[0]


def settled_groups(points: DataFrame, starts: Sequence[np.ndarray], rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """``settled`` for groups of fits that differ in their cluster count; a scan serves them all."""
    d = starts[0].shape[2]
    centres, before = [c.copy() for c in starts], [c.copy() for c in starts]
    open_ = [np.arange(len(c)) for c in starts]
    base, kind = code_of(max(c.shape[1] for c in starts))
    held: DataFrame | None = None                   # points with the codes of their centres at some round,
    fits_of: list[np.ndarray] = []                  # the fits that these are of,
    sums_of: list[np.ndarray] = []                  # their sums at that round
    stale = False
    last: list[tuple[np.ndarray, np.ndarray]] = []  # centres and sums of the fits that are open, one round ago
    try:
        for turn in range(rounds):
            now = [c[o] for c, o in zip(centres, open_)]
            if turn >= FIRST and (held is None or stale):
                if held is not None:
                    held.unpersist()
                held = points.mapInArrow(keeping([c for c, _ in last], base, kind), "x array<double>, own binary").persist()
                fits_of, sums_of = list(open_), [s for _, s in last]
            places = None if held is None else [np.searchsorted(f, o) for f, o in zip(fits_of, open_)]
            got = added(points if held is None else held, adding(now, base, kind, places, [len(f) for f in fits_of]), now)
            pairs = changes = 0
            last = []
            for g, (c, o, (total, moved)) in enumerate(zip(now, open_, got)):
                if places is not None:
                    total = sums_of[g][places[g]] + total
                    pairs, changes = pairs + moved[:, 0].sum(), changes + moved[:, 1].sum()
                n = total[:, :, d:]
                new = np.where(n > 0, total[:, :, :d] / np.maximum(n, 1.0), c)      # a centre without points stays where it is
                before[g][o], centres[g][o] = c, new
                far = np.abs(new - c).max(axis=(1, 2)) > SETTLED * np.maximum(1.0, np.abs(c).max(axis=(1, 2)))
                open_[g] = o[far]
                last.append((c[far], total[far]))
            stale = changes > STALE * pairs or sum(map(len, open_)) < sum(map(len, fits_of)) / 2
            if not any(len(o) for o in open_):
                break
    finally:
        if held is not None:
            held.unpersist()
    return list(zip(centres, costs(points, before)))


def keeping(now: Sequence[np.ndarray], base: int, kind: type):
    """Points with the codes of their centres in all fits, one string of bytes a point."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screens = [Screen(c, base, kind) for c in now]
        for part, x in chunks(batches, sum(map(len, now)), CODES):
            codes = np.ascontiguousarray(np.vstack([s.own(x) for s in screens]).T)
            width = codes.shape[1] * codes.itemsize
            own = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([part.column("x"), own], names=["x", "own"])

    return keep


def codes_in(part: pa.RecordBatch, kind: type) -> np.ndarray:
    own = part.column("own").cast(pa.binary())
    start, end = np.frombuffer(own.buffers()[1], np.int32)[[own.offset, own.offset + len(own)]]
    return np.ascontiguousarray(np.frombuffer(own.buffers()[2], np.uint8)[start:end].view(kind).reshape(len(own), -1).T)


def adding(now: Sequence[np.ndarray], base: int, kind: type, places: Sequence[np.ndarray] | None, widths: Sequence[int]):
    """Per task and lane, the sums of the points at each centre, and by fit (pairs, changes).

    With codes held at ``places``, sums are those of the points that changed their centre since, at
    the new one less at the old one.
    """
    d = now[0].shape[2]
    starts = np.cumsum([0, *widths])
    where = None if places is None else [lo + p for lo, p in zip(starts, places)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screens = [Screen(c, base, kind) for c in now]
        total, seen = [np.zeros((len(c), c.shape[1], d + 1)) for c in now], False
        moved = [np.zeros((len(c), 2)) for c in now]
        for part, x in chunks(batches, sum(map(len, now)), CODES):
            one, seen = np.hstack([x, np.ones((len(x), 1))]), True
            held = None if where is None else codes_in(part, kind)
            for g, c in enumerate(now):
                if not len(c):
                    continue
                if held is None:
                    own = screens[g].own(x)
                    for lo in range(0, len(x), STRIP // 2):
                        mine, ones = own[:, lo:lo + STRIP // 2], one[lo:lo + STRIP // 2]
                        for j in range(c.shape[1]):
                            total[g][:, j] += (mine == base + j).astype(np.float64) @ ones
                    continue
                old, codes = held[where[g]], screens[g].codes(x)
                fit, row = np.divmod(np.flatnonzero(codes != old), len(x))
                new, old = screens[g].decided(x, fit, row, codes[fit, row]), old[fit, row]
                real = new != old
                fit, row, new, old = (v[real] for v in (fit, row, new, old))
                ends = np.searchsorted(fit, np.arange(len(c) + 1))
                moved[g] += np.stack([np.full(len(c), len(x)), np.diff(ends)], 1)
                marks = np.zeros((c.shape[1], len(fit)))
                marks[new - base, np.arange(len(fit))] = 1.0
                marks[old - base, np.arange(len(fit))] = -1.0
                for f in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[f], ends[f + 1])
                    total[g][f] += marks[:, at] @ one[row[at]]
        if seen:
            lanes = [(g, lane) for g, c in enumerate(now) for lane in lanes_of(c)]
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array(range(len(lanes)), pa.int32()),
                "sums": [np.concatenate([total[g][lane].ravel(), moved[g][lane].ravel()]).tobytes() for g, lane in lanes]})

    return add


def lanes_of(fits: np.ndarray) -> list[slice]:
    return [slice(lo, lo + LANE) for lo in range(0, len(fits), LANE)]


def added(frame: DataFrame, add, now: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What the tasks of ``adding`` send, added up by lane in tasks of their own."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for lane, sent in zip(batch.column("lane").to_pylist(), batch.column("sums")):
                sums = np.frombuffer(sent.as_buffer())
                whole[lane] = whole[lane] + sums if lane in whole else sums.copy()
        if whole:
            yield pa.RecordBatch.from_pydict({"lane": pa.array(whole, pa.int32()), "sums": [v.tobytes() for v in whole.values()]})

    lanes = [(g, lane) for g, c in enumerate(now) for lane in lanes_of(c)]
    kind, tasks = "lane int, sums binary", frame.sparkSession.sparkContext.defaultParallelism
    sent = frame.mapInArrow(add, kind).repartition(min(tasks, len(lanes)), "lane").mapInArrow(meet, kind).collect()
    sums = {r["lane"]: np.frombuffer(r["sums"]) for r in sent}
    out = [(np.zeros((len(c), c.shape[1], c.shape[2] + 1)), np.zeros((len(c), 2))) for c in now]
    for lane, (g, at) in enumerate(lanes):
        total, moved = out[g][0][at], out[g][1][at]
        total[:], moved[:] = sums[lane][:total.size].reshape(total.shape), sums[lane][total.size:].reshape(moved.shape)
    return out


def costs(points: DataFrame, centres: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Each fit's sum of squared distances of the points to their nearest centres."""
    def pay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paid = [np.zeros(len(c)) for c in centres]
        for _, x in chunks(batches, max(map(len, centres))):
            for p, c in zip(paid, centres):
                p += nearest(x, c)[0].sum(0)
        yield pa.RecordBatch.from_pydict({"paid": [np.concatenate(paid)]})

    paid = sum(np.array(r["paid"]) for r in points.mapInArrow(pay, "paid array<double>").collect())
    return np.split(paid, np.cumsum([len(c) for c in centres])[:-1])


def kmeans_grid(df: DataFrame, columns: Sequence[str], seeds: Mapping[int, Sequence[int]], inits: int = 10, key: str = "plot_id") -> DataFrame:
    """(k, seed, key, cluster): for every cluster count and seed in ``seeds``, the cheapest of
    ``inits`` fits; of equally cheap ones (to nine digits) the first start.

    Rows with a null or NaN among ``columns`` are in no cluster. Fewer distinct points than centres
    leave some centres without points. An empty frame gives no rows.
    """
    points = points_of(df, columns, key)
    dealt = points.select("h", "x").repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    every = list(dict.fromkeys(s for wanted in seeds.values() for s in wanted))
    most = np.repeat([max(k for k, wanted in seeds.items() if s in wanted) for s in every], inits)
    streams = np.array([(s * 1009 + i) * 4099 for s in every for i in range(inits)])
    start = seeded(dealt, int(most.max()), streams, most)
    chosen: list[tuple[int, list[int], np.ndarray]] = []
    if start.shape[2]:
        fits = {k: np.array([every.index(s) * inits + i for s in wanted for i in range(inits)]) for k, wanted in seeds.items()}
        done = settled_groups(dealt, [start[fits[k], :k] for k in seeds])
        for (k, wanted), (centres, cost) in zip(seeds.items(), done):
            best = []
            for j in range(len(wanted)):
                costs = [float(f"{c:.9g}") for c in cost[j * inits:(j + 1) * inits]]
                best.append(centres[j * inits + int(np.argmin(costs))])
            chosen.append((k, list(wanted), np.array(best)))
    dealt.unpersist()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in chunks(batches, max([len(c) for _, _, c in chosen], default=1)):
            for k, wanted, c in chosen:
                own = nearest(x, c)[1]
                for i, s in enumerate(wanted):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(np.full(len(x), s, np.int32)),
                                                      part.column("key"), pa.array(own[:, i].astype(np.int32))], names=["k", "seed", key, "cluster"])

    kind = df.schema[key].dataType.simpleString()
    return points.mapInArrow(assign, f"k int, seed int, `{key}` {kind}, cluster int")
