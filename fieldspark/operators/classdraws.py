"""Forecast totals over draws in which classes are centred anew, without a row per plot and draw.

A task holds a chunk of plots by all draws as numpy matrices and sends counts, a few values and sums.
Quantiles are exact: a first scan counts every class and draw over the bins of that class, a second one
sends the values of the bins that hold the wanted ranks, a third one sums. Bins come from a few
draws; they decide how much is sent, not what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rand
from fieldspark.operators.draws import mix32

# Bins of a class, draws that place them, and draws whose counts or values meet in one group.
BINS, PILOTS, LANE = 256, 8, 16
TIE_BINS = 256
# Numbers of a matrix that a task holds at once.
CELLS = 1 << 19
PROBS = (0.05, 0.5, 0.95)

# Of some plots: class numbers, x, reference x weight, weight; plots x draws, or x 1 if no draw changes it.
Matrices = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def mix52(row: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """``rand.mix52`` on arrays."""
    mix = mix32(row, draw, seed) * np.uint64(1 << 20) + (mix32(row, draw, seed + rand.LANE_STEP) >> np.uint64(12))
    return mix.astype(np.int64)


def uniform(row: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """``rand.uniform`` on arrays."""
    return (mix52(row, draw, seed).astype(np.float64) + 0.5) / float(1 << rand.BITS)


def normal(row: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """``rand.normal`` on arrays."""
    return np.sqrt(-2.0 * np.log(uniform(row, draw, seed))) * np.cos(2.0 * np.pi * uniform(row, draw, seed + 7919))


def chunks(frames: Iterator[pd.DataFrame], draws: int) -> Iterator[pd.DataFrame]:
    step = max(1, CELLS // draws)
    for whole in frames:
        for lo in range(0, len(whole), step):
            yield whole.iloc[lo:lo + step]


def of_class(c: np.ndarray, x: np.ndarray, k: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(draw, x) of the plots and draws in class ``k`` that have an x."""
    if c.shape[1] == 1:
        mine = np.flatnonzero(c[:, 0] == k)
        v, d = np.broadcast_to(x[mine], (len(mine), draws)).ravel(), np.tile(np.arange(draws), len(mine))
    else:
        r, d = np.nonzero(c == k)
        v = x[r, d if x.shape[1] > 1 else 0]
    known = ~np.isnan(v)
    return (d, v) if known.all() else (d[known], v[known])


def bins_of(rows: DataFrame, spread: Callable[[pd.DataFrame, np.ndarray], Matrices], classes: int, draws: int) -> list[np.ndarray]:
    """Edges of every class; a value that fills a bin has one of its own, with nothing beside it."""
    some = np.unique(np.linspace(0, draws - 1, min(PILOTS, draws)).astype(np.int64))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in chunks(frames, draws):
            c, x, *_ = spread(f, some)
            for k in range(classes):
                yield pd.DataFrame({"k": k, "v": of_class(c, x, k, len(some))[1]})

    at = [i / BINS for i in range(1, BINS)]
    found = rows.mapInPandas(look, "k int, v double").groupBy("k").agg(F.percentile_approx("v", at, 10 * BINS).alias("e")).collect()
    edges = [np.empty(0) for _ in range(classes)]
    for r in found:
        values, n = np.unique(np.array(r["e"], float), return_counts=True)
        edges[r["k"]] = np.unique(np.concatenate([values, np.nextafter(values[n > 1], np.inf)]))
    return edges


def class_quantiles(rows: DataFrame, spread: Callable[[pd.DataFrame, np.ndarray], Matrices], classes: int, draws: int) -> np.ndarray:
    """Exact quantiles at ``PROBS`` of x, classes x draws x 3 (NaN without an x), linear between ranks."""
    edges = bins_of(rows, spread, classes, draws)
    wide, every = max(len(e) for e in edges) + 1, np.arange(draws)
    lanes = [every[lo:lo + LANE] for lo in range(0, draws, LANE)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((classes, draws, wide), np.int64)
        for f in chunks(frames, draws):
            c, x, *_ = spread(f, every)
            for k in range(classes):
                d, v = of_class(c, x, k, draws)
                n[k] += np.bincount(d * wide + np.searchsorted(edges[k], v, side="right"), minlength=draws * wide).reshape(draws, wide)
        if n.any():
            yield pd.DataFrame({"lane": range(len(lanes)), "n": [n[:, at].astype(np.int32).tobytes() for at in lanes]})

    def bracket(sent: pd.DataFrame) -> pd.DataFrame:
        lane = int(sent["lane"].iloc[0])
        n = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in sent["n"]).reshape(classes, len(lanes[lane]), wide)
        upto = np.cumsum(n, axis=2)
        rank = (upto[:, :, -1:] - 1) * np.array(PROBS)
        lo = (upto[:, :, None, :] <= np.floor(rank)[..., None]).sum(3)
        hi = (upto[:, :, None, :] <= np.ceil(rank)[..., None]).sum(3)
        below = np.take_along_axis(np.concatenate([np.zeros_like(n[:, :, :1]), upto], axis=2), lo, 2)
        return pd.DataFrame({"lane": [lane], **{name: [a.astype(np.float64).tobytes()] for name, a in
                                                (("lo", lo), ("hi", hi), ("at", rank - below))}})

    lo, hi, at = np.zeros((3, classes, draws, len(PROBS)))
    at[:] = np.nan
    for r in rows.mapInPandas(count, "lane int, n binary").groupBy("lane").applyInPandas(bracket, "lane int, lo binary, hi binary, at binary").collect():
        here = lanes[r["lane"]]
        for name, a in (("lo", lo), ("hi", hi), ("at", at)):
            a[:, here] = np.frombuffer(r[name]).reshape(classes, len(here), len(PROBS))
    some = at >= 0
    out = np.full(at.shape, np.nan)
    for k, e in enumerate(edges):
        # A bin that holds one value only has nothing to send.
        known = np.isin(np.arange(1, len(e)), np.flatnonzero(e[1:] == np.nextafter(e[:-1], np.inf)) + 1)
        b = lo[k].astype(int)
        point = some[k] & (lo[k] == hi[k]) & (b > 0) & (b < len(e))
        point[point] = known[b[point] - 1]
        out[k][point] = e[b[point] - 1]
        lo[k][point | ~some[k]], hi[k][point | ~some[k]] = 0, -1

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in chunks(frames, draws):
            c, x, *_ = spread(f, every)
            codes, values = [], []
            for k in range(classes):
                d, v = of_class(c, x, k, draws)
                b = np.searchsorted(edges[k], v, side="right")
                for j in range(len(PROBS)):
                    mine = (b >= lo[k, d, j]) & (b <= hi[k, d, j])
                    codes.append((k * draws + d[mine]) * len(PROBS) + j)
                    values.append(v[mine])
            code, value = np.concatenate(codes), np.concatenate(values)
            lane = code // len(PROBS) % draws // LANE
            order = np.argsort(lane, kind="stable")
            names, start = np.unique(lane[order], return_index=True)
            ends = [*start[1:], len(order)]
            yield pd.DataFrame({"lane": names, "code": [code[order[a:z]].astype(np.int64).tobytes() for a, z in zip(start, ends)],
                                "v": [value[order[a:z]].tobytes() for a, z in zip(start, ends)]})

    def pick(sent: pd.DataFrame) -> pd.DataFrame:
        code, v = np.frombuffer(b"".join(sent["code"]), np.int64), np.frombuffer(b"".join(sent["v"]))
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        names, start = np.unique(code, return_index=True)
        pos = at.reshape(-1)[names]
        low, high = v[start + np.floor(pos).astype(int)], v[start + np.ceil(pos).astype(int)]
        return pd.DataFrame({"code": names, "q": low + (high - low) * (pos - np.floor(pos))})

    flat = out.reshape(-1)
    sent = rows.mapInPandas(send, "lane int, code binary, v binary")
    got = sent.groupBy("lane").applyInPandas(pick, "code long, q double").toArrow()
    flat[got["code"].to_numpy()] = got["q"].to_numpy()
    return out


def class_totals(rows: DataFrame, spread: Callable[[pd.DataFrame, np.ndarray], Matrices], classes: int, draws: int, span: float) -> DataFrame:
    """(draw, total, w): per draw the sum of reference x weight x factor, and each class's weight.

    ``spread`` makes the matrices of some staged ``rows`` for some draws. The factor is that of
    ``rollup.centred_factor`` within a draw and class; what the driver holds is classes x draws.
    """
    q = class_quantiles(rows, spread, classes, draws)
    every = np.arange(draws)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight, seen = np.zeros(draws), np.zeros((draws, classes)), False
        for f in chunks(frames, draws):
            c, x, rw, w = spread(f, every)
            lo, mid, hi = np.moveaxis(q[c, every], 2, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                # A side of zero width and a plot without x count nothing.
                up = np.where(hi > mid, np.clip((x - mid) / (hi - mid), 0.0, 1.0), 0.0)
                down = np.where(mid > lo, np.clip((mid - x) / (mid - lo), 0.0, 1.0), 0.0)
            factor = 1.0 + span * np.nan_to_num(up) - span * np.nan_to_num(down)
            total += (np.nan_to_num(rw) * factor).sum(0)
            seen = seen or not np.isnan(rw).all()
            for k in range(classes):
                weight[:, k] += (np.nan_to_num(w) * (c == k)).sum(0)
        if seen:
            yield pd.DataFrame({"draw": every, "total": total, "w": list(weight)})

    s = rows.mapInPandas(add, "draw int, total double, w array<double>").groupBy("draw")
    return s.agg(F.sum("total").alias("total"), F.array(*[F.sum(F.col("w")[k]) for k in range(classes)]).alias("w"))


def class_weights(rows: DataFrame, spread: Callable[[pd.DataFrame, np.ndarray], Matrices], classes: int, draws: int) -> DataFrame:
    """(draw, k, w, n): each class's weight and number of plots in every draw."""
    every = np.arange(draws)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, n = np.zeros((classes, draws)), np.zeros((classes, draws), np.int64)
        for f in chunks(frames, draws):
            c, _, _, w = spread(f, every)
            for k in range(classes):
                weight[k] += (np.nan_to_num(w) * (c == k)).sum(0)
                n[k] += (c == k).sum(0)
        if n.any():
            yield pd.DataFrame({"draw": np.tile(every, classes), "k": np.repeat(np.arange(classes), draws), "w": weight.ravel(), "n": n.ravel()})

    return rows.mapInPandas(add, "draw int, k int, w double, n long").groupBy("draw", "k").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def first_beyond(rows: DataFrame, runs: Mapping[int, tuple[float, float]], ends: Sequence[float], draws: int, seed: int) -> np.ndarray:
    """Per run, edge and draw the first (h, id) whose share of the weight lies beyond the edge.

    ``rows(plot_id, run, _pw)`` are ordered by ``mix52`` and plot_id in every draw; ``runs`` gives the
    weight before a run and that of all rows. Weights are added up by bins of h; only rows of a bin
    that an edge falls into are sent and put in order.
    """
    none = np.iinfo(np.int64).max
    out = np.full((max(len(runs), 1), len(ends), draws), none, dtype=[("h", np.int64), ("id", np.int64)])
    out["id"] = none
    if not runs:
        return out
    every, width, n_runs = np.arange(draws), TIE_BINS, len(runs)
    shift = np.int64(rand.BITS - width.bit_length() + 1)
    before, total = (np.array([runs[i][j] for i in range(n_runs)]) for j in (0, 1))

    def numbers(f: pd.DataFrame) -> np.ndarray:
        return mix52(f["plot_id"].to_numpy()[:, None], every[None, :], seed)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros(n_runs * draws * width)
        for f in chunks(frames, draws):
            at = (f["run"].to_numpy()[:, None] * draws + every) * width + (numbers(f) >> shift)
            w += np.bincount(at.ravel(), weights=np.repeat(np.nan_to_num(f["_pw"].to_numpy()), draws), minlength=len(w))
        if w.any():
            yield pd.DataFrame({"lane": every, "w": [x.tobytes() for x in np.moveaxis(w.reshape(n_runs, draws, width), 1, 0)]})

    def bracket(sent: pd.DataFrame) -> pd.DataFrame:
        w = sum(np.frombuffer(b) for b in sent["w"]).reshape(n_runs, width)
        upto = np.cumsum(w, axis=1) + before[:, None]
        share = upto / total[:, None]
        # A bin early, so that another order of adding up cannot matter.
        at = np.stack([np.maximum((share <= e).sum(1) - 1, 0) for e in ends], axis=1)
        start = np.take_along_axis(np.concatenate([before[:, None], upto], axis=1), at, 1)
        return pd.DataFrame({"lane": sent["lane"].iloc[:1], "at": [at.astype(np.float64).tobytes()], "start": [start.tobytes()]})

    at, start = np.zeros((2, n_runs, len(ends), draws))
    for r in rows.mapInPandas(count, "lane int, w binary").groupBy("lane").applyInPandas(bracket, "lane int, at binary, start binary").collect():
        at[:, :, r["lane"]] = np.frombuffer(r["at"]).reshape(n_runs, -1)
        start[:, :, r["lane"]] = np.frombuffer(r["start"]).reshape(n_runs, -1)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in chunks(frames, draws):
            h, run = numbers(f), f["run"].to_numpy()
            for e in range(len(ends)):
                bin_, first = h >> shift, at[run, e]
                r, d = np.nonzero((bin_ >= first) & (bin_ <= first + 2))
                yield pd.DataFrame({"run": run[r], "e": e, "draw": d, "h": h[r, d], "id": f["plot_id"].to_numpy()[r], "w": f["_pw"].to_numpy()[r]})

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["h", "id"])
        run, e, d = (int(f[c].iloc[0]) for c in ("run", "e", "draw"))
        share = (start[run, e, d] + np.cumsum(np.nan_to_num(f["w"].to_numpy()))) / total[run]
        over = np.flatnonzero(share > ends[e])
        return f.iloc[over[:1]][["run", "e", "draw", "h", "id"]]

    sent = rows.mapInPandas(send, "run int, e int, draw int, h long, id long, w double")
    got = sent.groupBy("run", "e", "draw").applyInPandas(pick, "run int, e int, draw int, h long, id long").toPandas()
    for c in ("h", "id"):
        out[c][got["run"], got["e"], got["draw"]] = got[c]
    return out
