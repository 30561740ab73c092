"""Quotient filters and collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import collocations as co


@pytest.mark.parametrize("words,bits", [(2, 24), (3, 37), (3, 62), (1, 33)])
def test_permutation_is_undone(words, bits):
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 1 << bits, 5000, dtype=np.uint64) for _ in range(words)]
    y = co.permute(x, bits)
    assert all(int(v.max()) < 1 << bits for v in y)
    assert all((a == b).all() for a, b in zip(co.permute(y, bits, back=True), x))


@pytest.mark.parametrize("bits,quotient,base", [(24, 8, 0), (37, 12, 512), (62, 20, 0)])
def test_filter_round_trip_and_merge(bits, quotient, base):
    rng = np.random.default_rng(2)

    def some(n):
        high = rng.integers(base, 1 << quotient, n, dtype=np.uint64) << np.uint64(bits - quotient)
        limbs = [high | rng.integers(0, 4, n, dtype=np.uint64), rng.integers(0, 3, n, dtype=np.uint64)]
        return limbs, rng.integers(1, 400, n)

    both, want = [], Counter()
    for n in (0, 1, 3000, 500):
        limbs, counts = some(n)
        for a, b, c in zip(*limbs, counts):
            want[int(a), int(b)] += int(c)
        f = co.Filter.of(limbs, counts)
        g = co.Filter.unpacked(f.packed(bits, quotient, base), 2, bits, quotient, base)
        assert (g.counts == f.counts).all() and all((a == b).all() for a, b in zip(f.limbs, g.limbs))
        both.append(g)
    whole = both[0]
    for f in both[1:]:
        whole = whole.merged(f)
    assert {(int(a), int(b)): int(c) for a, b, c in zip(*whole.limbs, whole.counts)} == dict(want)


def brute(rows, least, shadow, top):
    f, n = {k: Counter() for k in (1, 2, 3)}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in f:
                f[k].update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    flat = {g: c for k in f for g, c in f[k].items()}
    out = {}
    for g, a in flat.items():
        if len(g) == 2 or a < least:
            continue
        w, lang = g[1:], g[0]
        if any(h[0] == lang and 100 * c >= shadow * a and c >= least and len(h) > len(g) and w in (h[1:3], h[2:4]) for h, c in f[3].items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = flat[(lang, *w[:k])], flat[(lang, *w[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, every in out.items()
            for i, (s, a, p, x, y) in enumerate(sorted(every)[:top])}


def odd_rows():
    rng = random.Random(4)
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", ".,;:!?\n\x0b\x0c\r"), ("en", "A B a b. A\tB\x0bA  B"), ("", "x y x y x y"),
            ("und", "p q p q"), (None, "p q P Q é É 𝄞 𝄞"), ("en", "a\x00b \x1c \x1f a\x00b \x1c \x1f"), ("fr", "z " * 20_000)]
    rows += [(rng.choice(["en", "de", None]), "".join(rng.choice(["a ", "b ", "c ", "d. ", "e\n"]) for _ in range(40))) for _ in range(50)]
    return rows + [("en", "same words again")] * 12


@pytest.mark.parametrize("top", [2000, 5])
def test_against_brute_force(spark, top, monkeypatch):
    monkeypatch.setattr(co, "RANGE_KEYS", 4000)
    monkeypatch.setattr(co, "SHARD_KEYS", 64)
    rows = odd_rows()
    docs = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, a int").repartition(5)
    got = {tuple(r) for r in co.collocations(docs, top=top).collect()}
    want = brute(rows, co.LEAST, co.SHADOW, top)
    assert len(want) > 5 and got == want


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_scores_pass_64_bits(spark):
    a, left, right = 9 * 10**12, 10**13, 9 * 10**12 + 7
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(co.cut_score("a", "l", "r")).first()
    assert row[0] == 1000000 * a * a // (left * right)
