"""Quality rules against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import queries
from fieldspark.llm import quality_rules as qr

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORDS.findall(text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def odd_texts():
    rng = random.Random(3)
    some = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    return [None, "", " \t\n", " x  y", "a\n\na\n b\nb \na", "#*$%&|<> # é𝄞 \x0b\x0c\r\n z", "'\\' \\n", " ".join("abcdefghi"),
            " ".join("abcdefgh" * 2), " ".join(["x"] * 9), " ".join(f"w{i % 4000}" for i in range(20_000)),
            " ".join(f"w{i}" for i in range(20_000)), *some]


def test_statistics(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, stats int")
    got = {r["doc_id"]: r for r in qr.judge(qr.measured(rows), qr.DecisionList(())).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        s = got[i]["stats"]
        want = base(t)
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == want, (i, t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed) and got[i]["rule"] is None


def gain_by_rows(rows, cond):
    import math
    p0, n0 = sum(low for _, low in rows), sum(not low for _, low in rows)
    in_ = [(v, low) for v, low in rows if (v > cond[1]) == cond[0]]
    p1, n1 = sum(low for _, low in in_), sum(not low for _, low in in_)
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 >= qr.LEAST_ROWS else 0.0


def test_best_condition_has_the_most_gain():
    rng = random.Random(5)
    rows = [(rng.randrange(40), False) for _ in range(300)] + [(rng.randrange(25, 60), True) for _ in range(80)]
    counts = {}
    for v, low in rows:
        counts.setdefault(v, [0, 0, 0, 0])[0 if low else 1] += 1
    cond, sides = qr.best_condition({"symbols": counts}, ())
    best = max(gain_by_rows(rows, (above, cut)) for above in (True, False) for cut in range(-1, 61))
    assert gain_by_rows(rows, (cond.above, cond.cut)) == pytest.approx(best)
    assert sides[0] == sum(low for v, low in rows if (v > cond.cut) == cond.above)


def labelled(spark, bad, good):
    texts = [(i, t, 0) for i, t in enumerate(bad)] + [(1000 + i, t, 1) for i, t in enumerate(good)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    return qr.measured(docs).join(docs.select("doc_id", "quality"), "doc_id")


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_learns_two_kinds_of_junk_and_leaves_prose(spark):
    rng = random.Random(8)
    good = [prose(rng, 60) for _ in range(300)]
    bad = [prose(rng, 60).replace(" ", "## ") for _ in range(60)] + [prose(rng, 60).upper() for _ in range(60)]
    rules = qr.train(labelled(spark, bad, good))
    assert len(rules.rules) == 2
    new = [prose(rng, 50).replace(" ", " ### ") for _ in range(20)] + [prose(rng, 50).upper() for _ in range(20)] + [prose(rng, 50) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in qr.judge(qr.measured(rows), rules).collect()}
    assert [kept[i] for i in range(80)] == [False] * 40 + [True] * 40


def test_noise_and_one_class_give_no_rule(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(200)]
    assert qr.train(labelled(spark, texts[:100], texts[100:])).rules == ()
    assert qr.train(labelled(spark, [], texts)).rules == ()
    assert qr.train(labelled(spark, texts, [])).rules == ()
    assert qr.train(labelled(spark, texts, []).limit(0)).rules == ()


def test_query_reads_no_python_and_keeps_all_rows(spark):
    folder = "/root/testdata/sf0.001"
    out = queries.QUERIES["op13_quality"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r["doc_id"]: base(r["text"]) for r in docs.collect()}
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[r["doc_id"]]
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    low = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert low.where("kept").count() >= 0.98 * low.count()
    assert "Python" not in out._jdf.queryExecution().toString() and out.where(F.col("kept")).count() > 0
