"""Secret scans, fingerprints, URL filters and mixing against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import mixing, secrets, urls, winnowing
from fieldspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", None), (3, "é token: 'abcdef123' x", "en"), (3, "é token: 'abcdef123' x", "en"),
       (None, "secret=token:abcdefgh AKIA" + "Z9" * 10 + " 0123456789abcdef01234567", "fr"),
       (5, "x" * 50_000, "de"), (6, "𝒳𝒴 password = hunter22 " * 300, "en"), (7, " \n\t ", "es")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 1, "clash") for r in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, secrets string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def base_spans(text):
    word = "password|passwd|secret|token|api_?key"
    kinds = [("assign", re.compile(r"""(%s)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""" % word, re.I | re.A), lambda m: len(m[2]) >= 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def check_secrets(frame):
    spark = frame.sparkSession
    model = secrets.train(secrets.generated(spark))
    out = secrets.find_secrets(frame, "text", model, "found").selectExpr("doc_id", "text", secrets.span_text("found", 3) + " AS b",
                                                                         secrets.span_text("found", 4) + " AS a").collect()
    for r in out:
        want = base_spans(r.text or "")
        assert r.b == ",".join(want)
        assert set(want) <= set(x for x in r.a.split(",") if x)
    return out


def test_base_spans(docs, odd):
    assert len(check_secrets(docs)) == docs.count()
    assert len(check_secrets(odd)) == len(ODD)


def test_markov_tells_random_from_ordinary(spark):
    words = [("internationalization_of_things", False), ("configuration-management-tools", False),
             ("thisisaveryordinaryidentifier", False)] * 5
    model = secrets.train(spark.createDataFrame(words, "run string, random boolean").union(secrets.generated(spark)))
    rows = [("a key Zq8XvT2mPk0RbW7uYhJ4sLd9 here",), ("an ordinary_identifier_in_configuration here",)]
    out = secrets.find_secrets(spark.createDataFrame(rows, "text string"), "text", model).collect()
    assert [len(r.secrets) for r in out] == [1, 0]
    assert out[0].secrets[0].start == 6 and out[0].secrets[0].end == 30


def test_what_a_base_span_leaves_of_a_run_is_scored(spark):
    words = [("internationalization_of_things", False), ("configuration-management-tools", False)] * 5
    model = secrets.train(spark.createDataFrame(words, "run string, random boolean").union(secrets.generated(spark)))
    key = "Zq8XvT2mPk0RbW7uYhJ4sLd9XnQ3wGt6Kc5MzVy1"
    code = "0123456789abcdef01234567"
    rows = [(1, f"sk-{code}_{key} end"), (2, f"{key}_{code}_{key}"), (3, f"{code}_configuration-management-tools"), (4, f"{code}_Zq8XvT2mPk")]
    out = secrets.find_secrets(spark.createDataFrame(rows, "id int, text string"), "text", model)
    got = {r.id: r for r in out.select("id", F.expr("transform(secrets, s -> s.kind)").alias("kinds"),
                                       F.expr(secrets.redacted("text", "secrets")).alias("new")).collect()}
    assert [got[i].kinds for i in (1, 2, 3, 4)] == [[2, 3], [3, 2, 3], [2], [2]]
    assert all("Zq8" not in got[i].new and "MzVy1" not in got[i].new for i in (1, 2))


PLAIN = ["HTTPSCONNECTIONPOOLMANAGERS", "usr/local/share/python3/dist-packages", "internationalization_of_things",
         "AbstractSingletonProxyFactoryBean", "getUserByIdAndNameOrderByDate", "2024-01-01_12-00-00_2024-02-03",
         "configuration-management-tools", "https://example.com/en/index_of_all_pages", "=" * 40, "-" * 64, "a" * 30]


def test_registered_scan_finds_planted_keys_and_leaves_plain_runs(spark, docs, tmp_path):
    rng = random.Random(8)
    signs = {"mixed": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
             "capitals": string.ascii_uppercase + string.digits}
    keys = ["".join(rng.choice(v) for _ in range(n)) for v in signs.values() for n in (20, 24, 32, 40) for _ in range(10)]
    keys += ["Zq8XvT2mPk0RbW7uYhJ4sLd9", "xK9fQ2vL7pW3nR8tY5uB1mC6zD4"]
    planted = [(1_000_000 + i, f"see {k} there") for i, k in enumerate(keys)] + [(2_000_000 + i, f"see {k} there") for i, k in enumerate(PLAIN)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in QUERIES["op2_secrets"](spark, str(tmp_path)).collect()}
    hit = sum(f"markov:4:{4 + len(k)}" in got[1_000_000 + i] for i, k in enumerate(keys))
    assert hit >= 0.9 * len(keys)
    assert [k for i, k in enumerate(PLAIN) if "markov" in got[2_000_000 + i]] == []
    assert not [d for d, s in got.items() if d < 1_000_000 and "markov" in s]


def test_ratio_against_counts_by_hand(spark):
    rows = [("ab1Z", True), ("Zq9=", True), ("abab", False), ("ba_a", False), ("abab", False)]
    ratio = secrets.train(spark.createDataFrame(rows, "run string, random boolean")).first().ratio
    n = secrets.STATES

    def chance(random_):
        seen = [[0] * n for _ in range(n)]
        for run, kind in rows:
            codes = [secrets.ALPHABET.index(c) + 1 for c in run]
            for a, b in zip([0, *codes], codes):
                seen[a][b] += kind == random_
        into = [sum(r[b] for r in seen) for b in range(n)]
        low = [(x + secrets.SMOOTHING) / (sum(into) + secrets.SMOOTHING * n) for x in into]
        return [[(seen[a][b] + secrets.PRIOR * low[b]) / (sum(seen[a]) + secrets.PRIOR) for b in range(n)] for a in range(n)]

    hot, cold = chance(True), chance(False)
    want = [math.log(hot[a][b] / cold[a][b]) for a in range(n) for b in range(n)]
    assert ratio == pytest.approx(want, abs=1e-5)


def test_labelled_runs(spark):
    texts = [("config Config/x password=Ab3dEf6hIj9lMn2p",), ("config",), (None,), ("",)]
    got = {(r.run, r.random) for r in secrets.labelled_runs(spark.createDataFrame(texts, "text string").union(
        spark.createDataFrame([("config",)], "text string"))).collect() if len(r.run) < 64}
    assert got == {("Ab3dEf6hIj9lMn2p", True), ("config", False), ("CONFIG", False), ("configConfig", False), ("config/config", False)}


def test_redaction(spark):
    rows = spark.createDataFrame([("é token=\"0123456789abcdef01234567\" b",), ("clean",)], "text string")
    found = secrets.find_secrets(rows, "text", secrets.train(secrets.generated(spark)))
    assert [r[0] for r in found.selectExpr(secrets.redacted("text", "secrets")).collect()] == ['é [SECRET]" b', "clean"]


def test_secrets_of_an_empty_table(spark, odd):
    none = odd.limit(0)
    model = secrets.train(secrets.labelled_runs(none.select("text")))
    assert secrets.find_secrets(none, "text", model, "found").count() == 0


def winnow(text, k=winnowing.K, w=winnowing.W):
    def h(xs, seed=42):
        for x in xs:
            seed = xxhash.xxh64_intdigest(x, seed)
        return seed
    words = re.findall(r"[^\s]{1,%d}" % winnowing.PIECE, text, re.A)
    ids = [h([x.encode()]) for x in words]
    pack = [i.to_bytes(8, "little") for i in ids]
    grams = [h(pack[i:i + k]) for i in range(max(1, len(pack) - k + 1))] if pack else []
    low = [(g & ((1 << 40) - 1), i) for i, g in enumerate(grams)]
    picks = []
    for i in range(max(1, len(low) - w + 1)) if low else []:
        best = min(low[i:i + w], key=lambda x: (x[0], -x[1]))
        if not picks or picks[-1] != best:
            picks.append(best)
    return picks


def printed(picks):
    return hashlib.sha256(",".join(f"{i:X}:{g:X}" for g, i in picks).encode()).hexdigest()


def likeness(a, b):
    a, b = {g for g, _ in a}, {g for g, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in rows), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r, a, b = got[i], winnow(text), winnow(edited)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (printed(a), printed(b))
        assert r.near_edited == pytest.approx(likeness(a, b))
        assert r.near_next == pytest.approx(likeness(a, winnow(after)))


def test_next_row_over_buckets_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 3)
    ids = [None, 5, 5, 5, 1, 2, 9, 1 << 40, -4, 7, 8, 3, 3]
    frame = spark.createDataFrame([(x, f"t{i}") for i, x in enumerate(ids)], "doc_id long, text string")
    out = {r.text: r.n for r in winnowing.with_next(frame, "doc_id", {"n": "text"}).collect()}
    order = sorted(((x is None, -(x or 0), f"t{i}") for i, x in enumerate(ids)))
    texts = [t for *_, t in order]
    assert out == dict(zip(texts, texts[1:] + texts[:1]))
    assert winnowing.with_next(frame.limit(0), "doc_id", {"n": "text"}).count() == 0
    one = frame.limit(1)
    assert [(r.text, r.n) for r in winnowing.with_next(one, "doc_id", {"n": "text"}).collect()] == [("t0", "t0")]


def test_a_shared_passage_leaves_a_common_mark(spark):
    passage = " ".join(f"word{i}" for i in range(winnowing.K + winnowing.W - 1))
    frame = spark.createDataFrame([(f"alpha beta {passage} gamma",), (f"x {passage} y z",)], "text string")
    a, b = [set(r[0]) for r in frame.selectExpr(winnowing.hashes(winnowing.fingerprint("text"))).collect()]
    assert a & b


def test_a_shifted_passage_without_spaces_leaves_a_common_mark(spark):
    def run(first, n):
        return "".join(chr(first + i * 37 % 5000) for i in range(n))

    passage = run(0x4E00, winnowing.ROLL + winnowing.K + winnowing.W - 2)
    wide = "".join(chr(0x20000 + i) for i in range(15))
    for shared in (passage, wide, run(0x4E00, 700)):
        frame = spark.createDataFrame([(run(0x7000, 70) + shared + run(0x8000, 50),), ("x " + run(0x7800, 81) + shared + "y z",)], "text string")
        a, b = [set(r[0]) for r in frame.selectExpr(winnowing.hashes(winnowing.fingerprint("text"))).collect()]
        assert a & b


def test_rules():
    assert urls.RULES[0] == ("com", "/", "allow")


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/x"), (2, "http://www.example.com/en/1"), (3, "http://q.com"), (4, "http://q.com/"),
            (5, None), (6, "no scheme"), (7, "x://b.net/es/7?q#f"), (8, "http://xcom/"), (9, "http://b.net?a=/fr/"),
            (9, "http://b.net?a=/fr/"), (10, "://h.org" + "/a" * 3000), (11, "http://x.net\n/fr/\nz")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][:3] == ("q.com", "", None) and got[4][2:] == ("com/", "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7] == ("b.net", "/es/7", "net/es/", "block")
    assert got[8][2] is None and got[9][:3] == ("b.net", "", None)
    assert got[10][1] == "/a" * 3000
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge(frame).count() == len(rows) and urls.judge(frame.limit(0)).count() == 0


def test_templates_generalise(spark):
    rows = [(i, f"http://h.org/post/slug{'abcdefghij'[i]}/view", "") for i in range(10)] + [(20 + i, "http://h.org/about/us", "") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = {r.template for r in urls.judge(frame).collect()}
    assert seen == {"/post/*/view", "/about/us"}


def test_mixing_meets_its_targets(spark, docs):
    whole = docs.select(mixing.tokens(docs.text)).groupBy().sum().first()[0]
    out = mixing.mix(docs, keep=0.3, power=0.9).selectExpr("row.lang", "tokens", "p", "kept").toPandas()
    asked = (out.tokens * out.p).groupby(out.lang).sum()
    share = out.tokens.groupby(out.lang).sum() ** 0.9
    want = share / share.sum() * whole * 0.3
    assert ((asked - want).abs() / want).max() < 0.05
    assert out.p.between(0, 1).all() and len(out) == docs.count()
    assert 0.15 * whole < out.tokens[out.kept].sum() < 0.45 * whole


def test_mixing_of_odd_rows(odd):
    out = mixing.mix(odd.drop("secrets").withColumnRenamed("n_chars", "p"), keep=0.5).collect()
    assert len(out) == len(ODD) and all(0 <= r.p <= 1 for r in out)
    assert all(r.kept for r in out if r.tokens == 0)
    assert mixing.mix(odd.limit(0)).count() == 0
