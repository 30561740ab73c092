"""Similarity join, cover tree, language model, packing, language and toxicity models against
brute-force versions, and on odd rows."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldspark.llm import cover_tree, langid, ngram_join, ngram_lm, packing, toxicity
from fieldspark.llm.common import components
from fieldspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, cls int"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "one two three", "en", "a"), (3, "one two three", "en", "a"),
            (None, "one two three", "de", "b"), (4, long, "en", "a"), (5, long + " end", "en", "b"), (6, " \n\t ", "fr", "b"),
            (7, "12345 !!", "fr", "c"), ((1 << 53) + 1, "é𝒳 idiot  two  spaces ", None, "c"), (9, "x" * 20_000, "en", None)]
    return spark.createDataFrame([(*r, 1, 0.5, "clash", 3) for r in rows], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100, i) for i in range(101, 140)]
    f = Forest()
    for a, b in edges:
        f.link(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: f.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_join(rows, words=5, similarity=0.8):
    sets, f, n = [], Forest(), Counter()
    for _, text in rows:
        w = (text or "").split()
        k = min(words, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        alike = len(a & b) / len(a | b) >= similarity if a | b else True
        if alike:
            n[i] += 1
            n[j] += 1
            f.link(i, j)
    return n, f


def check_join(frame, **how):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    n, f = brute_join(rows)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[f.root(i)] = min(d, least.get(f.root(i), d))
    want = Counter((d, n[i], least.get(f.root(i))) for i, (d, _) in enumerate(rows))
    got = ngram_join.linked(frame, **how).collect()
    assert Counter((r.doc_id, r.n_links, r.component_id) for r in got) == want
    one = ngram_join.one_of_each(frame, **how)
    assert one.columns == frame.columns and one.count() == len({f.root(i) for i in range(len(rows))})


def test_similarity_join(spark):
    check_join(docs(spark).select("doc_id", "text"))


def test_similarity_join_of_odd_rows(odd):
    check_join(odd)
    assert ngram_join.linked(odd.limit(0)).count() == 0


def test_similarity_join_cuts_a_large_group_into_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 40] + [f"new{i}"] + base[i % 40:])) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), block=8)


def test_bands_meet_their_recall():
    b, r = ngram_join.bands_for(0.8, 0.9999, 128)
    assert b * r <= 128 and 1 - (1 - 0.8 ** r) ** b >= 0.9999


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * (0.05 if i % 2 else 0.4)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(450, [3 * x for x in rows[7][1]])]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []),
             (505, [1.0, 0.0]), (506, [1e-200] * 16), (507, [1e200] * 16), (508, [float("inf")] * 16)]
    out = {r.vec_id: r for r in cover_tree.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()}
    n, f = Counter(), Forest()
    units = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v) / max(map(abs, v))
            units[i] = a / np.linalg.norm(a)
    for a, b in itertools.combinations(units, 2):
        if len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9:
            n[a] += 1
            n[b] += 1
            f.link(a, b)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {
        i: (n[i], f.root(i), f.root(i) == i) for i, _ in rows}
    assert cover_tree.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_levels_nest_and_cover():
    x = np.random.default_rng(1).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.Tree(x)
    for i in range(1, len(tree.levels)):
        above, (centres, parents) = tree.levels[i - 1][0], tree.levels[i]
        assert (centres[:len(above)] == above).all()
        assert (np.linalg.norm(centres - above[parents], axis=1) <= 2.0 / (1 << (i - 1)) + 1e-9).all()


def brute_lm(rows, train):
    count = Counter()
    for (_, text), t in zip(rows, train):
        if t:
            count.update(ngram_lm.words(text))
            count[None] += 1
    whole, kinds = sum(count.values()), len(count)
    return whole, [(len(w) + 1, sum(count[x] > 0 for x in [*w, None]),
                    sum(math.log10((count[x] + 1) / (whole + kinds + 1)) for x in [*w, None]))
                   for w in (ngram_lm.words(t) for _, t in rows)]


def check_lm(frame):
    rows = [(r.doc_id, r.text, r.train) for r in frame.collect()]
    whole, want = brute_lm([r[:2] for r in rows], [r[2] for r in rows])
    got = ngram_lm.score(frame).collect()
    key = lambda x: (str(x[0]), x[1], round(x[3], 4))
    got_rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for g, w in zip(got_rows, sorted(((r[0], *w) for r, w in zip(rows, want)), key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
    assert {r.train_tokens for r in got} == {whole}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


def test_language_model(spark):
    frame = docs(spark).selectExpr("doc_id", "text", "doc_id % 5 <> 0 AS train")
    got = check_lm(frame)
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_odd_rows(odd):
    check_lm(odd.selectExpr("doc_id", "text", "true AS train"))
    check_lm(odd.selectExpr("doc_id", "text", "false AS train"))
    assert ngram_lm.score(odd.selectExpr("doc_id", "text", "true AS train").limit(0)).count() == 0


def test_language_model_probabilities_sum_to_one():
    weights = ngram_lm.learn(np.array([(3 * 1024 + 8) * 1024 + 20]), np.array([50.0]), 10)
    assert weights.sum(1) == pytest.approx(1.0) and (weights[:, 2] >= ngram_lm.FLOOR / 2).all()


@pytest.fixture(scope="module")
def coder():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def check_pack(frame, coder, **how):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(coder[0])
    ids = [(r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")) for r in frame.collect()]
    got = packing.pack(frame, *coder, **how).collect()
    length, by, sequences = how.get("length", packing.LENGTH), defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in {d for d, _ in ids}:
        mine = [x for i, x in ids if i == d]
        want = Counter()
        for r in by[d]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in mine)
            want[r.doc_tokens] += r.length
        assert want == sum((Counter({len(x): len(x)}) for x in mine), Counter())
    fill = []
    for s in range(len(sequences)):
        at = 0
        for offset, n in sorted(sequences[s]):
            assert offset == at and n > 0
            at += n
        fill.append(at)
    assert all(x == length for x in fill[:-1]) and sum(fill) == sum(len(x) for _, x in ids)
    return got


def test_packing(spark, coder):
    frame = docs(spark).select("doc_id", "source", "text")
    got = check_pack(frame, coder, length=128, window=8)
    source = {r.doc_id: r.source for r in frame.collect()}
    total, window = Counter(), defaultdict(Counter)
    for r in got:
        total[source[r.doc_id]] += r.length
        window[r.sequence_id // 8][source[r.doc_id]] += r.length
    for k in range(max(window)):
        for s in total:
            assert abs(window[k][s] - 1024 * total[s] / sum(total.values())) <= len(total) + 2


def test_packing_to_given_weights(spark, coder):
    frame = docs(spark).select("doc_id", "source", "text").where("source in ('src6', 'src8', 'src9')")
    got = check_pack(frame, coder, length=64, window=4, weights={"src6": 2.0, "src8": 1.0, "src9": 1.0})
    source = {r.doc_id: r.source for r in frame.collect()}
    first = Counter()
    for r in got:
        if r.sequence_id < 40:
            first[source[r.doc_id]] += r.length
    assert first["src6"] == pytest.approx(2 * first["src8"], abs=20)


def test_packing_keeps_weights_and_large_sources_beyond_the_queues(spark, coder, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 4)
    rows = [(i, f"small{i % 40}", "one two three") for i in range(200)]
    rows += [(1000 + i, "a", "four five six seven " * 5) for i in range(100)] + [(2000 + i, "b", "eight nine ten " * 5) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = Counter()
    for r in check_pack(frame, coder, length=64, window=4, weights={"a": 2.0, "b": 1.0}):
        if r.sequence_id < 12:
            first[r.doc_id // 1000] += r.length
    assert first[0] == 0 and first[1] == pytest.approx(2 * first[2], abs=20)
    total, window = Counter(), defaultdict(Counter)
    for r in check_pack(frame, coder, length=64, window=4):
        total[r.doc_id // 1000] += r.length
        window[r.sequence_id // 4][r.doc_id // 1000] += r.length
    for k in range(max(window)):
        for s in (1, 2):
            assert abs(window[k][s] - 256 * total[s] / sum(total.values())) <= 8


def test_packing_of_odd_rows(odd, coder):
    check_pack(odd, coder, length=64, window=2)
    assert packing.pack(odd.limit(0), *coder).count() == 0


def test_tokens_equal_the_tokenizer(coder):
    from tokenizers import Tokenizer
    t, own = Tokenizer.from_file(coder[0]), packing.Tokens(*coder)
    for text in ("", " ", "a  b", " a b ", "it's  we'll 12 345!?", "x\n y\n\nz ", "é𝒳 ﷺ 的 人", "a b c  d", "<|endoftext|> a b",
                 "tab\t two", "a " * 50 + "b" * 3000, "\x1c a \x1f b"):
        assert own.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_language(spark):
    frame = docs(spark)
    model = langid.train(frame.where("doc_id % 3 <> 1"))
    out = langid.identify(frame, model).join(frame.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_signs_are_no_letters(spark):
    rows = spark.createDataFrame([(1, "½ ² ①"), (2, "½ day"), (3, "12 --")], "doc_id long, text string")
    learn = spark.createDataFrame([("en", "a day in the sun"), ("de", "ein tag am meer")], "lang string, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(rows, langid.train(learn)).collect()}
    assert got[1] == got[3] == "und" and got[2] == "en"


def test_language_of_odd_rows(odd):
    got = langid.identify(odd, langid.train(odd)).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 6, 7} <= und and 4 not in und
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd.limit(0))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), langid.train(odd)).count() == 0


def test_unseen_words_fall_back_to_ngrams(spark):
    rows = [("en", "the running jumping singing walking ringing " * 20), ("fr", "la nation portion action ration motion " * 20)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    frame = spark.createDataFrame([(1, "stringing"), (2, "caution")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(frame, model).collect()} == {1: "en", 2: "fr"}


def test_a_language_of_few_copied_texts_is_learned(spark):
    """Rows of 20 small languages, each five copies of one text, among 60,000 others."""
    large = spark.range(60_000).selectExpr("if(id % 2 = 0, 'en', 'fr') AS lang", "concat_ws(' ', transform(sequence(0, 7), "
                                           "i -> translate(concat(if(id % 2 = 0, 'k', 'm'), (id * 31 + i * 7) % 997), '0123456789', 'abcdefghij'))) AS text")
    letters = "nopqrstuvwxyzåäöøæßñçé"
    small = [(f"l{i}", " ".join(letters[i] * 2 + letters[(i + j) % 20] for j in range(6))) for i in range(20)]
    few = spark.createDataFrame(small * 5, "lang string, text string")
    model = langid.train(large.union(few))
    assert model.langs == sorted(["en", "fr", *(x for x, _ in small)])
    assert model.predict([t for _, t in small])[0] == [x for x, _ in small]


def test_a_small_language_has_words_of_its_own_in_a_full_table(spark, monkeypatch):
    monkeypatch.setattr(langid, "SPELLED", 40)
    rows = [("en", " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)))] * 50
    rows += [("is", "það er ekki hægt")] * 2
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert {"það", "er", "ekki", "hægt"} <= model.known.keys() and len(model.known) <= 80


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        toxic = i % 6 == 0
        words = list(rng.choice(plain, 40))
        if toxic:
            words[3] = ("grubvek" + str(rng.choice(list("abcdefgh"))) + "x") if (i // 6) % 2 else "zorble"
        rows.append((i, " ".join(words), int(toxic if rng.random() > 0.02 else not toxic), int(toxic)))
    frame = spark.createDataFrame(rows, "key long, text string, toxic int, truth int")
    model = toxicity.train(frame.where("key % 5 <> 0"))
    out = toxicity.score(frame, model, "key").join(frame.select("key", "truth"), "key").where("key % 5 = 0").collect()
    right = sum((r.score >= 0.5) == (r.truth == 1) for r in out)
    assert right >= 0.97 * len(out)
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and kept.where("truth = 0").count() >= 0.99 * 1000


def test_rare_toxic_words_are_mined_from_all_rows(spark):
    """60,000 clean rows and 9 toxic ones: three for each of three words."""
    clean = spark.range(60_000).selectExpr("id AS key", "concat('plain text ', translate(id % 97, '0123456789', 'abcdefghij')) AS text", "0 AS toxic")
    toxic = spark.createDataFrame([(100_000 + i, f"plain text {w}", 1) for i, w in enumerate(("zorble", "grubvek", "quaxit") * 3)], "key long, text string, toxic int")
    model = toxicity.train(clean.union(toxic))
    assert all(model.votes.of(w) for w in ("zorble", "grubvek", "quaxit"))
    assert all(model.score(f"plain text {w}") >= 0.5 for w in ("zorble", "grubvek", "quaxit"))
    assert model.score("plain text b") < 0.5


def test_toxicity_of_odd_rows(odd):
    labels = odd.selectExpr("doc_id AS key", "text", "cast(null AS int) AS toxic")
    model = toxicity.train(labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.doc_id for r in got if r.score >= 0.5] == [(1 << 53) + 1]
    assert toxicity.without_toxic(odd, model).schema == odd.schema
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_a_voter_that_repeats_another_counts_less():
    hits = np.array([[1, 1, 0], [0, 0, 1], [0, 0, 0]] * 30, dtype=float)
    gold = np.array([1, 1, 0] * 30)
    soft, weight = toxicity.label_model(hits, gold, np.ones(len(gold)))
    assert weight[0] < weight[2] and soft[0] > 0.9 and soft[2] < 0.1


@pytest.mark.parametrize("name", ["op3_ngram_join", "op5_language", "op7_packing", "op8_lm_score", "op9_toxicity"])
def test_every_document_has_a_result(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert out.select("doc_id").distinct().count() == docs(spark).count()


def test_one_of_each_keeps_every_column_of_rows_that_share_key_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a", [1]), (1, long, "b", [2]), (2, long, "c", None), (3, "alone here", "d", [4]), (4, None, "e", [5]),
            (None, "", "f", []), (None, long + " more", "g", [7]), (6, "alone too", None, [8])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tk string, cls array<int>")
    got = ngram_join.one_of_each(frame).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "6"]
    assert all(tuple(r) in [tuple(x) for x in rows] for r in got)
