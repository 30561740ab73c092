"""Labels in another table give the same counts as labels beside the texts, however small the filters."""

from __future__ import annotations

import pytest

from fieldspark.llm import ngram_join, toxicity


def frames(spark):
    texts = [(i, None if i % 97 == 0 else f"w{'abcdefg'[i % 7]} common{'xyz'[i % 3]} " + ("zorble" if i % 10 == 0 else "mild")) for i in range(600)]
    texts += [(5, "repeated id"), (None, "null id zorble"), (None, "null id")]
    marks = [(i, int(i % 10 == 0)) for i in range(0, 600, 2)] + [(9999, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame([(*r, 0) for r in texts], "key long, text string, toxic int").drop("toxic")
    return docs, spark.createDataFrame(marks, "key long, toxic int"), texts, {k: v for k, v in marks if k is not None and v is not None}


@pytest.mark.parametrize("bits", [1 << 27, 256])
def test_counts(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "MARKS", bits)
    docs, marks, texts, label = frames(spark)
    joined = toxicity.Joined(docs, marks)
    want = {0: {}, 1: {}}
    for key, text in texts:
        if key in label and text:
            for k in {k for w in set(toxicity.WORD.findall(text.lower())) for k in toxicity.keys_of(w)}:
                want[label[key]][k] = want[label[key]].get(k, 0) + 1
    assert joined.sizes() == {k: sum(label.get(key) == k for key, _ in texts) for k in (0, 1)}
    for kind in (0, 1):
        assert {r["key"]: r["n"] for r in joined.counts(kind).collect()} == want[kind]
        assert sorted(r["text"] for r in joined.texts(kind).collect()) == sorted(t or "" for key, t in texts if label.get(key) == kind)


def test_same_model(spark):
    docs, marks, _, _ = frames(spark)
    beside = docs.join(marks, "key").select("text", "toxic")
    a, b = toxicity.train(toxicity.Joined(docs, marks)), toxicity.train(beside)
    assert a.votes.mined == b.votes.mined and a.votes.mined
    assert abs(a.weights - b.weights).max() < 1e-9


def test_nothing_labelled(spark):
    docs, marks, _, _ = frames(spark)
    for m in (marks.limit(0), marks.where("toxic = 0")):
        model = toxicity.train(toxicity.Joined(docs, m))
        assert model.votes.mined == [] and model.score("you idiot") > 0.5 > model.score("")
