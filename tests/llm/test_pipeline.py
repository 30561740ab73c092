"""The corpus pipeline, stage by stage, against what each stage must leave."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from fieldspark.llm import secrets
from fieldspark.llm.queries import table
from fieldspark.sources.stage import materialise
from tests.llm.test_models import brute_join
from tests.llm.test_native import base_spans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, FOLDER))
    return [*out, docs]


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_return_the_columns_of_documents(steps):
    assert [s.columns for s in steps[1:-1]] == [steps[0].columns] * 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]


def test_toxicity_drops_labelled_rows_and_keeps_clean_ones(spark, steps):
    labels = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    before, after = texts(steps[0]), texts(steps[1])
    assert {k: before[k] for k in after} == after
    clean = [d for d, y in labels.items() if y == 0]
    assert sum(d in after for d in clean) >= 0.98 * len(clean)
    assert len(before) > len(after)


def test_one_document_of_each_group_stays(steps):
    rows = sorted(texts(steps[1]).items())
    _, forest = brute_join(rows)
    want = {min(rows[i][0] for i in range(len(rows)) if forest.root(i) == r) for r in {forest.root(i) for i in range(len(rows))}}
    assert set(texts(steps[2])) == want


def test_no_base_secret_is_left(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert before.keys() == after.keys() and not any(base_spans(t) for t in after.values())
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {d for d in before if "[SECRET]" in after[d]} >= {d for d in before if base_spans(before[d])}
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_mixing_draws_some_and_packing_takes_all_of_them(steps):
    drawn = texts(steps[4])
    assert set(drawn) < set(texts(steps[3])) and len(drawn) > 0.6 * steps[3].count()
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == set(drawn)
    length, whole = Counter(), {}
    for r in pieces:
        length[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
    assert length == whole


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = "0123456789abcdef" * 2
    rows = [(1, None, None, None, 0, "a"), (1, None, None, None, 0, "a"), (None, "same", "en", "s", 4, "b"), (2, "", "en", "s", 0, "c"),
            (3, "x" * 30_000, "fr", None, 30_000, "d"), (4, f"token = {key} end", "en", "s", 44, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns
        docs = out
    assert not any(key in (r.text or "") for r in docs.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert secrets.KINDS[3] == "markov"
