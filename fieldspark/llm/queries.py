"""The operators of this package bound to the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import collocations, cover_tree, dialogues, langid, mixing, ngram_join, ngram_lm, oracle, packing, quality_rules, secrets, toxicity, urls, winnowing
from fieldspark.llm.common import fold, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


@register("op1_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, tokens, topic, weight (tokens its cell should give), p and kept of every document."""
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("row.doc_id", "tokens", "topic", F.round("weight", 3).alias("weight"), F.round("p", 6).alias("p"), "kept")


@register("op2_secrets")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    model = secrets.train(secrets.labelled_runs(texts).union(secrets.generated(spark)))
    found = secrets.find_secrets(docs, "text", model, rate=secrets.RATE)
    n = [F.expr(f"cast(size(filter(secrets, s -> s.kind = {i})) as bigint)").alias(f"n_{k}")
         for i, k in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *n, F.sha2(F.expr(secrets.span_text("secrets", 3)), 256).alias("base_sha256"),
                        F.expr(secrets.span_text("secrets", 4)).alias("spans"))


@register("op6_urls")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = urls.judge(table(spark, folder, "pages"))
    return out.withColumn("purity", F.round("purity", 6))


@register("op10_fingerprints")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def derived(rows: DataFrame) -> DataFrame:
        half = F.floor(F.length("text") / 2).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), (F.length("text") - half).cast("int")),
                          F.substring("next_text", F.lit(1), half))
        return (rows.withColumn("edited", edited).withColumn("fp", F.expr(winnowing.fingerprint("text")))
                .withColumn("h", F.expr(winnowing.hashes("fp"))))

    rows = winnowing.with_next(docs, "doc_id", {"next_text": "text", "next_h": "h"}, derived)
    rows = rows.withColumn("efp", F.expr(winnowing.fingerprint("edited"))).withColumn("eh", F.expr(winnowing.hashes("efp")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.sha2(F.expr(winnowing.printed("fp")), 256).alias("fingerprint"),
        F.sha2(F.expr(winnowing.printed("efp")), 256).alias("edited_fingerprint"),
        winnowing.likeness("h", "eh").alias("near_edited"), winnowing.likeness("h", "next_h").alias("near_next"),
        F.size("fp").cast("long").alias("n_marks"))


@register("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def labelled(docs: DataFrame, labels: DataFrame) -> toxicity.Joined:
    """The documents with a label; a document labelled more than once counts as toxic if any of its
    labels says so."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    return toxicity.Joined(docs.select(F.col("doc_id").alias("key"), "text"), marks)


@register("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learn = labelled(docs.where(fold(F.col("doc_id"), 5) != 0), table(spark, folder, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, toxicity.train(learn))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public
    small_batches(docs.sparkSession)
    return packing.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@register("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents").select("doc_id", "source", "text"))


@register("op8_lm_score")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 7) != 2).alias("train"))
    out = ngram_lm.score(docs)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op4_near_vectors")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return cover_tree.link(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@register("op3_ngram_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.linked(table(spark, folder, "documents").select("doc_id", "text"))


@register("op13_quality")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from all labelled rows; a document labelled more than once is good only if all its
    labels say so."""
    rows = quality_rules.measured(table(spark, folder, "documents").select("doc_id", "text"))
    marks = (table(spark, folder, "labels").where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rules = quality_rules.train(rows.join(marks, "doc_id"))
    out = quality_rules.judge(rows, rules)
    return out.select("doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      "base_failed", "kept", "rule")


@register("op11_conversations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return dialogues.repaired_all(rows, dialogues.damaged(rows))


@register("op12_collocations")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))
