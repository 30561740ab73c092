"""The corpus pipeline: filter toxic documents, keep one of each group of near copies, redact
secrets, mix the sources, pack what is left.

Every stage works on all that the one before it kept, written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import mixing, ngram_join, secrets, toxicity
from fieldspark.llm.common import small_batches
from fieldspark.llm.queries import labelled, pack_documents, table
from fieldspark.sources.stage import session_folder

# Tokens that mixing keeps, as a share of those it gets, and the power that shapes its targets.
KEEP, POWER = 0.9, 0.9


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not find toxic. It learns from the
    labels of all documents there are; with none, only its fixed lexicon speaks."""
    small_batches(spark)
    learn = labelled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.without_toxic(docs, toxicity.train(learn))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by five-word Jaccard of 0.8."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars brought up to date. A text
    without a secret stays as it is, a null text null."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    model = secrets.train(secrets.labelled_runs(texts).union(secrets.generated(spark)))
    found = secrets.find_secrets(docs, "text", model, "_secrets", rate=secrets.RATE)
    hit = F.size("_secrets") > 0
    new = F.when(hit, F.expr(secrets.redacted("text", "_secrets"))).otherwise(F.col("text"))
    out = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that raking to source, language and topic targets draws."""
    return mixing.mix(docs, keep=KEEP, power=POWER).where("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, every window mixed by the sources' token shares."""
    return pack_documents(docs)


STAGES = [("toxicity", filter_toxic), ("ngram_join", drop_copies), ("secrets", redact_secrets),
          ("mixing", mix_sources), ("packing", pack)]

# Toxicity's model and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a stage table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{session_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
