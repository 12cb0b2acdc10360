"""A corpus pipeline: toxicity, exact dedup, near dedup, mixing and encoding, each over all that the one before kept.

All stages but the last return the columns of documents, whatever they are called. Null texts count as empty; rows without
an identifier are no documents and go. Rows that share an identifier are judged together by the first stage (they go if one
is toxic) and by their texts after it; equal ones become one row. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import bpe, exact_dedup, minhash, mixing, toxicity
from treeline.llm._common import fresh_path, materialise, smallest, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, empty texts by the score of such examples. The model is learnt from the labelled rows that are not
    held out, of the table and not of what is given."""
    docs = docs.where(F.col("doc_id").isNotNull())
    verdict = toxicity.score(docs, toxicity.model_of(spark, sf_dir)).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")
    return docs.join(materialise(verdict.distinct(), "toxic"), "doc_id", "left_anti").select(*docs.columns)


def _lower(text: str) -> Column:
    """A text's digest with A-Z lower-cased."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents that verdicts (doc_id, key: a digest of the text) keep; of rows equal in both the smallest."""
    each = docs.select(F.struct("*").alias("doc"), "doc_id", _lower("text").alias("key"))
    kept = each.join(verdicts.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(smallest(docs, "doc").alias("doc"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the smallest identifier stays."""
    return _keep(docs, exact_dedup.exact_dedup(docs).where("kept").withColumnRenamed("text_sha256", "key"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest identifier stays; texts without words all stay."""
    return docs.join(minhash.near_dedup(docs).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source; documents without words go."""
    return mixing.mixed_documents(docs.where(F.col("doc_id").isNotNull()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, with the digests of their round trip; an empty text has none."""
    return bpe.encode_decode(docs.where(F.col("doc_id").isNotNull()), *bpe.tokenizer(), ids=True)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("encoding", encoded)]

#: Scores, the mix and token ids are beyond SQL. tests/llm/test_stages.py holds each stage against a plain version: cosines
#: over all examples, equal texts, links over all pairs, the mix's rules, the library's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
