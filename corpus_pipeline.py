"""The corpus pipeline: toxicity, quality, near duplicates, mixing, tokens.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns the rows it keeps, all but the last with the columns of ``documents``.
Each is written as Parquet and reread as the next one's docs.  Labels, where a
stage learns, come from ``labels`` of the same folder, matched with the documents
that reach the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, line_crf, mixing, simhash, toxicity
from quillon.llm.queries import byte_bpe
from quillon.llm.shared import scratch, small_batches, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; a null text has no toxic word and stays."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are mostly boilerplate lines."""
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles,
    similarity 0.8): the smallest id, and if that id has several texts in the
    group, the one with the smallest MD5; null ids all stay."""
    named = docs.where("doc_id is not null")
    found = simhash.near_duplicates(named)
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    kept = found.select(F.col("component_id").alias("doc_id"), F.col("component_digest").alias("__digest")).distinct()
    once = named.withColumn("__digest", own).join(kept, ["doc_id", "__digest"], "left_semi").dropDuplicates(["doc_id", "__digest"])
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources reach their target weights."""
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether the ids decode to the text."""
    small_batches(spark)
    return bpe.bpe_encode(docs, *byte_bpe(), carry=("doc_id", "lang", "source"))


STAGES = [("toxicity", toxic), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixed), ("tokens", tokens)]

#: Trees, a random field and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
