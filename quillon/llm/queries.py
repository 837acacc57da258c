"""The registered queries of the training-data operators, and their SQL.

Each one applies its operator, with the operator's default parameters, to the
whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kdtree, lbl, line_crf, mixing, rabitq, simhash, template, token_files, toxicity, warc, wavelet, yinyang
from .shared import table


def byte_bpe() -> tuple[str, str]:
    """Ranks file and pattern of the byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.kd_shards(table(spark, sf_dir, "documents"), shards=8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_back(pages, warc.write_index(warc.write_archives(pages))).drop("html")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.report(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), F.col("mix_copies").alias("n_copies"), F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"))


def op7_lbl_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), *byte_bpe())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), word_bpe()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def op13_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_embedding_near_dedup, op2_kdtree_shards, op3_simhash, op4_warc_index, op5_quality_crf, op6_poisson_mixing, op7_lbl_scoring, op8_byte_bpe, op9_token_files, op10_toxicity, op11_html_template, op12_yinyang_clusters, op13_wavelet_search]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": rabitq.SQL, "op4_warc_index": warc.SQL, "op6_poisson_mixing": mixing.MIX_SQL, "op12_yinyang_clusters": yinyang.SQL, "op13_wavelet_search": wavelet.SQL}
