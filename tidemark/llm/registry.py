"""The queries of this subpackage: opN_<name>, each its operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import neardups

    return neardups.linked(spark, _documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import passages

    return passages.removed(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm import packing

    return packing.packed(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import lines

    return lines.marked(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm import idfile

    return idfile.read_documents(idfile.write(spark, _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    return quality.measured(spark, _documents(spark, sf_dir))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import topk

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.nearest(spark, vectors, vectors.where("vec_id % 50 = 0"))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import sharding

    return sharding.sharded(_documents(spark, sf_dir))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import substrings

    return substrings.removed(_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm import bytebpe

    return bytebpe.encoded(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import centroids

    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import warc

    return warc.archived(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import phrases

    return phrases.collocations(spark, _documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import centroids, lines, neardups, phrases, quality, sharding, topk, warc

    return {"op11_centroid_clustering": centroids.oracle(), "op12_warc": warc.ORACLE, "op13_phrase_collocations": phrases.ORACLE, "op1_ngram_jaccard_join": neardups.ORACLE, "op4_line_dedup": lines.ORACLE, "op6_quality_rules": quality.ORACLE, "op7_exact_topk": topk.ORACLE, "op8_extendible_sharding": sharding.ORACLE}
