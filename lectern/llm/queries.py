"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import ann, bpe, embed_dedup, langid, line_dedup, minhash, mixing, secret_scan, token_counts, token_io
from lectern.session import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), width=3, num=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_embeddings(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_io.write(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_io.digest(token_io.read(spark, path))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_counts,
        op2_minhash_near_dedup,
        op3_mix_sources,
        op4_embedding_near_dedup,
        op5_line_dedup,
        op6_language_id,
        op7_nearest_neighbours,
        op8_secret_scan,
        op9_token_files,
        op10_byte_bpe,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": minhash.SQL,
        "op4_embedding_near_dedup": embed_dedup.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op7_nearest_neighbours": ann.SQL,
    }
