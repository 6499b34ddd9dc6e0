"""A training-data pipeline over `documents`, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, line_dedup, minhash, mixing
from lectern.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that can be learned from docs."""
    return langid.reject_unknown(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; documents that were nothing else go."""
    out = line_dedup.remove_boilerplate(docs)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s", " ")) != "")
    out = out.where(left).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each near-duplicate component (five words, 0.8); those without an id stay.

    Of several texts of one doc_id that with the smallest hash stays, of equal rows one.
    """
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    one = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("r"))).alias("m"))
    return one.where("doc_id is not null").join(kept, "doc_id", "left_semi").select("m.r.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some of them twice, until each source has its target of words."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the digests of ids and decoded bytes."""
    return bpe.encode_decode_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can't express the language models, nor the seeded fill of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
