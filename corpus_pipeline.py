"""A training corpus from documents: quality rules, near-duplicates, benchmark decontamination, secrets, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.bpe_codec import bpe_encode
from loamgrid.llm.common import broadcast_if_small, written
from loamgrid.llm.decontaminate import decontaminate
from loamgrid.llm.ngram_join import ngram_join
from loamgrid.llm.quality_rules import quality_rules
from loamgrid.llm.secret_scan import redact, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules reject goes."""
    return quality_rules(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return ngram_join(docs).filter("kept").select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = docs.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")})
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["__a", "__b"])
    found = written(found.select("__a", "__b").distinct(), "found")
    return keyed.join(broadcast_if_small(found, 300_000), ["__a", "__b"], "left_anti").select(docs.columns)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are cut out of the texts; n_chars follows."""
    found = redact(secret_scan(docs))
    cut = F.exists("secrets", lambda s: s["live"])
    return found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers), and a digest of what they decode to."""
    import public_tokenizers

    out = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_free), ("secret scans", secret_free), ("BPE encoding and decoding", encoded)]

#: The stages' hashes, signatures and tokens can't be put in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
