"""The corpus pipeline: stages over documents, each written and read again before the next.

Edge cases follow those of the operators: documents without a text are rejected by the quality rules; rows without a key are
judged like others, but never as copies; repeated rows are one document, and of several texts of a key one stays; an empty
table gives no rows, and an empty benchmark hits nothing; other columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import byte_bpe, common, decontaminate, line_dedup, line_quality, near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and frequent lines of the others; n_chars follows the text."""
    return line_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text."""
    return line_dedup.clean_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark passages go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (binary, little-endian 32 bit) and the text that they decode to, as a digest."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: A similarity join and a merge replay have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{k}")
    return docs
