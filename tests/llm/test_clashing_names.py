"""Stages pass on columns of any name with their values."""

import pytest
from helpers import documents
from pyspark.sql import functions as F

from motionlake.llm import decontaminate, exact_dedup, line_dedup, line_quality, near_dedup

NAMES = [f"__{n}" for n in "drop n_lines n_dropped rk rk2 rk_ bad gone twice k row text clean t h host i line label id s d from to".split()] + ["a.b", "a`b", "h", "sha", "n_words", "kept", "class_id", "id", "bucket"]
STAGES = {
    "quality": line_quality.keep_good,
    "lines": line_dedup.clean_documents,
    "near": near_dedup.keep_one,
    "exact": exact_dedup.keep_one,
    "benchmark": lambda docs: decontaminate.keep_clean(docs, docs.sparkSession.createDataFrame([("q", "nobody says this")], "item_id string, text string").withColumn("item_id", F.lit(1).cast("long"))),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_keep_their_values(spark, name):
    texts = [" ".join(f"word{i}x{k}" for k in range(60)) for i in range(6)]
    docs = documents(spark, [*texts, texts[0]]).select("*", *[F.lit(n).alias(n) for n in NAMES])
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) >= 6 and all(r[n] == n for r in rows for n in NAMES) and {r.text for r in rows} == set(texts)
