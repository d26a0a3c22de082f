"""Exact copies: SQL on the small tables (test_lines), plain grouping of odd rows, small filters that err, clashing names."""

import hashlib
import random
from collections import defaultdict

import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from motionlake.llm import exact_dedup as X

#: Cells and blocks so few that strangers share them; a filter that is joined instead of broadcast.
NARROW = X.Filters(cells_per_row=1, bits_per_cell=1, bits=1)
JOINED = X.Filters(broadcast_blocks=0)


def plainly(rows):
    """(key, keep_id, group_size, kept, sha) of (key, text) rows."""
    by = defaultdict(list)
    for key, text in rows:
        by[text or ""].append(key)
    out = []
    for text, keys in by.items():
        keep = max((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keep, len(keys), k == keep, sha) for k in keys]
    return sorted(out, key=repr)


def found(df, filters):
    return sorted((tuple(r) for r in X.verdicts(df, filters).collect()), key=repr)


@pytest.mark.parametrize("filters", [X.Filters(), NARROW, JOINED])
def test_verdicts_equal_plain_grouping(spark, filters):
    draw = random.Random(5)
    texts = [draw.choice([f"text {i}", f"text {draw.randrange(400)}", "the one", None, "", "Ü " * draw.randrange(3)]) for i in range(2_000)]
    docs = documents(spark, texts)
    assert found(docs, filters) == plainly((r.doc_id, r.text) for r in docs.collect())
    kept = X.keep_one(docs, filters).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in plainly((r.doc_id, r.text) for r in docs.collect()) if r[3])


def test_hot_groups(spark):
    docs = documents(spark, [f"own {i}" for i in range(3_000)] + ["hot"] * 1_500 + ["hotter"] * 1_600)
    rows = found(docs, X.Filters())
    assert rows == plainly((r.doc_id, r.text) for r in docs.collect())
    assert X.keep_one(docs).count() == 3_002


def test_filters_find_every_repeated_text(spark):
    docs = documents(spark, [f"text {i % 700}" for i in range(1_000)])
    rows = X.digests(docs, "text", "doc_id")
    sizes, again = X.plan(rows.select("h"), X.Filters())
    maybe = X.told_apart(rows, F.col("h"), again, sizes, X.Filters(), "maybe").where("maybe").count()
    assert 600 <= maybe <= 640  # few strangers


@pytest.mark.parametrize("filters", [X.Filters(), NARROW])
def test_awkward_rows(spark, filters):
    docs = awkward(spark)
    assert found(docs, filters) == plainly((r.doc_id, r.text) for r in docs.collect())
    names = ["h", "maybe", "sha", "Cell", "block", "bitmap", "stays_key", "stays_sha", "own_block", "key", "keep_id", "a.b"]
    more = docs.select("*", *[F.lit(n).alias(n) for n in names])
    one = X.keep_one(more, filters)
    assert one.columns == more.columns
    rows = one.collect()
    assert sorted(repr(r.doc_id) for r in rows) == ["2", "3", "4", "5", "7", "None"] and all(r["a.b"] == "a.b" and r.h == "h" for r in rows)
    for empty in (X.verdicts(docs.limit(0), filters), X.keep_one(docs.limit(0), filters)):
        assert empty.count() == 0
