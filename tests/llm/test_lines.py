"""Quality rules and line dedup: SQL on the small tables, small cases by hand, awkward rows."""

import duckdb
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from motionlake.llm import line_dedup as D
from motionlake.llm import line_quality as L
from motionlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF}/{name_of}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in result.fetchall())


def test_depleted_documents_go(spark):
    common = " ".join(f"word{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(60))
    texts = [f"{common}\nend {i}" for i in range(12)] + [f"{common.upper()}\n" + own.replace("own", f"x{i}y") + "\n" + own.replace("own", f"z{i}") for i in range(3)]
    rows = {r.doc_id: r for r in L.quality_verdicts(documents(spark, texts)).collect()}
    assert [rows[i].kept for i in range(15)] == [False] * 12 + [True] * 3
    assert rows[0].removed_words == 60 and not rows[0].base_failed


def test_frequent_lines_leave_the_texts_that_stay(spark):
    own = [" ".join(f"x{i}y{k}" for k in range(60)) for i in range(13)]
    texts = [f"Menu  |  Home\n\n{t}" for t in own[:12]] + [own[12]]
    kept = {r.doc_id: r for r in L.keep_good(documents(spark, texts)).collect()}
    assert {i: r.text for i, r in kept.items()} == {i: f"\n{t}" if i < 12 else t for i, t in enumerate(own)}
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_boilerplate_goes_and_copies_do_not_count(spark):
    texts = [f"Menu  |  Home\nthe text of page {i}\n\nmenu | home" for i in range(6)] + ["a page\nof its own"] * 9
    out = {r.doc_id: r for r in D.clean_documents(documents(spark, texts)).collect()}
    assert out[2].text == "the text of page 2\n" and out[2].n_chars == len(out[2].text)
    assert out[8].text == "a page\nof its own"


def test_awkward_rows(spark):
    docs = awkward(spark).withColumns({"n_words": F.lit(1), "kept": F.lit("x"), "removed_words": F.lit(2), "line": F.lit("y")})
    rows = L.quality_verdicts(docs).collect()
    assert len(rows) == 8 and all(r.kept is not None for r in rows)
    assert {r.doc_id: r.n_words for r in rows} == {1: 0, 2: 0, 3: 0, 4: 60_000, 5: 7, None: 5, 7: 1}
    good = L.keep_good(docs)
    assert good.columns == docs.columns and good.count() == 0
    clean = D.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == 8
    assert clean.where("doc_id = 1 AND text IS NULL").count() == 1
    for empty in (L.quality_verdicts(docs.limit(0)), L.keep_good(docs.limit(0)), D.clean_documents(docs.limit(0))):
        assert empty.count() == 0
