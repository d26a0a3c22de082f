"""Documents that the tests of several operators share."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, **columns):
    """Documents numbered from 0; texts may hold None."""
    rows = [(i, t, "en", columns.get("source", "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a null key."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s0", 0),
        (3, "   \n\n\t ", "en", "s0", 7),
        (4, "word " * 60_000, "en", "s0", 300_000),
        (5, "the same row twice\nwith two lines", "en", "s1", 33),
        (5, "the same row twice\nwith two lines", "en", "s1", 33),
        (None, "a row without a key", "en", "s1", 19),
        (7, "x" * 100_000, "en", None, 100_000),
    ]
    return spark.createDataFrame(rows, DOCS)
