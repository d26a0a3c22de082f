"""Drop the boilerplate of a site: lines that a large share of the host's pages carry.

DataFrame expressions only. Line counts are pre-aggregated on (host, line hash); what comes back to the documents is,
for each of them, the places of its own dropped lines, so the text itself is shuffled once and no group is gathered.
Lines meet the boilerplate by hash: a line that very many pages have is split over tasks by adaptive execution, as
nothing is gathered by that key.

Edge cases: null text stays null; blank lines are kept; a null host is a host of its own; exact copies of a page count
once both in a line's pages and in the host's total, so copies alone never make a line boilerplate; repeated rows are
cleaned alike; an empty table gives an empty table. Extra columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sheltered
from .line_quality import dropped_lines, line_counts, row_key, without_lines


@dataclass(frozen=True)
class SiteRules:
    """A line is boilerplate if it is on more than ``ratio`` of its host's pages and on ``min_pages`` of them."""

    ratio: float = 0.01
    min_pages: int = 5


def boilerplate_lines(docs: DataFrame, rules: SiteRules = SiteRules(), text: str = "text", host: str = "source") -> DataFrame:
    counts = line_counts(docs, text, host)
    return counts.where((F.col("n_docs") >= rules.min_pages) & (F.col("n_docs") > rules.ratio * F.col("host_docs"))).select("__h")


def drop_boilerplate(docs: DataFrame, rules: SiteRules = SiteRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with the text cleaned, and __n_lines and __n_dropped."""
    rk = row_key(text, host, key)
    drop = dropped_lines(docs, boilerplate_lines(docs, rules, text, host), rk, text, host)
    joined = docs.withColumn("__rk", rk).join(drop, F.col("__rk") == F.col("__rk2"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        *[without_lines(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns],
        count(F.size(F.split(F.col(text), "\n"))).alias("__n_lines"),
        count(F.size("__drop")).alias("__n_dropped"),
    )


def clean_documents(docs: DataFrame, rules: SiteRules = SiteRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with the text cleaned and n_chars, where there is such a column, brought in line."""

    def work(docs: DataFrame) -> DataFrame:
        out = drop_boilerplate(docs, rules, text, host, key)
        size = F.when(F.col("__n_dropped") > 0, F.length(text)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
        return out.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])

    return sheltered(work, docs)
