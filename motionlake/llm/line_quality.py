"""Quality rules from the text itself and from how often its lines occur in other documents.

Everything here is DataFrame expressions. Lines are reduced to 64-bit hashes of (host, normalised line) before
any shuffle, counted with map-side combine, and a document's share of frequent lines is summed per row key, so a
line or host that holds a third of all rows never meets in one task.

Edge cases: null text counts as empty (no words, rejected); a null host is a host of its own; repeated rows each get
the same verdict; exact copies of a text count as one document in a line's frequency; an empty table gives no rows.
Extra columns are ignored by ``quality_verdicts`` and passed on untouched by ``keep_good``, which takes frequent lines out
of the texts that stay (blank lines are kept) and brings n_chars, where there is such a column, in line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, written

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """A line is frequent above both limits; a document whose frequent lines hold ``depleted`` of its words goes."""

    min_words: int = 50
    max_repeat: float = 0.5
    max_docs: int = 10
    max_host_share: float = 0.002
    depleted: float = 0.7


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def base_signals(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; one row per input row."""
    t = F.col("__t")
    has_word = lambda s: F.length(F.translate(s, SPACE_CHARS, "")) > 0
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).select(
        *keep,
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), has_word).alias("__lines"),
        words_of(t).alias("__w"),
    )
    w = F.col("__w")
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    ordered = split.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("__s"),
    )
    s = F.col("__s")
    twice = F.filter(
        s,
        lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return ordered.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words")
    )


def line_rows(docs: DataFrame, text: str, host: str, keep: dict[str, Column]) -> DataFrame:
    """A row per line that has a word: keep, __i (its index), __h (hash of host and normalised line), __line."""
    rows = docs.select(
        *[c.alias(n) for n, c in keep.items()],
        F.col(host).alias("__host"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__i", "__line"),
    ).where(F.length(F.translate("__line", SPACE_CHARS, "")) > 0)
    return rows.withColumn("__h", F.xxhash64("__host", normal_line(F.col("__line"))))


def line_counts(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """__h, n_docs (distinct texts of the host that hold the line) and host_docs (distinct texts of the host)."""
    texts = F.xxhash64(F.col(text))
    lines = line_rows(docs, text, host, {"__t": texts}).select("__host", "__h", "__t").distinct()
    per_line = lines.groupBy("__host", "__h").agg(F.count("*").alias("n_docs"))
    per_host = docs.select(F.col(host).alias("__host2"), texts.alias("__t")).distinct().groupBy("__host2").agg(F.count("*").alias("host_docs"))
    return per_line.join(per_host, F.col("__host").eqNullSafe(F.col("__host2"))).select("__h", "n_docs", "host_docs")


def row_key(text: str, host: str, key: str) -> Column:
    """Equal for equal rows only (96 bits)."""
    c = [F.col(key), F.col(host), F.col(text)]
    return F.struct(F.xxhash64(*c).alias("a"), F.hash(*c).alias("b"))


def frequent_lines(docs: DataFrame, rules: LineRules, text: str, host: str) -> DataFrame:
    counts = line_counts(docs, text, host)
    return counts.where((F.col("n_docs") > rules.max_docs) & (F.col("n_docs") > rules.max_host_share * F.col("host_docs"))).select("__h")


def dropped_lines(docs: DataFrame, lines: DataFrame, rk: Column, text: str, host: str) -> DataFrame:
    """__rk2 and __drop: for each row that has any of the lines (__h), their places in its text."""
    found = line_rows(docs, text, host, {"__rk2": rk}).select("__rk2", "__i", "__h").join(lines, "__h")
    return found.groupBy("__rk2").agg(F.collect_set("__i").alias("__drop"))


def without_lines(text: Column) -> Column:
    """The text less the lines at __drop (null: as it is). Places are set against each other by hash, so long texts with
    many such lines take no longer a line than others."""
    lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop")), lambda i: F.get(lines, i))
    return F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(kept, "\n"))


def quality_verdicts(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", host: str = "source", key: str = "doc_id", frequent: DataFrame | None = None) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept and __rk.

    frequent: the hashes (__h) of the lines above the limits, where they are known already."""
    frequent = frequent_lines(docs, rules, text, host) if frequent is None else frequent
    rk = row_key(text, host, key)
    removed = (
        line_rows(docs, text, host, {"__rk": rk})
        .select("__rk", "__i", "__h", F.size(words_of(F.col("__line"))).alias("__n"))
        .join(frequent, "__h")
        .groupBy("__rk", "__i")
        .agg(F.max("__n").alias("__n"))
        .groupBy("__rk")
        .agg(F.sum("__n").alias("removed_words"))
    )
    base = base_signals(docs.withColumn("__rk", rk), text, keep=(key, "__rk"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    return base.join(removed, "__rk", "left").select(
        key,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        gone.alias("removed_words"),
        (~failed & (gone < rules.depleted * F.col("n_words"))).alias("kept"),
        "__rk",
    )


def keep_good(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents that no rule rejects, without their frequent lines, with all their columns."""

    def work(docs: DataFrame) -> DataFrame:
        rk = row_key(text, host, key)
        frequent = written(frequent_lines(docs, rules, text, host), "frequent")
        bad = quality_verdicts(docs, rules, text, host, key, frequent).where(~F.col("kept")).select(F.col("__rk").alias("__bad")).distinct()
        drop = dropped_lines(docs, frequent, rk, text, host)
        good = docs.withColumn("__rk", rk).join(bad, F.col("__rk") == F.col("__bad"), "left_anti")
        good = good.join(drop, F.col("__rk") == F.col("__rk2"), "left").withColumn("__clean", without_lines(F.col(text)))
        new = {text: F.col("__clean")}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.length("__clean")).cast(docs.schema["n_chars"].dataType)
        return good.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])

    return sheltered(work, docs)
