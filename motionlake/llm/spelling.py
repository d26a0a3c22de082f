"""Spelling variants by anagram hashing: words one letter apart, and the more frequent word that each of them stands for.

A word's key is the sum of its letters' values, their code points to the fifth power, modulo a prime; anagrams share it. One added
or removed letter moves the key by that letter's value and an exchange by the difference of two, so that words one letter apart
meet where a key less one of its letters equals another key, or another key less one of its letters. That is one equality join of
records (key, half): each word is listed under its own key and under its key less each of its letters. One edit leaves the first or
the second half of a word as it is, so records also carry the half that the removed letter isn't in; this parts large groups of
anagrams, and a word has two records at most for each letter of the alphabet, however long it is. Letter order is verified in the
join by a banded edit distance, before a row leaves it. With one letter's place open, an alphabet's number of words can meet at
most, so words bring a bounded number of pairs each.

Words are counted within tasks before they are shuffled. A word follows its form, the near word of largest count, where that count
is at least ``ratio`` times its own; counts grow along the way, so there are no circles, and the words that follow one form directly
are bounded by the alphabet. Roots go down from the forms that follow none, one level a step, each word once.

Edge cases: null texts have no words; a null key counts as an empty one where runs are damaged; repeated rows and copies count like
any others; an empty table gives no rows; ties of forms go to the smallest word in code-point order. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What parts runs of letters.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are kept below this prime, so that words of any length have one.
PRIME = 2**61 - 1


@dataclass(frozen=True)
class Spelling:
    min_letters: int = 5
    min_count: int = 3
    ratio: int = 2
    #: One of so many runs loses a letter.
    damage: int = 97


def lowered(run: Column) -> Column:
    """A-Z in lower case; most runs have none and are left alone."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER))


def damaged(run: Column, key: Column, every: int) -> Column:
    """The run less one letter where the CRC of key and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, rules: Spelling = Spelling(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """word and n for words that are long and frequent enough."""
    runs = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.split(F.col(f"`{text}`"), BETWEEN)).alias("run")).where(F.length("run") >= rules.min_letters)
    words = runs.select("key", lowered(F.col("run")).alias("run")).select(damaged(F.col("run"), F.col("key"), rules.damage).alias("word"))
    counts = words.where(F.length("word") >= rules.min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= rules.min_count)


def value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def letters(part: Column) -> Column:
    return F.split(part, "")


def anagram_key(word: Column) -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda total, c: (total + value(c)) % PRIME)


def keyed_records(words: DataFrame) -> DataFrame:
    """key, half, word, n, less (a letter was taken away), first (the half is the first one) and cut (letters before the halves' border)."""
    word, size = F.col("word"), F.length("word")
    base = words.select("word", "n", size.alias("size"), anagram_key(word).alias("own"))

    def under(less: bool, first: bool) -> Column:
        m = F.col("size") - int(less)
        cut = F.shiftright(m, 1)
        half = F.substring(word, F.lit(1), cut) if first else F.substring(word, cut + 1 + int(less), m)
        named = F.xxhash64(m, F.lit(first), half)
        entry = lambda key: F.struct(key.alias("key"), named.alias("half"), F.lit(less).alias("less"), F.lit(first).alias("first"), cut.alias("cut"))
        if not less:
            return F.array(entry(F.col("own")))
        rest = F.substring(word, cut + 1, F.col("size")) if first else F.substring(word, F.lit(1), cut)
        gone = F.filter(F.array_distinct(letters(rest)), lambda c: c != "")
        return F.transform(gone, lambda c: entry(F.pmod(F.col("own") - value(c), F.lit(PRIME))))

    all_of = F.concat(*[under(less, first) for less in (False, True) for first in (True, False)])
    return base.select("word", "n", F.explode(all_of).alias("r")).select("word", "n", "r.*")


def unsent(rows: DataFrame) -> DataFrame:
    """rows, not to be broadcast: a word has a score of records, of which the small file that they come from tells nothing, so they'd
    fill the driver long before that file reaches the limit of broadcasts."""
    return rows.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n: words one letter apart, each pair both ways and once."""
    left = keyed_records(words)
    right = left.select(*[F.col(c).alias(f"{c}2") for c in left.columns])
    prefix = lambda c: F.substring(F.col(c), F.lit(1), F.col("cut"))
    meet = (F.col("key") == F.col("key2")) & (F.col("half") == F.col("half2"))
    # Pairs that also meet by their first halves aren't taken by their second ones again.
    once = F.col("first") | (prefix("word") != prefix("word2"))
    apart = (F.col("less") | F.col("less2")) & (F.col("word") != F.col("word2")) & once & (F.levenshtein("word", "word2", 1) == 1)
    return left.join(unsent(right), meet & apart).select("word", F.col("word2").alias("near"), F.col("n2").alias("near_n"))


def forms_of(words: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """word, n, n_near, form and form_n."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    follows = -F.col("best.less") >= rules.ratio * F.col("n")
    return words.join(unsent(near), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("best.near")).alias("form"),
        F.when(follows, -F.col("best.less")).alias("form_n"),
    )


def roots_of(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form."""
    links = forms.where(F.col("form").isNotNull()).select("word", "form")
    heads = links.select(F.col("form").alias("word")).distinct().join(unsent(links.select("word")), "word", "left_anti")
    level = heads.select("word", F.col("word").alias("root"))
    done = []
    while True:
        above = level.select(F.col("word").alias("form"), "root")
        level = written(unsent(links).join(above, "form").select("word", "root"), "roots")
        if done and level.isEmpty():
            break
        done.append(level)
    return reduce(DataFrame.unionAll, done)


def variants(docs: DataFrame, rules: Spelling = Spelling(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough."""
    words = written(word_counts(docs, rules, text, key), "words")
    forms = written(forms_of(words, rules), "forms")
    found = forms.join(unsent(roots_of(forms)), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
