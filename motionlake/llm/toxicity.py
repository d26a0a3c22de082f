"""Toxicity: a learned lexicon in a trie, Levenshtein automata that catch its misspelled terms, and context windows.

1. *Lexicon.* Over all labelled training rows, terms (words, and stems: what words begin with) are counted once for each
   text that has them, and the terms that toxic texts have much oftener than others are kept, ``MAX_TERMS`` at most (the
   size of the model). Every distinct text counts; those with the same least pair of words, as near copies have, share
   one count, so that groups of copies don't put their own words in the lexicon.
2. *Matches.* The lexicon is a trie, and holds the words that stems stand for as well, so their misspellings match too.
   A word that has no exact match is run through a Levenshtein automaton, state by state beside the trie, so only
   branches that can still end within the allowed edits are entered.
3. *Context windows.* A match with quotation marks on both sides nearby is a quotation, and a match with others around
   it is abuse: the features keep quoted and unquoted weight apart, as a total, a share and the densest window.
4. *Score.* A logistic regression on these features, fitted on the training rows, or on ``MAX_FIT`` of them.

Only the text is an input of a score. Everything but the fitted model (a few thousand terms and ten numbers) stays
distributed.

Edge cases: null and empty texts have no words and get the score of a text without matches; a null key is not held out
and has no label; several labels of a key count as toxic if one is; null labels are no labels; without any label of
either kind, all scores are the share of toxic labels (0 where there are none); repeated rows are scored alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, written

#: Most terms of a lexicon, and about how many training rows the regression takes at most.
MAX_TERMS = 2000
MAX_FIT = 50_000
#: Labels that a broadcast join may carry; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Least and most letters of a stem, and how many times oftener toxic documents must have a term.
STEM = (4, 7)
RATIO = 5
#: Tokens around a match in which quotation marks make it a quotation, and tokens of a window of abuse.
QUOTE_REACH = 12
WINDOW = 60
#: Multiplier of the order whose least pair of words near copies share, and words of texts that must be equal instead.
ORDER = np.uint64(0x9E3779B1)
SHORT_TEXT = 20
FEATURES = 7
TOXIC_AT = 0.7
MEMO_WORDS = 800_000

QUOTES = frozenset('"“”«»„')
TOKEN = re.compile(r'[^\W\d_]+|["“”«»„]')


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def edits_for(length: int) -> int:
    """Edits that a term of a length may be misspelled by."""
    return 0 if length < 5 else 1 if length < 8 else 2


class Lexicon:
    """Words and stems with weights; words and those that stems cover as a trie: node -> letter -> node."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], covered: dict[str, float] | None = None):
        self.words, self.stems = words, stems
        self.terms = {**(covered or {}), **words}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that a term at or below a node may have
        for w in self.terms:
            node = 0
            for c in w:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                self.most[node] = max(self.most[node], edits_for(len(w)))
            self.ends[node] = w
        # A misspelled term keeps one of edits + 1 pieces of it whole: the first, the last, or (two edits) the middle one.
        self.pieces: dict[int, tuple[int, int, set, set, set]] = {}
        for w in self.terms:
            if edits := edits_for(len(w)):
                n = len(w) // (edits + 1)
                piece = self.pieces.setdefault(len(w), (n, len(w) - n * edits, set(), set(), set()))
                piece[2].add(w[:n])
                piece[3].add(w[n * edits :])
                if edits == 2:
                    piece[4].add(w[n : 2 * n])
        self.stem_sizes = sorted({len(s) for s in stems}, reverse=True)
        self.sign = hashlib.blake2b(repr([sorted(d.items()) for d in (words, stems, self.terms)]).encode(), digest_size=16).digest()

    def may_match(self, word: str) -> bool:
        size = len(word)
        for length in range(size - 2, size + 3):
            if (p := self.pieces.get(length)) and abs(length - size) <= edits_for(length):
                n, last, heads, tails, middles = p
                if word[:n] in heads or word[size - last :] in tails:
                    return True
                if middles and any(word[i : i + n] in middles for i in range(n - 2, n + 3)):
                    return True
        return False

    def misspelled(self, word: str) -> str | None:
        """The term that is nearest (then first in order) among those within their edits of the word.

        The automaton's state is the row of edit distances between the word's prefixes and the path in the trie; a
        branch is left once no entry of its state is within the most edits that its terms may have.
        """
        best: tuple[int, str] | None = None
        stack = [(0, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            term = self.ends[node]
            if term is not None and row[-1] <= edits_for(len(term)) and (best is None or (row[-1], term) < best):
                best = (row[-1], term)
            for letter, child in self.children[node].items():
                new = [row[0] + 1]
                for j, c in enumerate(word):
                    new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != letter)))
                if min(new) <= self.most[child]:
                    stack.append((child, new))
        return best[1] if best else None

    def match(self, word: str) -> tuple[float, bool]:
        """Weight of a word's match (0: none) and whether it is a misspelling."""
        if weight := self.words.get(word, 0.0):
            return weight, False
        for n in self.stem_sizes:
            if len(word) > n and (weight := self.stems.get(word[:n], 0.0)):
                return weight, False
        if self.may_match(word) and (term := self.misspelled(word)):
            return self.terms[term], True
        return 0.0, False


@dataclass
class Model:
    lexicon: Lexicon
    share: float = 0.0
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.share)
        z = ((features - self.mean) / self.scale) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Features of texts; remembers what words match."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.hits, self.misses = lexicon, {}, set()

    def features(self, text: str | None) -> list[float]:
        """log of unquoted, quoted and misspelled weight; weight a token; the densest window; whether there is a
        match; the largest weight of an unquoted match without errors."""
        tokens = tokens_of(text)
        if new := set(tokens) - self.misses - self.hits.keys():
            if len(self.misses) > MEMO_WORDS:
                self.misses.clear()
            for w in new:
                if (found := self.lexicon.match(w))[0]:
                    self.hits[w] = found
                else:
                    self.misses.add(w)
        hits = self.hits
        at = [i for i, w in enumerate(tokens) if w in hits]
        if not at:
            return [0.0] * FEATURES
        quotes = [i for i, w in enumerate(tokens) if w in QUOTES]
        q = np.searchsorted(quotes, at)
        edge = np.array([-(10**9), *quotes, 10**9])
        place = np.array(at)
        quoted = (place - edge[q] <= QUOTE_REACH) & (edge[q + 1] - place <= QUOTE_REACH) & (q % 2 == 1)
        weight = np.array([hits[tokens[i]][0] for i in at])
        wrong = np.array([hits[tokens[i]][1] for i in at])
        open_weight = np.where(quoted, 0.0, weight)
        sums = np.append(0.0, np.cumsum(open_weight))
        densest = float((sums[np.searchsorted(place, place + WINDOW)] - sums[:-1]).max())
        return [
            math.log1p(open_weight.sum()),
            math.log1p(weight[quoted].sum()),
            math.log1p(open_weight[wrong].sum()),
            float(open_weight.sum()) / (len(tokens) + 20),
            math.log1p(densest),
            float((open_weight > 0).any()),
            float(np.where(wrong, 0.0, open_weight).max()),
        ]


_READERS: dict[bytes, Reader] = {}


def reader_of(lexicon: Lexicon) -> Reader:
    """The worker's reader of a lexicon: what it remembers of words serves all of the worker's tasks."""
    if lexicon.sign not in _READERS:
        _READERS.clear()
        _READERS[lexicon.sign] = Reader(lexicon)
    return _READERS[lexicon.sign]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """__key, text and toxic of the labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(known, "__key")


def signatures(words: list[str]) -> tuple[int, int]:
    """Hashes of a text's words: one is equal for equal words only, the other for most near copies too (and for some other
    texts): the least hash of the pairs of neighbouring words. Short texts have the first one twice."""
    sign = lambda said: int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)
    exact = sign(" ".join(words).encode())
    if len(words) < SHORT_TEXT:
        return exact, exact
    h = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in set(zip(words, words[1:], strict=False))], dtype=np.uint64)
    x = (h * ORDER) & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(15))) * ORDER) & np.uint64(0xFFFFFFFF)
    return exact, sign(x.min().tobytes())


def read_words(train: DataFrame) -> DataFrame:
    """exact and near (signatures), toxic and the distinct words of each training row."""
    schema = pa.schema([("exact", pa.int64()), ("near", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens_of(text)
                rows.append((*signatures(words), toxic, sorted(set(words) - QUOTES)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        release()

    return train.select("__text", "__toxic").mapInArrow(run, "exact long, near long, toxic int, words array<string>")


def word_counts(rows: DataFrame) -> DataFrame:
    """word, t and c: how many toxic and other texts have each word, of rows as ``read_words`` makes them.

    Of texts with the same words one counts; texts of one near signature count as one together, each for its share.
    """
    texts = rows.dropDuplicates(["exact", "toxic"])
    sizes = rows.select("exact", "near", "toxic").distinct().groupBy("near", "toxic").agg((1.0 / F.count("*")).alias("share"))
    each = texts.join(sizes, ["near", "toxic"]).select("toxic", "share", F.explode("words").alias("word"))
    part = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("share")).otherwise(0.0))
    return each.groupBy("word").agg(part(1).alias("t"), part(0).alias("c"))


def choose_terms(rows: list[tuple[str, bool, float, float]], least: float) -> list[tuple[str, bool, float]]:
    """(term, is a stem, gain, weight) to the terms that stay: a stem stands for the words it begins, or they for it."""
    below: dict[str, float] = defaultdict(float)
    largest: dict[str, float] = defaultdict(float)
    words = {t: g for t, stem, g, _ in rows if not stem and g >= least}
    for t, g in words.items():
        for n in range(STEM[0], STEM[1] + 1):
            if len(t) > n:
                below[t[:n]] += g
                largest[t[:n]] = max(largest[t[:n]], g)
    kept: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    heads: set[str] = set()  # what stems begin with
    begins = lambda t: any(t[:n] in stems for n in range(STEM[0], STEM[1] + 1))
    for t, stem, g, w in sorted(rows, key=lambda r: (-r[2], not r[1], r[0])):
        if len(kept) < MAX_TERMS and g >= least:
            if stem and g > 0.8 * below[t] and g > 1.5 * largest[t] and not begins(t) and t not in heads:
                stems.add(t)
                heads.update(t[:n] for n in range(STEM[0], len(t) + 1))
                kept.append((t, True, w))
    for t, stem, g, w in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(kept) < MAX_TERMS and g >= least and not stem and not any(t[:n] in stems for n in range(STEM[0], min(STEM[1], len(t) - 1) + 1)):
            kept.append((t, False, w))
    return kept


def covered_words(rows: list[tuple[str, bool, float, float]], stems: dict[str, float]) -> dict[str, float]:
    """Weights of the words that stems stand for."""
    return {t: w for t, stem, _, w in rows if not stem and any(t[:n] in stems for n in range(STEM[0], min(STEM[1], len(t) - 1) + 1))}


def learn_lexicon(train: DataFrame) -> Lexicon:
    words = written(word_counts(written(read_words(train), "toxic-texts")), "toxic-words")
    terms = words.select("t", "c", F.explode(F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))), F.transform(
        F.filter(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: n < F.length("word")), lambda n: F.struct(F.substring(F.col("word"), F.lit(1), n).alias("term"), F.lit(True).alias("stem"))
    ))).alias("x")).groupBy("x.term", "x.stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = words.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    all_t, all_c, distinct = total[0] or 0, total[1] or 0, total[2]
    if not all_t or not all_c:
        return Lexicon({}, {})
    t, c, share = F.col("t"), F.col("c"), all_t / (all_t + all_c)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0.0)
    scored = terms.where((t > 2.5) & (t * all_c > RATIO * c * all_t) & (F.length("term") >= STEM[0])).select(
        "term", "stem", (2 * (part(t, share) + part(c, 1 - share))).alias("gain"), F.log(((t + 0.5) / all_t) / ((c + 0.5) / all_c)).alias("weight")
    )
    best = [tuple(r) for r in scored.orderBy(F.desc("gain"), "term", "stem").limit(8 * MAX_TERMS).collect()]
    chosen_terms = choose_terms(best, 2 * math.log(max(2, distinct)))
    stems = {t: w for t, stem, w in chosen_terms if stem}
    return Lexicon({t: w for t, stem, w in chosen_terms if not stem}, stems, covered_words(best, stems))


def logistic(x: np.ndarray, y: np.ndarray, model: Model) -> Model:
    """Ridge-penalised logistic regression by Newton's steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.mean, model.scale, model.weights, model.bias = mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1])
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    train = training_rows(docs, labels, text, key, label)
    lexicon = learn_lexicon(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    share = max(1, train.count())  # a row's hash decides, so no task gathers the sample's texts
    sample = train.where(F.pmod(F.xxhash64("__key"), F.lit(share)) < MAX_FIT)
    rows = sample.select("__text", "__toxic").mapInArrow(run, "x array<double>, y int").collect()
    y = np.array([r.y > 0 for r in rows], dtype=float)
    model = Model(lexicon, float(y.mean()) if len(y) else 0.0)
    return logistic(np.array([r.x for r in rows]), y, model) if 0 < y.sum() < len(y) else model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model.lexicon)
        for batch in batches:
            x = np.array([reader.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=[key, "score"])
        release()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
