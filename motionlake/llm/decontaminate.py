"""Benchmark decontamination: an FM-index per shard of documents, searched for the benchmark's word windows.

A shard is a run of documents inside a task, of bounded size, so nothing is shuffled. The benchmark is a stated query
set: tasks write its windows to files in the shared folder, blocks of bounded size, and each task searches each of its
shards for one block after another. Words that no window of a block has are one symbol in its index, and a run of them
is kept as a single one; windows of which the shard lacks a word aren't looked for.

Words: A-Z in lower case, then runs of digits, letters a-z and characters from U+0080. A window is 13 consecutive words
of an item; an item of fewer words, but not none, is one window.

Edge cases: null text has no words; documents and items without words are never hit; items without an id are left out;
several texts of an id are one item; repeated documents are judged alike; an empty benchmark hits nothing; an empty
table gives no rows; other columns are ignored (``keep_clean`` passes them on).
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, release, sheltered
from .files import file_system, open_file
from .fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 1_500_000
#: Benchmark words of one block of windows.
BLOCK_WORDS = 2_000_000
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

IS_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point spans of runs of hit words, from the first word's start to the last one's end."""
    data = text.encode()
    spans, at, chars = [], 0, 0
    for k, m in enumerate(IS_WORD.finditer(data)):
        if hit[k]:
            chars += len(data[at : m.start()].decode())
            start = chars
            chars += len(m[0].decode())
            at = m.end()
            if k and hit[k - 1]:
                spans[-1]["stop"] = chars
            else:
                spans.append({"start": start, "stop": chars})
    return spans


class Windows:
    """The windows of a block of items: word numbers (from 2) of all items end to end, and each window's place in them,
    length and item."""

    ARRAYS = ("flat", "start", "length", "owner")

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.number: dict[bytes, int] = {}
        flat, start, length, owner, at = [], [], [], [], 0
        for item, text in items:
            words = np.array([self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)], dtype=np.int32)
            if n := len(words):
                k = max(1, n - WINDOW + 1)
                flat.append(words)
                start.append(at + np.arange(k))
                length.append(np.full(k, min(n, WINDOW)))
                owner.append(np.full(k, item))
                at += n
        for name, parts, kind in zip(self.ARRAYS, (flat, start, length, owner), (np.int32, np.int64, np.int8, np.int64), strict=True):
            setattr(self, name, np.concatenate([*parts, np.zeros(0)]).astype(kind))

    def save(self, uri: str) -> None:
        data = io.BytesIO()
        words = np.frombuffer(b"\n".join(self.number), dtype=np.uint8)
        np.savez(data, words=words, **{name: getattr(self, name) for name in self.ARRAYS})
        fs, path = file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            out.write(data.getvalue())

    @classmethod
    def load(cls, uri: str) -> Windows:
        found = cls.__new__(cls)
        with open_file(uri) as f, np.load(io.BytesIO(f.readall())) as data:
            for name in cls.ARRAYS:
                setattr(found, name, data[name])
            words = data["words"].tobytes().split(b"\n") if len(data["words"]) else []
        found.number = {w: i + 2 for i, w in enumerate(words)}
        return found

    def possible(self, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose words are all there (by number): the distinct ones as right-aligned rows and their
        lengths; and pairs of such a row and an item that has it, as rows of two, by row."""
        seen = np.append(0, np.cumsum(there[self.flat]))
        here = np.flatnonzero(seen[self.start + self.length] - seen[self.start] == self.length)
        back = np.arange(-WINDOW, 0)
        place = (self.start + self.length)[here][:, None] + back
        rows = np.where(back >= -self.length[here][:, None], self.flat[np.maximum(place, 0)], 0).astype(np.int64)
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([which.reshape(-1), self.owner[here]]), axis=0)
        return rows, (rows > 0).sum(axis=1), pairs


def window_blocks(benchmark: DataFrame, text: str = "text", item: str = "item_id") -> list[str]:
    """Files of the benchmark's windows, a task making each; only their names come back."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + size // (6 * BLOCK_WORDS)
    folder = new_folder(benchmark.sparkSession, "windows")

    def run(group: pa.Table) -> pa.Table:
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        Windows(zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True)).save(uri)
        release()
        return pa.table({"uri": [uri]})

    found = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count))).groupBy("block").applyInArrow(run, "uri string")
    return sorted(r.uri for r in found.collect())


def search_shard(docs: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, list[set[int]]]:
    """Whether each word of the shard is hit, and the items whose windows each document has."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    found: list[set[int]] = [set() for _ in docs]
    get = windows.number.get
    number = np.fromiter((get(w, 1) for d in docs for w in d), dtype=np.int64, count=total)
    there = np.zeros(len(windows.number) + 2, dtype=bool)
    there[number] = True
    there[:2] = False
    phrases, lengths, owned = windows.possible(there)
    if not len(phrases):
        return np.zeros(total, dtype=bool), found
    # A break (symbol 1) stands for each run of other words and between documents.
    text = np.ones(total + len(docs), dtype=np.int64)
    place = np.arange(total) + np.repeat(np.arange(len(docs)), sizes)
    text[place] = number
    word = np.zeros(len(text), dtype=np.int64)
    word[place] = np.arange(total)
    kept = (text != 1) | np.append(True, text[:-1] != 1)
    text, word = text[kept], word[kept]
    index = FMIndex(text, len(windows.number) + 1)
    low, high = index.search(phrases, lengths)
    here = np.flatnonzero(high > low)
    if not len(here):
        return np.zeros(total, dtype=bool), found
    times = (high - low)[here]
    which = np.repeat(here, times)
    rows = np.repeat(low[here] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    start = word[index.locate(rows)]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + lengths[which], -1)
    first = np.searchsorted(owned[:, 0], np.arange(len(phrases) + 1))
    pairs = np.unique(np.searchsorted(ends, start, side="right") * len(phrases) + which)
    for doc, w in zip((pairs // len(phrases)).tolist(), (pairs % len(phrases)).tolist(), strict=True):
        found[doc].update(owned[first[w] : first[w + 1], 1].tolist())
    return np.cumsum(edge)[:-1] > 0, found


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", bench_text: str = "text", item: str = "item_id") -> DataFrame:
    """key, n_words, n_hit, items (sorted ids) and spans (merged, code points) of each document."""
    uris = window_blocks(benchmark, bench_text, item)
    fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Windows] = {}

        def judge(keys: list, texts: list, words: list, schema: pa.Schema) -> pa.RecordBatch:
            sizes = [len(w) for w in words]
            hit, items = np.zeros(sum(sizes), dtype=bool), [set() for _ in words]
            for uri in uris:
                if uri not in loaded:
                    loaded.clear()
                    loaded[uri] = Windows.load(uri)
                here, found = search_shard(words, loaded[uri])
                hit |= here
                for s, f in zip(items, found, strict=True):
                    s |= f
            rows, at = [], 0
            for k, t, n, s in zip(keys, texts, sizes, items, strict=True):
                mine = hit[at : at + n]
                rows.append((k, n, int(mine.sum()), sorted(s), spans_of(t, mine) if s else []))
                at += n
            release()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        keys, texts, words, size, schema = [], [], [], 0, None
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(0).type), *fields])
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(k)
                texts.append(t)
                words.append(words_of(t))
                size += len(words[-1])
                if size >= SHARD_WORDS:
                    yield judge(keys, texts, words, schema)
                    keys, texts, words, size = [], [], [], 0
        if keys:
            yield judge(keys, texts, words, schema)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, items array<long>, spans array<struct<start:long,stop:long>>")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Rows of a contaminated key and text go."""

    def work(docs: DataFrame) -> DataFrame:
        row = F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.hash(F.col(key), F.col(text)).alias("b"))
        rows = docs.select(row.alias("__row"), F.col(text).alias("__text"))
        bad = find_contamination(rows, benchmark, "__text", "__row").where(contaminated()).select(F.col("__row").alias("__bad")).distinct()
        return docs.withColumn("__row", row).join(bad, F.col("__row") == F.col("__bad"), "left_anti").drop("__row")

    return sheltered(work, docs)


def without_spans(text: str, spans: list) -> str:
    """The text less its removal spans; for callers that cut passages rather than drop documents."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["stop"]
    return "".join(out) + text[at:]
