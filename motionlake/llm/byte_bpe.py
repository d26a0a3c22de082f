"""Byte-level BPE by merge replay.

A task takes its documents in blocks of bounded size. The distinct words of a block form one corpus: an inverted index
maps each mergeable token pair to the positions where it stands, merges are applied to all those positions in rank
order, and only the pairs with touched neighbours are indexed anew. Every word is merged once a block, whatever the
number of its copies. The ids of a word don't depend on what else is in the block, so blocks need no exchange: no
shuffle, and a lost task is simply run again.

Edge cases: null text has no ids (an empty binary) and decodes to nothing; repeated rows are encoded alike; an empty
table gives no rows; columns other than key and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release

#: Characters of text that share one replay.
BLOCK_CHARS = 4_000_000


class Merges:
    """Token bytes by rank, and the rank that each mergeable pair of tokens gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.n = max(ranks.values()) + 1
        tokens = [b""] * self.n
        for t, r in ranks.items():
            tokens[r] = t
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = r
        self.codes = np.array(sorted(pairs), dtype=np.int64)
        self.results = np.array([pairs[c] for c in self.codes.tolist()], dtype=np.int32)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two don't merge or one is missing (negative)."""
        code = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.results[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Merge a single word, lowest rank first, leftmost of equals: parts are linked and their pairs stand in a heap,
        so a word of n bytes takes n log n steps."""
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not part[i] or part[i] + part[j] != whole:  # a neighbour has been merged since
                continue
            part[i], part[j], after[i] = whole, b"", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k] + part[after[k]]))
        return [self.ranks[p] for p in part if p]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the offset of each word's first id."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(ends[-1])
        symbol = np.append(self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)], -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[starts], after[n] = n, n, n  # n stands for no neighbour
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        first = np.arange(n, dtype=np.int32)
        ranks = self.rank(symbol[:n], symbol[after[:n]])
        if (there := ranks >= 0).any():
            add(first[there], ranks[there])
        marked = np.zeros(n + 1, dtype=bool)
        restart: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = np.sort(np.concatenate(index.pop(r)))
            at = at[np.append(True, at[1:] != at[:-1])]
            at = at[self.rank(symbol[at], symbol[after[at]]) == r]
            if not len(at):
                continue
            marked[at] = True
            if marked[after[at]].any():  # pairs that overlap: the left one goes first
                for i in at.tolist():
                    if marked[i] and after[i] < n:
                        marked[after[i]] = False
                at = at[marked[at]]
            marked[at] = False
            second = after[at]
            marked[second] = False
            third, left = after[second], before[at]
            symbol[at], symbol[second], after[at], before[third] = r, -1, third, at
            near = np.concatenate([at, left])
            ranks = self.rank(symbol[near], symbol[after[near]])
            if ((ranks >= 0) & (ranks < r)).any():  # a merge of a lower rank came up late: such words are merged singly
                restart.update((np.searchsorted(ends, near[(ranks >= 0) & (ranks < r)], side="right")).tolist())
                ranks = np.where(ranks < r, -1, ranks)
            if (there := ranks >= 0).any():
                add(near[there], ranks[there])
        alive = symbol[:n] >= 0
        ids = symbol[:n][alive]
        offsets = np.append(0, np.cumsum(alive))[np.append(starts, n)]
        if restart:
            parts, counts = [], np.diff(offsets)
            for w, lo, hi in zip(range(len(words)), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                parts.append(np.array(self.one_word(words[w]), dtype=np.int32) if w in restart else ids[lo:hi])
                counts[w] = len(parts[-1])
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum(counts))
        return ids, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for each start and length, end to end."""
    total = int(lengths.sum())
    skip = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[skip + np.arange(total)]


@lru_cache(2)
def merges_of(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Pieces:
    """Numbers the pieces of texts between single spaces, so that the pattern runs once for each distinct piece.

    A space that has no white space beside it always begins a match, so matches don't cross it. A text with other
    runs of white space at a cut is split as a whole.
    """

    def __init__(self, split):
        self.split, self.pieces, self.words, self.number = split, {}, {}, []

    def of_text(self, text: str) -> np.ndarray:
        """Numbers of the text's pieces; the first is without a space before it."""
        head, *rest = text.split(" ")
        put, pieces = self.pieces.setdefault, self.pieces
        return np.array([put((head,), len(pieces)), *[put(p, len(pieces)) for p in rest]], dtype=np.int32)

    def word_numbers(self, matches: list[str]) -> list[int]:
        put, words = self.words.setdefault, self.words
        return [put(w, len(words)) for w in matches]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all pieces end to end, where each piece's begin, and which pieces are unsafe to cut at."""
        flat, starts, unsafe = [], [0], []
        for p in self.pieces:
            inner = p[0] if isinstance(p, tuple) else p
            first = not inner or inner[0].isspace()
            unsafe.append(first or inner[-1].isspace())
            if not unsafe[-1]:
                flat += self.word_numbers(self.split(inner if isinstance(p, tuple) else " " + p))
            starts.append(len(flat))
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(unsafe, dtype=bool)


def encode_block(texts: list[str | None], merges: Merges, split) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    pieces = Pieces(split)
    seen = [pieces.of_text(t) if t else None for t in texts]
    flat, starts, unsafe = pieces.table()
    for i, t in enumerate(texts):  # from here on, the numbers of the text's words
        if t and unsafe[seen[i]].any():
            seen[i] = np.array(pieces.word_numbers(split(t)), dtype=np.int64)
        elif t:
            seen[i] = ragged(flat, starts[seen[i]], starts[seen[i] + 1] - starts[seen[i]])
    ids, offsets = merges.replay([w.encode() for w in pieces.words])
    counts = np.diff(offsets)
    return [b"" if w is None else ragged(ids, offsets[w], counts[w]).astype("<u4").tobytes() for w in seen]


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Keys and texts, so many that their characters reach the limit."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers)."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split, schema = merges_of(ranks_path), regex.compile(pattern).findall, None
        for batch in (rows := iter(batches)):
            schema = pa.schema([(key, batch.schema.field(0).type), ("ids", pa.binary())])
            for keys, texts in blocks((b for part in ([batch], rows) for b in part), BLOCK_CHARS):
                done = encode_block(texts, merges, split)
                for i in range(0, len(keys), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2000], schema[0].type), pa.array(done[i : i + 2000], pa.binary())], schema=schema)
                del keys, texts, done
                release()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """All columns and decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(ranks_path)
        for batch in batches:
            done = [None if v is None else merges.decode(np.frombuffer(v, dtype="<u4")) for v in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=[*batch.schema.names, "decoded"])
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
