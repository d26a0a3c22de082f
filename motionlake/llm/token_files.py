"""Token ids in length-delimited binary record files, with an offset index beside them for shuffled reads.

A record frames one document's sequence: length (8 bytes, little-endian), masked CRC-32C of the length, payload, masked
CRC-32C of the payload. A payload is the document's key (8 bytes), a flag (1 if the key is null), the width of an id
(2 or 4 bytes) and the ids, little-endian. Documents are range-partitioned by key and sorted inside the partitions, so
the files in order of their number hold the ids in ascending key order; each file's totals, a row a file, give the
place of its first id.

Edge cases: null text encodes to the end id alone; a null key sorts first; repeated rows give a record each, in a row;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written
from .files import new_file, open_file

#: Documents that one call encodes share the work on equal pieces; their bytes.
BLOCK_BYTES = 24_000_000
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20

# Fixed values of the record format: the polynomial of CRC-32C (reflected), the mask's rotation and constant.
CRC_POLYNOMIAL = 0x82F63B78
MASK_SHIFT = 15
MASK_DELTA = 0xA282EAD8
CHUNK = 256

INDEX = "part int, doc_id long, file string, offset long, size long, n_tokens long"


def step_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte's step, and of what CHUNK zero bytes do to each byte of a state."""
    step = step_table()
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(CHUNK):
        state = step[state & 0xFF] ^ (state >> 8)
    return step, state


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part. Parts are cut into chunks that are worked on side by side, then joined by linear steps."""
    step, skip = tables()
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    out = np.zeros(len(parts), dtype=np.uint32)
    for i in np.flatnonzero(sizes < 4):
        c = np.uint32(0xFFFFFFFF)
        for b in parts[i]:
            c = step[(c ^ b) & 0xFF] ^ (c >> np.uint32(8))
        out[i] = c
    long = np.flatnonzero(sizes >= 4)
    if len(long):
        chunks = -(-sizes[long] // CHUNK)
        ends = np.cumsum(chunks * CHUNK)
        padded = np.zeros(ends[-1], dtype=np.uint8)  # zeros before a part leave a zero state as it is
        for i, end in zip(long.tolist(), ends.tolist(), strict=True):
            at = end - sizes[i]
            padded[at:end] = np.frombuffer(parts[i], dtype=np.uint8)
            padded[at : at + 4] ^= 0xFF  # the initial state
        grid = padded.reshape(-1, CHUNK).T.copy()
        state = np.zeros(grid.shape[1], dtype=np.uint32)
        for row in grid:
            state = step[(state ^ row) & 0xFF] ^ (state >> 8)
        first = ends // CHUNK - chunks
        total = state[first].copy()
        for k in range(1, int(chunks.max())):
            more = np.flatnonzero(chunks > k)
            t = total[more]
            t = skip[0][t & 0xFF] ^ skip[1][(t >> 8) & 0xFF] ^ skip[2][(t >> 16) & 0xFF] ^ skip[3][t >> 24]
            total[more] = t ^ state[first[more] + k]
        out[long] = total
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return ((((c >> MASK_SHIFT) | (c << (32 - MASK_SHIFT))) + MASK_DELTA) & 0xFFFFFFFF).astype("<u4")


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [n + x.tobytes() + p + y.tobytes() for n, x, p, y in zip(lengths, a, payloads, b, strict=True)]


def unframe(data: bytes, checked: bool = True) -> list[bytes]:
    """Payloads of records that follow each other; raises where a length or checksum is wrong."""
    payloads, heads, tails, at = [], [], [], 0
    while at < len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        heads.append(data[at + 8 : at + 12])
        payloads.append(data[at + 12 : at + 12 + size])
        tails.append(data[at + 12 + size : at + 16 + size])
        at += 16 + size
    if checked and payloads:
        lengths = [struct.pack("<Q", len(p)) for p in payloads]
        if masked(crc32c(lengths)).tobytes() != b"".join(heads) or masked(crc32c(payloads)).tobytes() != b"".join(tails):
            raise ValueError("a record's checksum is wrong")
    return payloads


def payload(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<qBB", key or 0, key is None, width) + ids.astype(f"<u{width}").tobytes()


def parse_payload(data: bytes) -> tuple[int | None, np.ndarray]:
    key, null, width = struct.unpack_from("<qBB", data)
    return None if null else key, np.frombuffer(data, dtype=f"<u{width}", offset=10).astype("<u4")


# How a tokenizer normalises and splits if its matches never hold white space. NORMALIZERS and PATTERN as
# its file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Beyond these characters, the library's lower case and composition may depend on what stands beside a character.
NOT_LATIN = r"[^\x00-\x{ff}]"
#: A mark that ends a word after a letter; PATTERN parts the two too.
END_MARK = r"([a-zß-öø-ÿ])([.,;:!?])(\s|$)"
#: Pieces of one call of the library, and pieces that a worker remembers.
PIECES_AT_ONCE = 2000
MEMO = 700_000
#: Separators that white space at large counts but the library's pattern doesn't.
SEPARATORS = r"[\x1c-\x1f]"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def splits_at_space(path: str) -> bool:
    """Whether a tokenizer normalises and splits as stated above, so texts may be cut at white space beforehand."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normal, split = told["normalizer"] or {}, (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    first = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    return normal.get("normalizers") == NORMALIZERS and split[0] == first


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of all texts end to end, and how many each has.

    Equal pieces between white space are encoded once a block. The library folds case, so Latin texts are folded first,
    and their end marks are pieces of their own: fewer pieces differ. A text with a special token or with separators that
    the library's pattern doesn't know goes in whole, and so do all texts of a tokenizer of another shape.
    """
    encoder = tokenizer(path)
    texts = pc.fill_null(texts, "")
    if not splits_at_space(path):
        return lists_end_to_end([e.ids for e in encoder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
    whole, folded = pc.match_substring_regex(texts, SEPARATORS), pc.utf8_lower(texts)
    for t in encoder.get_added_tokens_decoder().values():  # in any case of letters, as folding must not make one
        whole = pc.or_(whole, pc.match_substring(folded, t.content.lower()))
    rest = pc.if_else(pc.match_substring_regex(texts, NOT_LATIN), texts, folded)
    rest = pc.if_else(whole, "", rest)
    pieces = pc.utf8_split_whitespace(pc.replace_substring_regex(rest, END_MARK, r"\1 \2\3"))
    coded = pieces.flatten().dictionary_encode()
    known, begin, length = met(path).places(coded.dictionary.to_pylist(), path)
    which = coded.indices.to_numpy()
    sizes, starts = length[which], begin[which]
    before = np.append(0, np.cumsum(sizes))
    ids = known[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])]
    edges = before[np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy()))]
    counts, at = np.diff(edges), np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if len(at):
        more, counts[at] = lists_end_to_end([e.ids for e in encoder.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)])
        ids = np.insert(ids, np.repeat(edges[at], counts[at]), more)
    return ids, counts


class Met:
    """Ids of the pieces that a worker has met lately, MEMO of them about: most of a block's were in those before it."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def places(self, pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each piece begin and how many they are."""
        if len(self.number) > MEMO:
            self.__init__()
        number = self.number
        if new := [p for p in pieces if p not in number]:
            ids, lengths = encode_pieces(new, path)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        at = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return self.ids, (np.cumsum(self.lengths) - self.lengths)[at], self.lengths[at]


@lru_cache(1)
def met(path: str) -> Met:
    return Met()


def encode_pieces(pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces without special tokens. Many go in at once with a special token between them, which the library
    takes out before all else: a call and a result for each piece would take longer than the encoding."""
    encoder = tokenizer(path)
    plain = [(t.content, i) for i, t in encoder.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
    if not plain:
        return lists_end_to_end([e.ids for e in encoder.encode_batch_fast(pieces, add_special_tokens=False)])
    mark, number = plain[0]
    found = [np.zeros(0, dtype=np.uint32)]
    for lo in range(0, len(pieces), PIECES_AT_ONCE):
        (done,) = encoder.encode_batch_fast([mark.join(pieces[lo : lo + PIECES_AT_ONCE]) + mark], add_special_tokens=False)
        found.append(np.array(done.ids, dtype=np.uint32))
    ids = np.concatenate(found)
    marks = ids == number
    return ids[~marks], np.diff(np.append(-1, np.flatnonzero(marks))) - 1


def lists_end_to_end(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(counts.sum())), counts


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and write documents in ascending key order; the offset index (INDEX), itself written beside the files."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, uri, at = TaskContext.get().partitionId(), None, None, 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal out, uri, at
            keys = [k for p in parts for k in p.column(0).to_pylist()]
            flat, counts = encode_texts(pa.concat_arrays([p.column(1) for p in parts]), path)
            ids = [np.append(x, np.uint32(end_id)) for x in np.split(flat, np.cumsum(counts)[:-1])]
            rows = []
            if out is None or at >= FILE_BYTES:
                if out:
                    out.close()
                (out, uri), at = new_file(folder, ".records"), 0
            for lo in range(0, len(keys), 4000):
                records = frame([payload(k, x) for k, x in zip(keys[lo : lo + 4000], ids[lo : lo + 4000], strict=True)])
                for k, x, r in zip(keys[lo : lo + 4000], ids[lo : lo + 4000], records, strict=True):
                    rows.append((part, k, uri, at, len(r), len(x)))
                    at += len(r)
                out.write(b"".join(records))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        parts, size, done = [], 0, []
        for batch in batches:
            before, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()), 0
            while lo < batch.num_rows:  # up to the row at which the block is full
                room = BLOCK_BYTES - size + (before[lo - 1] if lo else 0)
                hi = min(int(np.searchsorted(before, room)) + 1, batch.num_rows)
                parts.append(batch.slice(lo, hi - lo))
                size += int(before[hi - 1] - (before[lo - 1] if lo else 0))
                lo = hi
                if size >= BLOCK_BYTES:
                    done.append(flush(parts))
                    parts, size = [], 0
        if parts:
            done.append(flush(parts))
        if out:
            out.close()  # the index is handed on once the files are whole
        release()
        yield from done

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(run, INDEX), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index and start: how many ids stand before each document's. One row a file part goes through one task."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "file", "offset")) - F.col("n_tokens")
    return index.withColumn("inside", inside).join(F.broadcast(totals.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("inside"))


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian 32 bit) of every record that the index names."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            lo = 0
            while lo < len(rows):
                hi, size = lo + 1, rows[lo][2]
                while hi < len(rows) and rows[hi][0] == rows[lo][0] and rows[hi][1] == rows[hi - 1][1] + rows[hi - 1][2] and size < READ_BYTES:
                    size += rows[hi][2]
                    hi += 1
                if rows[lo][0] != uri:
                    if file:
                        file.close()
                    uri, file = rows[lo][0], open_file(rows[lo][0])
                file.seek(rows[lo][1])
                out = []
                for (_, _, _, start), data in zip(rows[lo:hi], unframe(file.read(size)), strict=True):
                    key, ids = parse_payload(data)
                    raw = ids.tobytes()
                    out.append((key, start, len(ids), zlib.crc32(raw), raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                lo = hi
        if file:
            file.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = (F.col("offset") / READ_BYTES).cast("long")
    rows = with_starts(index).repartition(parts, F.col("file"), block).sortWithinPartitions("file", "offset")
    return rows.select("file", "offset", "size", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
