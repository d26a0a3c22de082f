"""Files of pictures as tables: what video containers say of themselves, and depth images by the pixels that are asked for.

Tasks open files by their path and read ranges: of a video the boxes' headers and the one box that describes it, never its frames;
of a depth image the rows down to the last pixel that is asked for. A listing is the table that a folder makes; nothing is decoded
on the driver.

A file that is missing, cut off or of another kind gives a row with a note, never an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import file_system

PROBE = "container string, codec string, width int, height int, fps double, n_frames long, duration_s double, corrupt_frames long, note string"
#: Boxes that hold boxes, of those that are read.
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"}
#: Bytes of a description that are read at most.
MOST_HEADER = 256 << 20
DEPTH_SCALE = 1000.0


class Damaged(ValueError):
    pass


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box of a stretch."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if stop < start + head or stop > end:
            raise Damaged(f"box {kind!r} runs over its end")
        yield kind, start + head, stop
        start = stop


def tree(data: bytes, start: int, end: int) -> list[tuple[bytes, int, int, list]]:
    return [(kind, a, b, tree(data, a, b) if kind in HOLDERS else []) for kind, a, b in boxes(data, start, end)]


def inside(nodes: list, *path: bytes) -> Iterator[tuple]:
    for node in nodes:
        if node[0] == path[0]:
            yield from [node] if len(path) == 1 else inside(node[3], *path[1:])


def one(nodes: list, *path: bytes) -> tuple:
    found = next(inside(nodes, *path), None)
    if found is None:
        raise Damaged(f"no {path[-1].decode()}")
    return found


def numbers(data: bytes, node: tuple, form: str, head: int) -> list[tuple]:
    """Entries behind a count, which lies ``head`` bytes after the box's version and flags."""
    at = node[1] + 4 + head
    count = struct.unpack_from(">I", data, at)[0]
    size = struct.calcsize(form)
    if at + 4 + count * size > node[2]:
        raise Damaged(f"{node[0].decode()} is cut off")
    return list(struct.iter_unpack(form, data[at + 4 : at + 4 + count * size]))


def sample_ends(data: bytes, table: list) -> np.ndarray:
    """Where each sample of a track ends in the file."""
    at = one(table, b"stsz")[1] + 4
    size, count = struct.unpack_from(">II", data, at)
    sizes = np.full(count, size, dtype=np.int64) if size else np.array([x[0] for x in numbers(data, one(table, b"stsz"), ">I", 4)], dtype=np.int64)
    wide = next(inside(table, b"co64"), None)
    chunks = [x[0] for x in (numbers(data, wide, ">Q", 0) if wide else numbers(data, one(table, b"stco"), ">I", 0))]
    runs = numbers(data, one(table, b"stsc"), ">III", 0)
    per = np.zeros(len(chunks), dtype=np.int64)
    for k, (first, samples, _) in enumerate(runs):
        per[first - 1 : runs[k + 1][0] - 1 if k + 1 < len(runs) else None] = samples
    chunk = np.repeat(np.arange(len(chunks)), per)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    total = np.cumsum(sizes)
    begins = np.searchsorted(chunk, np.arange(len(chunks)))
    before = np.concatenate([[0], total])[np.minimum(begins, len(total))]
    return np.array(chunks, dtype=np.int64)[chunk] + total - before[chunk]


def probe_mp4(read, length: int) -> dict:
    """read(at, size) -> bytes of a file of that length."""
    at, moov, fragments = 0, None, []
    while at + 8 <= length:
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", read(at + 8, 8))[0], 16
        size = size or length - at
        if size < head:
            raise Damaged("a box without a size")
        if kind in (b"moov", b"moof"):
            if at + size > length or size > MOST_HEADER:
                raise Damaged(f"{kind.decode()} is cut off")
            body = read(at, size)
            if kind == b"moov":
                moov = body
            else:
                fragments.append(body)
        at += size
    if moov is None:
        raise Damaged("no moov")
    for track in inside(tree(moov, 0, len(moov)), b"moov", b"trak"):
        nodes = track[3]
        if moov[one(nodes, b"mdia", b"hdlr")[1] + 8 :][:4] != b"vide":
            continue
        a, b = one(nodes, b"tkhd")[1:3]
        width, height = (x >> 16 for x in struct.unpack_from(">II", moov, b - 8))
        long_form = moov[one(nodes, b"mdia", b"mdhd")[1]] == 1
        a = one(nodes, b"mdia", b"mdhd")[1]
        scale = struct.unpack_from(">I", moov, a + (20 if long_form else 12))[0]
        table = one(nodes, b"mdia", b"minf", b"stbl")[3]
        times = numbers(moov, one(table, b"stts"), ">II", 0)
        declared, ticks = sum(n for n, _ in times), sum(n * d for n, d in times)
        codec = moov[one(table, b"stsd")[1] + 12 :][:4].decode("latin-1").strip()
        if declared:
            there = int((sample_ends(moov, table) <= length).sum())
        else:  # frames are told by the fragments
            runs = [(body, run) for body in fragments for run in inside(tree(body, 0, len(body)), b"moof", b"traf", b"trun")]
            declared = there = sum(struct.unpack_from(">I", body, run[1] + 4)[0] for body, run in runs)
            ticks = 0
        fps = declared * scale / ticks if ticks else 0.0
        return described("mp4", codec, width, height, fps, there, declared)
    raise Damaged("no video track")


def probe_avi(read, length: int) -> dict:
    head = read(0, min(length, 1 << 16))
    at = head.find(b"avih")
    stream = head.find(b"strh")
    if at < 0 or stream < 0 or len(head) < max(at + 48, stream + 44):
        raise Damaged("no header")
    declared, width, height = struct.unpack_from("<I", head, at + 24)[0], *struct.unpack_from("<II", head, at + 40)
    codec = head[stream + 12 : stream + 16].decode("latin-1").strip("\0 ")
    scale, rate = struct.unpack_from("<II", head, stream + 28)
    at, there = 12, 0
    while at + 12 <= length:  # the list of frames; each frame is a chunk of its own
        kind, size, name = struct.unpack("<4sI4s", read(at, 12))
        if kind == b"LIST" and name == b"movi":
            inner, end = at + 12, at + 8 + size
            while inner + 8 <= min(length, end):
                chunk, n = struct.unpack("<4sI", read(inner, 8))
                there += chunk[2:] in (b"dc", b"db") and inner + 8 + n <= length
                inner += 8 + n + n % 2
        at += 8 + size + size % 2
    return described("avi", codec, width, height, rate / scale if scale else 0.0, min(there, declared), declared)


def described(container: str, codec: str, width: int, height: int, fps: float, there: int, declared: int) -> dict:
    return {
        "container": container, "codec": codec, "width": width, "height": height, "fps": fps, "n_frames": there,
        "duration_s": there / fps if fps > 0 else 0.0, "corrupt_frames": max(0, declared - there), "note": None,
    }


def probe_file(path: str) -> dict:
    """What a video's container says, with the frames whose bytes the file has."""
    nothing = described("", "", 0, 0, 0.0, 0, 0)
    try:
        fs, name = file_system(path)
        with fs.open_input_file(name) as f:
            length = f.size()

            def read(at: int, size: int) -> bytes:
                f.seek(at)
                data = f.read(size)
                if len(data) < size:
                    raise Damaged("the file is cut off")
                return data

            head = read(0, min(length, 12))
            return probe_avi(read, length) if head[:4] == b"RIFF" and head[8:] == b"AVI " else probe_mp4(read, length)
    except (OSError, ValueError, struct.error, IndexError) as e:
        return nothing | {"note": f"cannot be probed: {e}"}


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """name and path of files that tasks write from name and content (binary), each under its name once it is whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                whole = f"{base}/{name}"
                part_name = f"{base}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part_name, compression=None) as f:
                    f.write(content)
                fs.move(part_name, whole)
            yield pd.DataFrame({"name": part["name"], "path": [f"{folder}/{n}" for n in part["name"]]})

    return rows.select("name", "content").mapInPandas(run, "name string, path string")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files of a folder and those below it; their bytes aren't read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def probes(files: DataFrame) -> DataFrame:
    """path and what each file's container says."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROBE.split(", ")]
        for part in parts:
            yield pd.DataFrame([{"path": p, **probe_file(p)} for p in part["path"]], columns=["path", *names])

    return files.select("path").mapInPandas(run, f"path string, {PROBE}")


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of 16-bit samples (bytes) as it was before its filter; what is left of and above the picture is 0."""
    if kind == 0:
        return line
    if kind == 1:
        return (np.cumsum(line.reshape(-1, 2), axis=0, dtype=np.int64) & 255).astype(np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Damaged(f"filter {kind}")
    some = np.flatnonzero(line | above)
    if not len(some):
        return line
    out, up = bytearray(line.tobytes()), above.tobytes()
    # Left of the first byte that isn't 0 all are 0; right of the last one averages fade out and what Paeth guessed last goes on.
    start, stop = int(some[0]), min(len(up), int(some[-1]) + (19 if kind == 3 else 3))
    for i in range(start, stop):
        a, b = out[i - 2] if i > 1 else 0, up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - 2] if i > 1 else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) & 255
    if kind == 4 and stop < len(out):
        left = len(out) - stop
        out[stop:] = (bytes(out[stop - 2 : stop]) * (left // 2 + 1))[:left]
    return np.frombuffer(bytes(out), dtype=np.uint8)


def depth_rows(data: bytes, rows: int | None = None) -> Iterator[np.ndarray]:
    """Rows of a 16-bit grey picture from its top on, no further than asked for."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Damaged("no PNG")
    at, packed, size = 8, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, at + 8)
            size = (width, height)
            if (bits, colour, interlaced) != (16, 0, 0):
                raise Damaged("not a picture of 16-bit grey")
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if size is None:
        raise Damaged("no header")
    width, height = size
    most, length = min(height, height if rows is None else rows), 1 + 2 * width
    above, held, done = np.zeros(2 * width, dtype=np.uint8), b"", 0
    for part in inflated(packed):
        held, at = held + part, 0
        while len(held) - at >= length and done < most:
            line = np.frombuffer(held, dtype=np.uint8, count=2 * width, offset=at + 1)
            above = unfiltered(held[at], line, above)
            at, done = at + length, done + 1
            yield above.view(">u2")
        held = held[at:]
        if done >= most:
            return
    raise Damaged("the picture is cut off")


def inflated(parts: list[bytes]) -> Iterator[bytes]:
    unpack = zlib.decompressobj()
    for part in parts:
        while part:
            yield unpack.decompress(part, 1 << 16)
            part = unpack.unconsumed_tail
    yield unpack.flush()


def guessed(kind: int, line: np.ndarray, up: np.ndarray) -> np.ndarray:
    """What a filter takes from a row's bytes."""
    if kind == 0:
        return np.zeros_like(line)
    left, corner = (np.concatenate([[0, 0], x[:-2]]) for x in (line, up))
    if kind < 4:
        return [left, up, (left + up) >> 1][kind - 1]
    p = left + up - corner
    best = np.where(abs(p - up) <= abs(p - corner), up, corner)
    return np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, best)


def encode_depth(depth_m: np.ndarray, scale: float = DEPTH_SCALE, filters: list[int] | None = None) -> bytes:
    """A depth image (metres; not a number: 0) as a 16-bit PNG; filters by row, none if they aren't given."""
    mm = np.clip(np.nan_to_num(np.asarray(depth_m, dtype=float) * scale, nan=0.0), 0, 65535).astype(">u2")
    height, width = mm.shape
    raw, out = mm.view(np.uint8).reshape(height, 2 * width).astype(np.int64), []
    seen = raw.any(axis=1)
    for v in range(height):
        kind = filters[v] if filters else 0
        if not seen[v] and not (v and seen[v - 1]):
            out.append(bytes([kind]) + bytes(2 * width))
            continue
        out.append(bytes([kind]) + ((raw[v] - guessed(kind, raw[v], raw[v - 1] if v else 0 * raw[v])) & 255).astype(np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


def depth_at(points: DataFrame, scale: float = DEPTH_SCALE) -> DataFrame:
    """path, u, v, depth_m (0: no reading) and note of the pixels that points (path, u, v) ask for, each once; pixels outside a
    picture have no depth, nor have those below where a picture is cut off. Requests meet by path, so each picture is opened once and read down to its last row that is needed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, wanted in zip(part["path"], part["wanted"], strict=True):
                by_row, found, note = defaultdict(list), {}, None
                for p in wanted:
                    by_row[p["v"]].append(p["u"])
                try:
                    fs, name = file_system(path)
                    with fs.open_input_file(name) as f:
                        data = f.read()
                    for v, line in enumerate(depth_rows(data, max([0, *by_row]) + 1)):
                        found |= {(u, v): float(line[u]) / scale for u in by_row.get(v, ()) if 0 <= u < len(line)}
                except (OSError, ValueError, struct.error, zlib.error) as e:
                    note = f"cannot be read: {e}"
                out += [(path, p["u"], p["v"], found.get((p["u"], p["v"])), note) for p in wanted]
            yield pd.DataFrame(out, columns=["path", "u", "v", "depth_m", "note"])

    asked = points.dropna(subset=["path", "u", "v"]).groupBy("path").agg(F.collect_set(F.struct(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))).alias("wanted"))
    return asked.mapInPandas(run, "path string, u long, v long, depth_m double, note string")
