"""Video containers and depth images: hand-built files, all filters, files that are cut off anywhere."""

import struct
import time
import zlib

import numpy as np
import pytest

from motionlake.plans import media as P
from motionlake.sources import media as M


def stored(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/{name}"


def test_mp4_as_it_describes_itself(tmp_path):
    sizes = [10, 0, 7, 300, 5, 5, 1]
    data = P.mp4(1280, 720, 600, 20, sizes)
    got = M.probe_file(stored(tmp_path, "whole", data))
    assert got == {"container": "mp4", "codec": "avc1", "width": 1280, "height": 720, "fps": 30.0, "n_frames": 7, "duration_s": 7 / 30, "corrupt_frames": 0, "note": None}
    ends, start = np.cumsum(sizes), len(data) - sum(sizes)
    for cut in range(start, len(data)):
        got = M.probe_file(stored(tmp_path, "cut", data[:cut]))
        assert got["n_frames"] == int((start + ends <= cut).sum()) and got["n_frames"] + got["corrupt_frames"] == 7


def test_fixed_sizes_wide_offsets_and_moov_behind_the_frames(tmp_path):
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    table = P.box(b"stbl", P.box(b"stsd", ints(0, 1), P.box(b"hvc1", bytes(78))), P.box(b"stts", ints(0, 2, 3, 10, 1, 30)), P.box(b"stsc", ints(0, 2, 1, 1, 1, 2, 3, 1)), P.box(b"stsz", ints(0, 50, 4)), P.box(b"co64", ints(0, 2), struct.pack(">2Q", 16, 66)))
    sound = P.box(b"trak", P.box(b"tkhd", bytes(84)), P.box(b"mdia", P.box(b"hdlr", ints(0, 0), b"soun", bytes(13))))
    media = P.box(b"mdia", P.box(b"mdhd", b"\1" + bytes(3), bytes(16), ints(100), bytes(12)), P.box(b"hdlr", ints(0, 0), b"vide", bytes(13)), P.box(b"minf", table))
    moov = P.box(b"moov", sound, P.box(b"trak", P.box(b"tkhd", bytes(76), ints(64 << 16, 48 << 16)), media))
    frames = struct.pack(">I4sQ", 1, b"mdat", 16 + 200) + bytes(200)
    got = M.probe_file(stored(tmp_path, "wide", frames + moov))
    assert (got["codec"], got["fps"], got["n_frames"], got["corrupt_frames"], got["note"]) == ("hvc1", 4 * 100 / 60, 4, 0, None)


def test_fragments_count_their_runs(tmp_path):
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    whole = P.mp4(64, 48, 600, 20, [])
    run = lambda n: P.box(b"moof", P.box(b"traf", P.box(b"trun", ints(0, n))))
    got = M.probe_file(stored(tmp_path, "parts", whole + run(12) + P.box(b"mdat", bytes(9)) + run(3)))
    assert (got["n_frames"], got["width"], got["corrupt_frames"]) == (15, 64, 0)


def test_avi_and_its_missing_frames(tmp_path):
    sizes = [11, 4, 8, 3]
    data = P.avi(640, 360, 1, 25, sizes)
    got = M.probe_file(stored(tmp_path, "whole", data))
    assert (got["container"], got["codec"], got["width"], got["height"], got["fps"], got["n_frames"], got["corrupt_frames"]) == ("avi", "MJPG", 640, 360, 25.0, 4, 0)
    assert M.probe_file(stored(tmp_path, "cut", data[:-5]))["corrupt_frames"] == 1


def test_damaged_files_give_a_row_and_no_error(spark, tmp_path):
    whole = [P.mp4(64, 48, 600, 20, [5, 6]), P.avi(64, 48, 1, 25, [5, 6])]
    draw = np.random.default_rng(1)
    bad = [b"", b"x", b"RIFF", b"\0" * 64, draw.bytes(500)] + [w[:k] for w in whole for k in range(0, len(w), 37)]
    for w in whole:
        for _ in range(40):
            b = bytearray(w)
            for at in draw.integers(0, len(w), 3):
                b[at] = draw.integers(256)
            bad.append(bytes(b))
    for k, data in enumerate(bad):
        stored(tmp_path, f"{k:03}.mp4", data)
    (tmp_path / "deep").mkdir()
    stored(tmp_path / "deep", "good.mp4", whole[0])
    stored(tmp_path, "other.txt", b"text")
    rows = M.probes(M.listing(spark, str(tmp_path), "*.mp4")).collect()
    assert len(rows) == sum(map(bool, bad)) + 1 and sum(r.path.endswith("good.mp4") and r.n_frames == 2 for r in rows) == 1
    assert all(r.note for r in rows if r.path.endswith(("001.mp4", "003.mp4")))
    missing = M.probes(spark.createDataFrame([("file:///nowhere/x.mp4",), (f"{tmp_path}/000.mp4",)], "path string")).collect()
    assert all(r.note and r.n_frames == 0 for r in missing)


def test_depth_images_with_all_filters(spark, tmp_path):
    draw = np.random.default_rng(2)
    depth = draw.uniform(0, 70, size=(23, 17))
    depth[3, 4], depth[5, 6], depth[0, 0] = np.nan, -1.0, 0.0015
    want = np.floor(np.clip(np.nan_to_num(depth * 1000), 0, 65535)) / 1000
    for filters in ([v % 5 for v in range(23)], [4] * 23, [3] * 23, None):
        data = M.encode_depth(depth, filters=filters)
        assert np.array_equal(np.array(list(M.depth_rows(data))) / 1000, want)
    assert len(list(M.depth_rows(data, 5))) == 5
    parts = [data[:-50], data[:20], b"", M.encode_depth(depth)[:33] + data[33:]]
    path = stored(tmp_path, "a.png", data)
    cut = [stored(tmp_path, f"cut{k}.png", x) for k, x in enumerate(parts[:3])]
    points = [(path, u, v) for u in range(-1, 18) for v in range(-1, 24)] + [(path, 3, 3), (None, 1, 1), *[(c, 1, 1) for c in cut], ("file:///nowhere.png", 0, 0)]
    rows = M.depth_at(spark.createDataFrame(points, "path string, u long, v long")).collect()
    got = {(r.path, r.u, r.v): r.depth_m for r in rows}
    assert len(rows) == len(got) == 19 * 25 + 4
    assert all(got[path, u, v] == (want[v, u] if 0 <= u < 17 and 0 <= v < 23 else None) for _, u, v in points[: 19 * 25])
    assert all(r.note for r in rows if r.path != path and r.path != cut[0]) and got["file:///nowhere.png", 0, 0] is None


def test_other_pictures_are_told(spark, tmp_path):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(14))) + chunk(b"IEND", b"")
    rows = M.depth_at(spark.createDataFrame([(stored(tmp_path, "c.png", colour), 0, 0)], "path string, u long, v long")).collect()
    assert rows[0].depth_m is None and "16-bit" in rows[0].note


@pytest.mark.parametrize("kind", [3, 4])
def test_empty_rows_of_a_filtered_picture_are_not_decoded_byte_by_byte(kind):
    depth = np.zeros((240, 640))
    depth[3, 5], depth[100, 639], depth[101, 0], depth[200, 320] = 1.234, 65.535, 0.001, 40.0
    took = []
    for k in (0, kind):
        data = M.encode_depth(depth, filters=[k] * 240)
        began = time.process_time()
        got = np.array(list(M.depth_rows(data)))
        took.append(time.process_time() - began)
        assert (got == np.round(depth * 1000)).all()
    assert took[1] < 15 * took[0] + 0.02
