"""Queries of media files: depth images at the joints' pixels, and videos whose containers are made from events, written and read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import quality as Q
from ..sources import media as M
from ..sources import shared
from . import quality

WIDTH, HEIGHT = 640, 480
FRAME = ["episode_id", "frame"]


def _pictures(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A depth image for each frame; rows with pixels take the filters in turn."""
    for part in parts:
        made = []
        for pixels in part["pixels"]:
            depth, filters = np.zeros((HEIGHT, WIDTH)), [0] * HEIGHT
            for p in pixels:
                depth[p["v"], p["u"]] = max(depth[p["v"], p["u"]], p["depth"])
                filters[p["v"]] = p["v"] % 5
            made.append(M.encode_depth(depth, filters=filters))
        yield pd.DataFrame({"name": part["name"], "content": made})


def _depth_files(spark: SparkSession, sf_dir: str, points: DataFrame) -> DataFrame:
    """episode_id, frame, u, v and depth, read from one image a frame at the joints' pixels."""
    inside = quality._depth(points).where(f"u BETWEEN 0 AND {WIDTH - 1} AND v BETWEEN 0 AND {HEIGHT - 1}")
    name = F.format_string("depth-%d-%d.png", "episode_id", "frame").alias("name")
    pictures = inside.groupBy(name).agg(F.collect_list(F.struct("u", "v", "depth")).alias("pixels")).mapInPandas(_pictures, "name string, content binary")
    files = shared.written(M.write_files(pictures, shared.new_folder(spark, "depth")), "depth-files")
    found = M.depth_at(inside.select(*FRAME, "u", "v", name).join(files, "name"))
    parts = F.split(F.regexp_extract("path", r"depth-(\d+-\d+)\.png$", 1), "-")
    return found.select(parts[0].cast("long").alias("episode_id"), parts[1].cast("long").alias("frame"), "u", "v", F.col("depth_m").alias("depth"))


def depth_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth_files(spark, sf_dir, quality._points(spark, sf_dir)).withColumn("depth", F.round("depth", 3))


def depth_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = quality._points(spark, sf_dir)
    found = Q.depth_disagreement(points, _depth_files(spark, sf_dir, points), quality.EPISODE)
    return found.select("episode_id", F.round("depth_disagreement_m_median", 6).alias("median_m"))


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4(width: int, height: int, scale: int, delta: int, sizes: list[int], per_chunk: int = 4) -> bytes:
    """A video of frames of zeros of the given sizes."""
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    heads = list(range(0, len(sizes), per_chunk))

    def moov(start: int) -> bytes:
        ends = np.cumsum([0, *sizes])
        table = box(
            b"stbl", box(b"stsd", ints(0, 1), box(b"avc1", bytes(78))), box(b"stts", ints(0, 1, len(sizes), delta)), box(b"stsc", ints(0, 1, 1, per_chunk, 1)),
            box(b"stsz", ints(0, 0, len(sizes), *sizes)), box(b"stco", ints(0, len(heads), *[start + int(ends[h]) for h in heads])),
        )
        media = box(b"mdia", box(b"mdhd", ints(0, 0, 0, scale, delta * len(sizes), 0)), box(b"hdlr", ints(0, 0), b"vide", bytes(13)), box(b"minf", table))
        return box(b"moov", box(b"mvhd", bytes(100)), box(b"trak", box(b"tkhd", bytes(76), ints(width << 16, height << 16)), media))

    head = box(b"ftyp", b"isom", bytes(4))
    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + box(b"mdat", bytes(sum(sizes)))


def avi(width: int, height: int, scale: int, rate: int, sizes: list[int]) -> bytes:
    ints = lambda *x: struct.pack(f"<{len(x)}I", *x)
    part = lambda kind, body: kind + ints(len(body)) + body + bytes(len(body) % 2)
    main = part(b"avih", ints(0, 0, 0, 0, len(sizes), 0, 1, 0, width, height, 0, 0, 0, 0))
    stream = part(b"strh", b"vidsMJPG" + ints(0, 0, 0, scale, rate, 0, len(sizes), 0, 0, 0, 0, 0))
    frames = b"".join(part(b"00dc", bytes(n)) for n in sizes)
    return part(b"RIFF", b"AVI " + part(b"LIST", b"hdrl" + main + part(b"LIST", b"strl" + stream)) + part(b"LIST", b"movi" + frames))


def _videos(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        made = []
        for user, sizes in zip(part["user_id"], part["sizes"], strict=True):
            sizes = [int(s) for s in sizes]
            width, height = 320 + 160 * (user % 5), 240 + 120 * (user % 3)
            data = avi(width, height, 1, 25, sizes) if user % 4 == 1 else mp4(width, height, 600, 20 + 10 * (user % 3), sizes)
            if user % 4 == 2:  # the last third of the frames is missing, and a byte of the one before
                data = data[: len(data) - sum(sizes[len(sizes) - len(sizes) // 3 :]) - 1]
            made.append(data[:100] if user % 8 == 3 else data)
        yield pd.DataFrame({"name": [f"video-{u}.bin" for u in part["user_id"]], "content": made})


def video_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the frames of a video; some are cut off, some within their description."""
    events = adapters.table(spark, sf_dir, "events")
    frames = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", adapters.props_k().alias("k")))), lambda x: x["k"] + 1).alias("sizes"))
    folder = shared.new_folder(spark, "videos")
    shared.written(M.write_files(frames.mapInPandas(_videos, "name string, content binary"), folder), "video-files")
    found = M.probes(M.listing(spark, folder, "video-*.bin"))
    return found.select(
        F.regexp_extract("path", r"video-(\d+)\.bin$", 1).cast("long").alias("user_id"), "container", "codec", "width", "height", F.round("fps", 6).alias("fps"), "n_frames",
        F.round("duration_s", 6).alias("duration_s"), "corrupt_frames", F.col("note").isNotNull().alias("damaged"),
    )


NAMES = [depth_from_files, depth_file_check, video_probe]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


DEPTH_SQL = (
    quality.POINTS
    + f""", px AS (SELECT episode_id, frame, CAST(round_even(u, 0) AS BIGINT) AS u, CAST(round_even(v, 0) AS BIGINT) AS v, floor((CASE WHEN frame % 20 = 10 THEN 0 ELSE cam_z + CASE WHEN frame % 3 = 0 THEN 0.2 ELSE 0.05 END END) * 1000) / 1000 AS depth FROM pts WHERE front),
dep AS (SELECT episode_id, frame, u, v, max(depth) AS depth FROM px WHERE u BETWEEN 0 AND {WIDTH - 1} AND v BETWEEN 0 AND {HEIGHT - 1} GROUP BY ALL)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "depth_from_files": DEPTH_SQL + " SELECT episode_id, frame, u, v, round(depth, 3) AS depth FROM dep",
        "depth_file_check": DEPTH_SQL
        + f""", every AS (SELECT *, dense_rank() OVER (PARTITION BY episode_id ORDER BY frame) - 1 AS i FROM pts)
            SELECT e.episode_id, round(median(abs(depth - cam_z)), 6) AS median_m FROM every e JOIN dep ON dep.episode_id = e.episode_id AND dep.frame = e.frame AND dep.u = CAST(round_even(e.u, 0) AS BIGINT) AND dep.v = CAST(round_even(e.v, 0) AS BIGINT) WHERE front AND i % {Q.DEPTH_STRIDE} = 0 AND depth > 0 GROUP BY 1""",
        "video_probe": """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, user_id % 8 = 3 AS bad, user_id % 4 = 1 AS is_avi, CASE WHEN user_id % 4 = 2 THEN n - n // 3 - 1 ELSE n END AS there, CASE WHEN user_id % 4 = 1 THEN 25.0 ELSE 600 / (20 + 10 * (user_id % 3)) END AS rate FROM u)
            SELECT user_id, CASE WHEN bad THEN '' WHEN is_avi THEN 'avi' ELSE 'mp4' END AS container, CASE WHEN bad THEN '' WHEN is_avi THEN 'MJPG' ELSE 'avc1' END AS codec,
                CAST(CASE WHEN bad THEN 0 ELSE 320 + 160 * (user_id % 5) END AS INTEGER) AS width, CAST(CASE WHEN bad THEN 0 ELSE 240 + 120 * (user_id % 3) END AS INTEGER) AS height, CAST(round(CASE WHEN bad THEN 0 ELSE rate END, 6) AS DOUBLE) AS fps,
                CASE WHEN bad THEN 0 ELSE there END AS n_frames, CAST(round(CASE WHEN bad THEN 0 ELSE there / rate END, 6) AS DOUBLE) AS duration_s, CASE WHEN bad THEN 0 ELSE n - there END AS corrupt_frames, bad AS damaged FROM s""",
    }
