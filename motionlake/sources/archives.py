"""Dataset archives: a Spark data source that writes ZIP files of samples and reads them back by their central directories.

Tasks build archives on their own, one for each batch that they have rows of, and a new one once ``most_bytes`` are reached; a
sample's files stay together. An archive ends with ``dataset.json``, which lists its samples with decision and files, and with the
ZIP's central directory. Archives count only once the driver has written the manifest that names them, which it does when all tasks
have ended (two-phase commit): what a lost or failed attempt leaves is never read. Messages to the driver tell of archives, never of
members. Reading is one task an archive; members come by ranges that the central directory names.

Rows to write: batch_id, sample, job_id, decision, score, kind (one of KINDS) and content, all text but score (double) and content
(binary). Nulls: a batch or sample without a name is "unknown", a decision too; rows without a kind or content are no files. Samples
that were never generated (neither of GENERATED) are left out. Files of one name get a number, in order of jobs. Extra columns are
ignored. Reading an empty folder gives no rows.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "motion_archives"
# Names of a sample's files, those that show that it was generated, and decisions that accept.
KINDS = {
    "video": "video.mp4", "labeled_preview": "labeled_preview.mp4", "labels": "labels.json", "report": "report.json", "semantics": "semantics.json",
    "scenario": "scenario.json", "start_frame": "start_frame.png",
}
GENERATED, ACCEPTED = ("video", "labeled_preview"), ("accept", "passed")
MEMBERS = "batch_id string, archive string, name string, size long, crc long, content binary"
COLUMNS = ["batch_id", "sample", "job_id", "decision", "score", "kind", "content"]
MOST_BYTES = 1 << 30


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if uri.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def manifests(folder: str) -> list[str]:
    fs, path = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


def listed(folder: str) -> list[dict]:
    """Archives that committed writes name."""
    fs, _ = file_system(folder)
    out = []
    for path in manifests(folder):
        with fs.open_input_file(path) as f:
            out += json.loads(f.read())["archives"]
    return out


@dataclass
class Built(WriterCommitMessage):
    archives: list[dict]


class Archive:
    """One ZIP that a task writes: members as they come, then its index."""

    def __init__(self, folder: str, batch: str):
        self.batch, self.file = batch, f"archive-{uuid.uuid4().hex}.zip"
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.stream = fs.open_output_stream(f"{path}/{self.file}", compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.names, self.samples, self.bytes = set(), {}, 0

    def put(self, name: str, content: bytes) -> str:
        stem, dot, suffix = name.rpartition(".")
        k, final = 2, name
        while final in self.names:
            final, k = f"{stem}_{k}{dot}{suffix}", k + 1
        self.names.add(final)
        self.zip.writestr(zipfile.ZipInfo(final), content)  # of one fixed date, so that attempts write the same bytes
        self.bytes += len(content)
        return final

    def add(self, row: Row) -> None:
        sample = self.samples.setdefault(
            (row["sample"], row["job_id"]),
            {"scenario_id": row["sample"], "job_id": row["job_id"], "decision": row["decision"], "accepted": row["decision"] in ACCEPTED, "plausibility_score": row["score"], "files": {}},
        )
        sample["files"][row["kind"]] = self.put(f"samples/{row['sample']}/{KINDS[row['kind']]}", bytes(row["content"]))

    def finish(self, more: dict) -> dict:
        accepted = sum(s["accepted"] for s in self.samples.values())
        counts = {"samples": len(self.samples), "accepted": accepted, "rejected": len(self.samples) - accepted}
        self.put("dataset.json", json.dumps({"batch_id": self.batch, **more, "counts": counts, "samples": list(self.samples.values())}, indent=1, ensure_ascii=False).encode())
        self.zip.close()
        self.stream.close()
        return {"batch_id": self.batch, "file": self.file, "members": len(self.names), "bytes": self.bytes, **counts}


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most, self.about = int(options.get("most_bytes", MOST_BYTES)), json.loads(options.get("about", "{}"))

    def write(self, iterator: Iterator[Row]) -> Built:
        done, now, sample = [], None, None
        for row in iterator:
            if now and (row["batch_id"] != now.batch or (row["sample"] != sample and now.bytes >= self.most)):
                done.append(now.finish(self.about))
                now = None
            now = now or Archive(self.folder, row["batch_id"])
            now.add(row)
            sample = row["sample"]
        return Built(done + ([now.finish(self.about)] if now else []))

    def commit(self, messages: list[Built | None]) -> None:
        old = manifests(self.folder) if self.overwrite else []
        gone = listed(self.folder) if self.overwrite else []
        fs, path = file_system(self.folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.part", compression=None) as f:
            f.write(json.dumps({"archives": [a for m in messages if m for a in m.archives]}).encode())
        fs.move(f"{name}.part", name)
        for past in [*old, *(f"{path}/{a['file']}" for a in gone)]:
            fs.delete_file(past)

    def abort(self, messages: list[Built | None]) -> None:
        fs, path = file_system(self.folder)
        for a in (a for m in messages if m for a in m.archives):
            fs.delete_file(f"{path}/{a['file']}")


@dataclass
class Part(InputPartition):
    batch: str
    file: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.content = options["path"].rstrip("/"), options.get("content", "true") == "true"

    def partitions(self) -> list[Part]:
        return [Part(a["batch_id"], a["file"]) for a in listed(self.folder)] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        fs, path = file_system(self.folder)
        with fs.open_input_file(f"{path}/{partition.file}") as f, zipfile.ZipFile(f) as archive:
            for member in archive.infolist():
                yield partition.batch, partition.file, member.filename, member.file_size, member.CRC, archive.read(member) if self.content else None


class ArchiveSource(DataSource):
    """``format("motion_archives")`` with the options path, most_bytes, about (JSON that each index carries), and for reading content
    (false: the index alone, so that only central directories are read)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def write_archives(files: DataFrame, folder: str, about: dict | None = None, most_bytes: int = MOST_BYTES, mode: str = "append") -> None:
    """Files of samples (see above) as archives. Rows are dealt out by ranges of batch and sample, so a large batch is split."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    rows = files.where(F.col("kind").isin(*KINDS) & F.col("content").isNotNull())
    rows = rows.select(unknown("batch_id"), unknown("sample"), F.col("job_id").cast("string").alias("job_id"), unknown("decision"), F.col("score").cast("double").alias("score"), "kind", F.col("content").cast("binary").alias("content"))
    made = rows.where(F.col("kind").isin(*GENERATED)).select("batch_id", "sample", "job_id").distinct()
    same = [rows[c].eqNullSafe(made[c]) for c in ("batch_id", "sample", "job_id")]
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ready = rows.join(made, same, "left_semi").repartitionByRange("batch_id", "sample").sortWithinPartitions("batch_id", "sample", "job_id", place)
    files.sparkSession.dataSource.register(ArchiveSource)
    ready.write.format(NAME).option("most_bytes", most_bytes).option("about", json.dumps(about or {})).mode(mode).save(folder)


def read_archives(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """batch_id, archive, name, size, crc and content of every member of the archives that are committed."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("content", str(content).lower()).load(folder)
