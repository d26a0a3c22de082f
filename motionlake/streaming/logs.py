"""Log and job streams: windows, duplicates, latest states. Each function takes a stream or a table alike."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: How late an event may be.
LATE = "1 hour"

# States of a job in order; the last two end it.
STATES = ["queued", "generating", "reviewing", "labeling", "rendering", "completed", "failed"]


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of parquet files as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def with_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark where events stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, LATE) if rows.isStreaming else rows


def tumbling_counts(events: DataFrame, width: str, *keys: str) -> DataFrame:
    found = with_time(events).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding_average(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    found = with_time(events).groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), *keys, "mean", "n")


def session_windows(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    found = with_time(events).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def without_repeats(events: DataFrame, *keys: str) -> DataFrame:
    """One event of each key; a stream forgets keys that are later than its watermark."""
    rows = with_time(events)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def numbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """rows with id: their places in order, from start on, without gaps.

    Rows are dealt out by ranges of the order and written with their place in their range; only the ranges' sizes go to the driver.
    Rows alike in the whole order keep one range, in any order.
    """
    place = F.monotonically_increasing_id()  # the range's number above 33 bits of the place in it
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place)
    kept = written(ranged.select("*", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__place")).drop("__at"), "numbered")
    sizes = sorted((r["__range"], r["count"]) for r in kept.groupBy("__range").count().collect())
    starts, at = [], start
    for part, size in sizes:
        starts.append((part, at))
        at += size
    first = rows.sparkSession.createDataFrame(starts, "__range long, __start long")
    return kept.join(F.broadcast(first), "__range").withColumn("id", F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")


def append_numbered(stream: DataFrame, folder: str, order: list[str]) -> None:
    """Append all that a stream has to a log (folder/log) with dense ids that go on over batches and runs.

    Each batch has a folder of its own, which is written anew if the batch is; its ids begin behind those of the batches before it,
    so a batch that is run again gets the ids that it had.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = 0
        if number > 0:
            before = read_log(spark, folder, batch.schema).where(F.col("batch") < number).agg(F.max("id")).first()[0]
            start = 0 if before is None else before + 1
        numbered(batch, order, start).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def read_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The log's rows with id and batch."""
    return spark.read.schema(schema.add("id", "long") if "id" not in schema.names else schema).option("basePath", f"{folder}/log").parquet(f"{folder}/log/batch=*")


def since(log: DataFrame, last_id: int | None) -> DataFrame:
    """Entries after an id, or all."""
    return log if last_id is None else log.where(F.col("id") > last_id)


def matching(log: DataFrame, level: str | None = None, agent: str | None = None, text: str = "") -> DataFrame:
    """Entries of a level and an agent whose fields hold a text, whatever its case."""
    out = log
    for name, value in (("level", level), ("agent", agent)):
        out = out if value is None else out.where(F.col(name) == value)
    fields = F.lower(F.concat_ws(" ", "message", "agent", "level", "batch_id", "job_id"))
    return out.where(F.contains(fields, F.lit(text.lower()))) if text else out


def furthest_state(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Each job's latest change and the furthest state it reached, of changes (job, ts, state) in a table or a stream."""
    order = F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))])
    place = F.try_element_at(order, F.col("state"))
    return changes.groupBy(key).agg(F.max_by("state", F.struct("ts", place)).alias("state"), F.max(place).alias("furthest"), F.count("*").alias("changes"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run all that is there through the stream and read the result from memory (tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", os.path.join(checkpoint, name)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
