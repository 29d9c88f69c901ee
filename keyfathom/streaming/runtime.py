"""Runtime events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfathom.operators import runtime


def windowed_calls(events: DataFrame, window: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Calls per host, probe and process in tumbling windows of event time.

    Works on a stream and on a table.  State per open window is one row per key;
    the watermark closes windows.
    """
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "host_id", "probe_id", "pid").agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("comm", "ts").alias("process_name"))
    flat = grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "host_id", "probe_id", "pid", "process_name", "occurrences", "first_seen", "last_seen")
    return runtime.resolve_probes(flat)


def append_windows(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (windows.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def dropped_late(query: StreamingQuery) -> int:
    """How many rows of a run came behind the watermark and were dropped, as far as its progress is remembered.

    Rows that a task has already combined into one of a window and key are counted as one.
    """
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for state in progress["stateOperators"])


def upsert_stream(incoming: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep runtime findings up to date from a stream of reported findings.

    Every micro-batch is reduced to one row per key and written to its own
    ``batch_id`` folder.  A batch that is run again overwrites its folder, so
    restarts change nothing, and the growing table is never rewritten.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        empty = batch.sparkSession.createDataFrame([], batch.select(
            *runtime.KEY, "library", "occurrences", "first_seen", "last_seen").schema)
        runtime.upsert(empty, batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def current_findings(spark: SparkSession, path: str, compacted: str | None = None) -> DataFrame:
    """State of the upserted table: its batches folded in order, with registry grades.

    With a compacted version, only batches newer than the one it ends with are added.
    """
    batches = spark.read.parquet(path)
    if compacted is not None:
        base = spark.read.parquet(compacted)
        last = base.agg(F.max("batch_id").alias("b")).first()["b"]
        batches = base.unionByName(batches.where(F.col("batch_id") > last))
    batches = batches.withColumn("seq", F.col("batch_id").cast("long"))
    return runtime.with_registry(runtime.upsert(batches.drop("batch_id", "seq").limit(0), batches))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold all batches into a new table version holding one batch."""
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch_id").cast("long").alias("b")).first()["b"]
    folded = runtime.upsert(batches.drop("batch_id").limit(0), batches.withColumn("seq", F.col("batch_id").cast("long")))
    folded.write.mode("overwrite").parquet(f"{target}/batch_id={last}")
