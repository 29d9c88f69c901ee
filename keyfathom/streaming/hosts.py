"""Heartbeats of hosts as a stream: one stored state per host, and a timer that tells of silence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("hostname", "agent_version", "kernel_info")
_STATE = ", ".join(f"{f} string, {f}_at long" for f in FIELDS) + ", last_seen long"
_OUTPUT = "host_id string, " + ", ".join(f"{f} string" for f in FIELDS) + ", last_seen long, status string"


class HostState(StatefulProcessor):
    """Newest value of every field of a host, whatever order its reports come in; times in microseconds.

    A missing or empty value keeps the older one; of two with the same time the greater one stays.
    The host's one timer is set anew by every report that is the latest so far.
    """

    def __init__(self, silent_seconds: int) -> None:
        self.silent_seconds = silent_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", _STATE)

    def _silent_at(self, last_seen: int) -> int:
        return last_seen // 1000 + 1000 * self.silent_seconds

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        kept = self.host.get()
        state = dict(zip(_names(_STATE), kept, strict=True)) if kept else dict.fromkeys(_names(_STATE))
        before = state["last_seen"]
        for row in rows:
            for field in FIELDS:
                if row[field] and (state[f"{field}_at"] is None
                                   or (row["at"], row[field]) > (state[f"{field}_at"], state[field])):
                    state[field], state[f"{field}_at"] = row[field], row["at"]
            state["last_seen"] = max(row["at"], state["last_seen"] or row["at"])
        self.host.update(tuple(state.values()))
        if before != state["last_seen"]:
            if before is not None:
                self.handle.deleteTimer(self._silent_at(before))
            self.handle.registerTimer(self._silent_at(state["last_seen"]))
        yield self._row(key, state, "alive")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield self._row(key, dict(zip(_names(_STATE), self.host.get(), strict=True)), "silent")

    def _row(self, key: tuple, state: dict, status: str) -> Row:
        return Row(host_id=key[0], **{f: state[f] for f in FIELDS}, last_seen=state["last_seen"], status=status)

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def host_changes(reports: DataFrame, silent_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """(host_id, hostname, agent_version, kernel_info, last_seen_at, status) of every host that reports or falls silent.

    ``reports(host_id, received_at, hostname, agent_version, kernel_info)`` is a stream.  A host is silent
    when the watermark is `silent_seconds` past its last report; its next report makes it alive again.
    Reports without a host or a time are left out.  The state store must be RocksDB.
    """
    rows = reports.withWatermark("received_at", delay).where("host_id IS NOT NULL AND received_at IS NOT NULL").select(
        "host_id", "received_at", F.unix_micros("received_at").alias("at"), *FIELDS)
    found = rows.groupBy("host_id").transformWithState(HostState(silent_seconds), _OUTPUT, "Update", "EventTime")
    return found.select("host_id", *FIELDS, F.timestamp_micros("last_seen").alias("last_seen_at"), "status")


def host_stream(reports: DataFrame, path: str, checkpoint: str, silent_seconds: int = 300, delay: str = "10 minutes",
                trigger: dict | None = None) -> StreamingQuery:
    """Keep what host_changes tells below `path`, one folder per micro-batch; a batch run again overwrites its folder."""
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (host_changes(reports, silent_seconds, delay).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def current_hosts(spark: SparkSession, path: str) -> DataFrame:
    """One row per host: its last change."""
    changes = spark.read.parquet(path)
    fields = [c for c in changes.columns if c not in ("host_id", "batch_id")]
    order = F.struct("batch_id", "last_seen_at", (F.col("status") == "silent").cast("int"))
    return changes.groupBy("host_id").agg(F.max_by(F.struct(*fields), order).alias("s")).select("host_id", "s.*")
