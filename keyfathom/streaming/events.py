"""Webhooks, scan states and reconciliation as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfathom.dims import grades
from keyfathom.operators import lifecycle
from keyfathom.sources.tables import webhook_events


def scan_requests(deliveries: DataFrame, repos: DataFrame) -> DataFrame:
    """Webhook deliveries with status scan_queued or ignored; a projection, so it streams.

    A scan is due for a push or merge event on the branch the repository is
    tracked on; an unknown branch on either side does not stand in the way.
    """
    events = webhook_events(deliveries)
    tracked = repos.select("repo_id", F.col("branch").alias("_tracked"))
    joined = events.join(tracked, "repo_id", "left")
    wanted = F.lower("event_type").isin(grades.SCAN_EVENTS)
    given = F.coalesce("branch", F.lit(""))
    own = F.coalesce("_tracked", F.lit(""))
    other_branch = (given != "") & (own != "") & (given != own)
    status = F.when(wanted & ~other_branch, "scan_queued").otherwise("ignored")
    return joined.withColumn("status", status).drop("_tracked")


def queue_scans(deliveries: DataFrame, repos_at: Callable[[int], DataFrame], path: str, checkpoint: str,
                delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Scan requests from a stream of webhook deliveries, each delivery once, one folder per micro-batch.

    A provider that gets no answer sends a delivery again: within `delay` of event time it counts once,
    also after a restart.  ``repos_at(batch_id)`` reads the repositories as they are to be seen by a
    batch; it must give a batch that is run again what it gave it first, so that its folder is
    overwritten with the same rows.
    """
    once = deliveries.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["delivery_id"])

    def store(batch: DataFrame, batch_id: int) -> None:
        scan_requests(batch, repos_at(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def run_states(changes: DataFrame) -> DataFrame:
    """Current state of each scan run from ``changes(scan_run_id, status, changed_at)``."""
    rank = F.col("status").isin("complete", "failed").cast("int")  # final states win ties
    return changes.groupBy("scan_run_id").agg(
        F.max_by("status", F.struct(F.col("changed_at"), rank)).alias("status"),
        F.min("changed_at").alias("started_at"), F.max("changed_at").alias("changed_at"))


def reconcile_stream(scans: DataFrame, load: Callable[[int, DataFrame], DataFrame],
                     save: Callable[[DataFrame, int], None], as_of: Column, checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """Reconcile the findings table with each micro-batch of scan results.

    ``scans`` carries ``repo_id, scan_run_id`` and the findings' columns; a scan
    without findings sends one row whose ``file_path`` is null.  A micro-batch
    must hold one scan per repository.  ``load(batch_id, runs)`` reads the rows of
    the repositories in ``runs`` as they were before the batch and
    ``save(rows, batch_id)`` writes what they are after it.  Versions are told
    apart by batch id, so a batch that is run again starts from the same rows,
    and repositories not scanned need not be read or written at all.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        runs = batch.select("repo_id", "scan_run_id").distinct()
        found = batch.where(F.col("file_path").isNotNull())
        existing = load(batch_id, runs)
        updated = lifecycle.reconcile(existing, found, runs, as_of).drop("action")
        fresh = lifecycle.untracked(existing, found, runs).withColumns({
            "migration_status": F.lit("open"), "archived": F.lit(False), "source_type": F.lit("source_code")})
        fresh = fresh.select(*[c for c in existing.columns if c in fresh.columns])
        save(updated.unionByName(fresh, allowMissingColumns=True), batch_id)

    return (scans.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
