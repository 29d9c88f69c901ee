"""Cryptographic calls observed in running processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions import grades as g
from keyfathom.session import small_table

KEY = ["host_id", "algorithm", "symbol", "process_name", "pid"]


def probes(spark) -> DataFrame:
    return small_table(spark, grades.RUNTIME_PROBES, ["probe_id", "library", "symbol", "algorithm"])


def aggregate_events(events: DataFrame) -> DataFrame:
    """Calls per (host, probe, pid): count, first and last time, process name.

    ``events(host_id, ts, pid, probe_id, comm)``.  Names of one process are
    counted separately first, so that only numbers are combined map-side; the
    name seen earliest is then kept.
    """
    named = events.groupBy("host_id", "probe_id", "pid", "comm").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return named.groupBy("host_id", "probe_id", "pid").agg(
        F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"), F.min(F.struct("first", "comm")).alias("_c")).select(
        "host_id", "probe_id", "pid", F.col("_c.comm").alias("process_name"), "occurrences",
        "first_seen", "last_seen")


def resolve_probes(rows: DataFrame) -> DataFrame:
    """Replace probe ids by symbol, library and algorithm; unknown ids are dropped."""
    return rows.join(F.broadcast(probes(rows.sparkSession)), "probe_id").drop("probe_id")


def merge(batches: DataFrame) -> DataFrame:
    """Add up aggregates of the same calls: sum of counts, earliest first, latest last."""
    keys = [c for c in batches.columns if c not in ("occurrences", "first_seen", "last_seen")]
    return batches.groupBy(*keys).agg(
        F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def with_registry(rows: DataFrame) -> DataFrame:
    """Registry grades by algorithm; unknown algorithms have none and are not safe."""
    name = F.col("algorithm")
    return rows.withColumns({
        "algo_type": g.registry_field(name, "algo_type"),
        "risk_level": g.registry_field(name, "risk_level"),
        "quantum_status": g.registry_field(name, "quantum_status"),
        "quantum_safe": g.is_quantum_safe(g.registry_field(name, "quantum_status")),
        "nist_replacement": g.registry_field(name, "nist_replacement")})


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Runtime findings after more were reported.

    Both sides have the key columns, library, occurrences, first_seen and
    last_seen; ``incoming`` may also carry ``seq``, the order of arrival.
    Counts grow, the first time can only move back, the last time is the one
    reported last, and a reported library replaces a known one.  Grouping (not
    joining) treats null process names and pids as equal.
    """
    columns = [*KEY, "library", "occurrences", "first_seen", "last_seen"]
    seq = F.col("seq") if "seq" in incoming.columns else F.lit(1)
    new = incoming.select(*columns, seq.cast("long").alias("seq")).withColumn(
        "occurrences", F.greatest("occurrences", F.lit(0)))
    both = existing.select(*columns, F.lit(-1).cast("long").alias("seq")).unionByName(new)
    return both.groupBy(*KEY).agg(
        F.max_by("library", F.when(F.coalesce("library", F.lit("")) != "", F.struct("seq", "last_seen"))).alias("library"),
        F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"),
        F.max_by("last_seen", F.struct("seq", "last_seen")).alias("last_seen"))


def heartbeats(reports: DataFrame) -> DataFrame:
    """Newest name and versions of each host, a missing value keeping the older one."""
    def newest(column: str):
        return F.max_by(column, F.when(F.coalesce(column, F.lit("")) != "", F.col("received_at"))).alias(column)

    return reports.groupBy("host_id").agg(
        newest("hostname"), newest("agent_version"), newest("kernel_info"),
        F.max("received_at").alias("last_seen_at"))


def correlate(findings: DataFrame, runtime_findings: DataFrame, hosts: DataFrame) -> DataFrame:
    """(repo_id, algorithm) seen in code, at run time, or both."""
    static = findings.where(~F.col("archived")).select("repo_id", "algorithm").distinct().withColumn("s", F.lit(True))
    live = (runtime_findings.select("host_id", "algorithm").distinct()
            .join(hosts.select("host_id", "repo_id"), "host_id")
            .select("repo_id", "algorithm").distinct().withColumn("r", F.lit(True)))
    return static.join(live, ["repo_id", "algorithm"], "full").select(
        "repo_id", "algorithm", F.col("s").isNotNull().alias("seen_static"),
        F.col("r").isNotNull().alias("seen_runtime"))
