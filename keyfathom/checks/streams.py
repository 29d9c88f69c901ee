"""Checks of streams with stored state: each is run over parts of a table that come one after the other, with a
restart in between."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfathom.checks.activity import _DELIVERIES, _PROBE_CTE
from keyfathom.checks.base import check
from keyfathom.checks.views import Inputs
from keyfathom.operators import runtime
from keyfathom.session import checkpoint_dir
from keyfathom.streaming import events, hosts, levels
from keyfathom.streaming import runtime as stream

NOW = {"availableNow": True}
Start = Callable[[DataFrame, str, str], StreamingQuery]


def _played(i: Inputs, name: str, parts: Iterable[DataFrame], start: Start) -> str:
    """Runs a stream to its end after each part has come; start(source, folder of results, checkpoint)."""
    root = f"{checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        source = i.spark.readStream.schema(part.schema).parquet(f"{root}/in")
        start(source, f"{root}/out", f"{root}/state").awaitTermination()
    return f"{root}/out"


_HALF = "TIMESTAMP '2024-01-15 12:00:00'"
_LATE = f"ts < TIMESTAMP '2024-01-14 00:00:00' AND event_id % 10 = 3"


@check("runtime_windows_stream", f"""WITH {_PROBE_CTE},
first AS (SELECT max(ts) - INTERVAL '10 minutes' AS closed FROM raw_events_v WHERE ts < {_HALF} AND NOT ({_LATE})),
last AS (SELECT max(ts) - INTERVAL '10 minutes' AS closed FROM raw_events_v),
rows AS (SELECT *, time_bucket(INTERVAL '30 seconds', ts) AS w, {_LATE} AS late FROM raw_events_v)
SELECT e.host_id, p.symbol, w AS window_start, e.pid, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen
FROM rows e JOIN probes p ON p.probe_id = e.probe_id JOIN first ON NOT late OR w + INTERVAL '30 seconds' > first.closed
JOIN last ON w + INTERVAL '30 seconds' <= last.closed GROUP BY ALL""")
def runtime_windows_stream(i: Inputs) -> DataFrame:
    """Windows that the watermark has closed; rows that come after their window has closed are left out."""
    rows = i.view("raw_events_v").withColumn("ts", F.col("ts").cast("timestamp"))
    halves = [rows.where(f"ts < {_HALF} AND NOT ({_LATE})"), rows.where(f"ts >= {_HALF} OR ({_LATE})")]
    path = _played(i, "windows", halves, lambda source, out, state: stream.append_windows(
        stream.windowed_calls(source), out, state, NOW))
    return i.spark.read.parquet(path).select("host_id", "symbol", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                                             "pid", "occurrences", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
                                             F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@check("heartbeats_stream", """
WITH r AS (SELECT 'user-' || pid AS host_id, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE comm END AS hostname,
             CASE WHEN event_id % 5 = 0 THEN 'v' || probe_id END AS agent_version FROM raw_events_v)
SELECT host_id, arg_max(hostname, (ts, hostname)) FILTER (hostname <> '') AS hostname,
       arg_max(agent_version, (ts, agent_version)) FILTER (agent_version IS NOT NULL) AS agent_version, max(ts) AS last_seen_at,
       CASE WHEN epoch_ms(max(ts)) + 86400000 <= (SELECT epoch_ms(max(ts)) FROM r) - 600000 THEN 'silent' ELSE 'alive' END AS status
FROM r GROUP BY host_id""")
def heartbeats_stream(i: Inputs) -> DataFrame:
    """Hosts (one per user), silent a day after their last report."""
    rows = i.view("raw_events_v").selectExpr(
        "concat('user-', pid) AS host_id", "CAST(ts AS timestamp) AS received_at", "CASE WHEN event_id % 3 = 0 THEN '' ELSE comm END AS hostname",
        "CASE WHEN event_id % 5 = 0 THEN concat('v', probe_id) END AS agent_version", "CAST(NULL AS string) AS kernel_info")
    halves = [rows.where(f"received_at < {_HALF}"), rows.where(f"received_at >= {_HALF}")]
    path = _played(i, "hosts", halves, lambda source, out, state: hosts.host_stream(source, out, state, 86_400, "10 minutes", NOW))
    return hosts.current_hosts(i.spark, path).select("host_id", "hostname", "agent_version",
                                                     F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"), "status")


@check("runtime_upsert_stream", f"""WITH {_PROBE_CTE}, e AS (
  SELECT host_id, p.algorithm, p.symbol, p.library, pid, CASE WHEN pid % 3 <> 0 THEN 'proc' END AS process_name, event_id % 4 AS part, ts
  FROM raw_events_v r JOIN probes p ON p.probe_id = r.probe_id)
SELECT host_id, algorithm, symbol, process_name, pid, any_value(library) AS library, count(*) AS occurrences, min(ts) AS first_seen,
  coalesce(max(ts) FILTER (part = 3), max(ts) FILTER (part = 2), max(ts) FILTER (part = 1), max(ts)) AS last_seen
FROM e GROUP BY host_id, algorithm, symbol, process_name, pid""")
def runtime_upsert_stream(i: Inputs) -> DataFrame:
    """Findings kept in levels of two: four batches end in one run of the second level."""
    def part(k: int) -> DataFrame:
        rows = i.view("raw_events_v").where(F.col("event_id") % 4 == k)
        found = runtime.resolve_probes(runtime.aggregate_events(rows))
        return found.withColumns({"process_name": F.when(F.col("pid") % 3 != 0, F.lit("proc")),
                                  "first_seen": F.col("first_seen").cast("timestamp"), "last_seen": F.col("last_seen").cast("timestamp")})

    path = _played(i, "levels", map(part, range(4)), lambda source, out, state: levels.upsert_stream(source, out, state, 2, NOW))
    return levels.current_findings(i.spark, path).select(
        *runtime.KEY, "library", "occurrences", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


_LATER = "CASE branch WHEN 'main' THEN 'develop' ELSE 'main' END"


@check("webhook_stream", f"""WITH d AS ({_DELIVERIES}),
p AS (SELECT *, CASE provider WHEN 'github' THEN CASE WHEN body LIKE '%heads/main%' THEN 'main' ELSE 'develop' END WHEN 'gitlab' THEN 'main' END AS branch,
  CASE provider WHEN 'github' THEN CASE WHEN delivery_id % 2 = 0 THEN 'a' ELSE 'h' END || delivery_id WHEN 'gitlab' THEN 'c' || delivery_id END AS commit_sha FROM d),
r AS (SELECT repo_id, 0 AS part, branch FROM repos_v UNION ALL SELECT repo_id, 1, {_LATER} FROM repos_v)
SELECT p.delivery_id, p.branch, p.commit_sha, CASE WHEN lower(p.event_type) IN ('push', 'push hook', 'pull_request') AND (p.branch IS NULL OR r.branch IS NULL OR p.branch = r.branch) THEN 'scan_queued' ELSE 'ignored' END AS status
FROM p LEFT JOIN r ON r.repo_id = p.repo_id AND r.part = CASE WHEN delivery_id % 4 < 2 THEN 0 ELSE 1 END""")
def webhook_stream(i: Inputs) -> DataFrame:
    """Deliveries of two batches: some come twice in the first and again in the second, when branches have changed."""
    rows = i.sql(_DELIVERIES).withColumn("received_at", F.timestamp_micros(F.col("delivery_id") * 1000))
    first = rows.where("delivery_id % 4 < 2")
    again = first.where("delivery_id % 8 = 0").withColumn("received_at", F.expr("received_at + INTERVAL 1 SECOND"))
    repos = i.view("repos_v").select("repo_id", "branch")
    later = repos.withColumn("branch", F.expr(_LATER))
    parts = [first.unionByName(again), rows.where("delivery_id % 4 >= 2").unionByName(again)]
    path = _played(i, "webhooks", parts, lambda source, out, state: events.queue_scans(
        source, lambda batch_id: later if batch_id else repos, out, state, "1 day", NOW))
    return i.spark.read.parquet(path).select("delivery_id", "branch", "commit_sha", "status")
