"""Checks of the call graph, runtime events, TLS endpoints, webhooks and verdicts."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.checks.base import check, quoted
from keyfathom.checks.views import Inputs
from keyfathom.dims import grades
from keyfathom.functions.text import decode_text
from keyfathom.operators import callgraph, explorer, reports, runtime, tls, verdicts
from keyfathom.session import checkpoint_dir
from keyfathom.sources import tables
from keyfathom.streaming import events as stream_events
from keyfathom.streaming import runtime as stream_runtime


def _functions(i: Inputs) -> DataFrame:
    return i.view("functions_v").withColumn("repo_id", F.lit(0))


@check("enclosing_function", """
SELECT file_path, line_number, arg_min(func_id, (end_line - start_line, func_id)) AS func_id FROM (
  SELECT DISTINCT f.file_path, CAST(f.finding_id % 300 AS INT) AS line_number, g.func_id, g.start_line, g.end_line
  FROM findings_id_v f JOIN functions_v g ON g.file_path = f.file_path AND f.finding_id % 300 BETWEEN g.start_line AND g.end_line)
GROUP BY file_path, line_number""")
def enclosing_function(i: Inputs) -> DataFrame:
    lines = i.view("findings_id_v").select(F.lit(0).alias("repo_id"), "file_path", (F.col("finding_id") % 300).cast("int").alias("line_number"))
    return callgraph.enclosing_functions(lines, _functions(i)).drop("repo_id")


_REACH = """
WITH RECURSIVE bfs AS (
  SELECT func_id, name, 0 AS depth FROM functions_v WHERE is_entry
  UNION
  SELECT g.func_id, g.name, b.depth + 1 FROM bfs b JOIN calls_v c ON c.caller_id = b.func_id JOIN functions_v g ON g.name = c.callee_name
  WHERE b.depth < 40),
best AS (SELECT func_id, min(depth) AS depth FROM bfs GROUP BY func_id)
"""


def _reached(i: Inputs) -> DataFrame:
    calls = i.view("calls_v").select(F.lit(0).alias("repo_id"), F.col("caller_id").alias("caller"), "callee_name")
    return callgraph.reach(_functions(i), calls)


@check("reachability", _REACH + "SELECT func_id, depth FROM best")
def reachability(i: Inputs) -> DataFrame:
    return _reached(i).select("func_id", "depth")


@check("call_chains", _REACH + "SELECT func_id, depth + 1 AS chain_length FROM best")
def call_chains(i: Inputs) -> DataFrame:
    return _reached(i).select("func_id", F.size("chain").alias("chain_length"))


# three repositories with the same names, each without another seventh of the functions
_REPO_FUNCTIONS = """SELECT repo_id, func_id, file_path, name, concat(name, '@', start_line) AS label, start_line, end_line, is_entry OR func_id % 400 = repo_id AS is_entry
FROM functions_v JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(repo_id)) r ON func_id % 7 <> repo_id"""
_REPO_CALLS = "SELECT repo_id, caller_id, callee_name FROM calls_v JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(repo_id)) r ON caller_id % 7 <> repo_id"


@check("repository_chains", f"""
WITH RECURSIVE f AS ({_REPO_FUNCTIONS}), c AS ({_REPO_CALLS}),
walk AS (
  SELECT repo_id, func_id, 0 AS depth, [label] AS chain FROM f WHERE is_entry
  UNION ALL
  SELECT g.repo_id, g.func_id, w.depth + 1, min(list_append(w.chain, g.label)) FROM walk w
  JOIN c ON c.repo_id = w.repo_id AND c.caller_id = w.func_id JOIN f g ON g.repo_id = c.repo_id AND g.name = c.callee_name
  WHERE w.depth < 30 GROUP BY g.repo_id, g.func_id, w.depth),
best AS (SELECT repo_id, func_id, min(depth) AS depth, arg_min(chain, (depth, chain)) AS chain FROM walk GROUP BY repo_id, func_id)
SELECT repo_id, func_id, depth, array_to_string(chain, ' > ') AS chain FROM best""")
def repository_chains(i: Inputs) -> DataFrame:
    """Three repositories with functions of the same names, and what the chains say."""
    calls = i.sql(_REPO_CALLS).withColumnRenamed("caller_id", "caller")
    return callgraph.reach(i.sql(_REPO_FUNCTIONS), calls).select("repo_id", "func_id", "depth", F.array_join("chain", " > ").alias("chain"))


@check("finding_reachability", _REACH + """,
spot AS (SELECT f.finding_id, arg_min(g.func_id, (g.end_line - g.start_line, g.func_id)) AS func_id
  FROM findings_id_v f LEFT JOIN functions_v g ON g.file_path = f.file_path AND f.finding_id % 300 BETWEEN g.start_line AND g.end_line
  WHERE f.source_type = 'source_code' GROUP BY f.finding_id)
SELECT spot.finding_id, spot.func_id IS NULL OR best.depth IS NOT NULL AS reachable,
  CASE WHEN spot.func_id IS NULL THEN 0 ELSE best.depth END AS call_depth
FROM spot LEFT JOIN best ON best.func_id = spot.func_id""")
def finding_reachability(i: Inputs) -> DataFrame:
    found = i.view("findings_id_v").select("finding_id", F.lit(0).alias("repo_id"), "file_path", "source_type",
                                           (F.col("finding_id") % 300).cast("int").alias("line_number"))
    return callgraph.verdicts(found, _functions(i), _reached(i)).select("finding_id", "reachable", "call_depth")


# one source file per part in three languages (~ marks a newline)
_SOURCES = """SELECT p_partkey, p_size, CAST(p_partkey % 10 AS VARCHAR(20)) AS repo_id,
  concat('src/p', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.java' END) AS file_path,
  replace(CASE p_partkey % 3
    WHEN 0 THEN concat('import os~~@app.route("/x")~def handle_', p_size, '(r):~    return helper(r).load()~~def helper(x):~    def inner():~        return hash(x)~    return inner()~~if __name__ == "__main__":~    helper(1)~')
    WHEN 1 THEN concat('package main~~func Start', p_size, '(a int) {~  Load(a)~  util(a)~}~~func (s *Srv) Load(x int) {~  s.Sign(x)~}~func main() {~  http.HandleFunc("/", Serve', p_size, ')~  Start', p_size, '(1)~}~')
    ELSE concat('class A {~  private int n;~  public void run', p_size, '(int a) {~    sign(a);~  }~  @Test~  public void check(String s) {~    run', p_size, '(1);~  }~}~') END, '~', chr(10)) AS content
FROM part"""


@check("source_functions", f"""WITH s AS ({_SOURCES})
SELECT repo_id, file_path, unnest(['handle_' || p_size, 'helper', 'inner', '__main__']) AS name, unnest([4, 7, 8, 12]) AS start_line, unnest([5, 10, 9, 13]) AS end_line,
  unnest([true, false, false, true]) AS is_entry, unnest(['helper,load,route', 'hash,inner', 'hash', 'helper']) AS callees FROM s WHERE p_partkey % 3 = 0
UNION ALL SELECT repo_id, file_path, unnest(['Start' || p_size, 'Load', 'main']), unnest([3, 8, 11]), unnest([7, 10, 14]), unnest([false, false, true]),
  unnest(['Load', 'Sign', 'HandleFunc,Start' || p_size]) FROM s WHERE p_partkey % 3 = 1
UNION ALL SELECT repo_id, file_path, unnest(['run' || p_size, 'check']), unnest([3, 7]), unnest([6, 10]), unnest([false, true]),
  unnest(['sign', 'run' || p_size]) FROM s WHERE p_partkey % 3 = 2""")
def source_functions(i: Inputs) -> DataFrame:
    found = callgraph.extract(i.sql(_SOURCES))
    return found.select("repo_id", "file_path", "name", "start_line", "end_line", "is_entry",
                        F.array_join(F.sort_array("callees"), ",").alias("callees"))


@check("source_reach", f"""WITH s AS ({_SOURCES}), g AS (SELECT * FROM s WHERE p_partkey % 3 = 1), j AS (SELECT * FROM s WHERE p_partkey % 3 = 2)
SELECT repo_id, file_path, unnest(['handle_' || p_size, 'helper', 'inner', '__main__']) AS name, unnest([0, 1, 2, 0]) AS depth FROM s WHERE p_partkey % 3 = 0
UNION ALL SELECT repo_id, file_path, unnest(['Start' || p_size, 'Load', 'main']), unnest([0, 1, 0]) FROM g
UNION ALL SELECT repo_id, file_path, unnest(['run' || p_size, 'check']), unnest([1, 0]) FROM j""")
def source_reach(i: Inputs) -> DataFrame:
    checkpoint_dir(i.spark)
    extracted = callgraph.extract(i.sql(_SOURCES)).checkpoint()
    functions = callgraph.functions_of(extracted)
    reached = callgraph.reach(functions, callgraph.calls_of(extracted))
    return reached.join(functions, ["repo_id", "func_id"]).select("repo_id", "file_path", "name", "depth")


_PROBES = ", ".join(f"({n}, {quoted(lib)}, {quoted(sym)}, {quoted(alg)})" for n, lib, sym, alg in grades.RUNTIME_PROBES)
_PROBE_CTE = f"probes AS (SELECT * FROM (VALUES {_PROBES}) AS t(probe_id, library, symbol, algorithm))"
_AGG = f"""{_PROBE_CTE}, agg AS (
  SELECT e.host_id, p.algorithm, p.symbol, p.library, e.pid, count(*) AS occurrences, min(e.ts) AS first_seen, max(e.ts) AS last_seen,
    arg_min(e.comm, (e.ts, e.comm)) AS process_name
  FROM raw_events_v e JOIN probes p ON p.probe_id = e.probe_id GROUP BY e.host_id, p.probe_id, p.algorithm, p.symbol, p.library, e.pid)"""


def _aggregated(i: Inputs) -> DataFrame:
    return runtime.resolve_probes(runtime.aggregate_events(i.view("raw_events_v")))


@check("runtime_agg", f"WITH {_AGG} SELECT * FROM agg")
def runtime_agg(i: Inputs) -> DataFrame:
    return _aggregated(i)


@check("runtime_summary", f"""WITH {_AGG}, g AS (SELECT agg.*, a.risk_level, a.quantum_status FROM agg LEFT JOIN algo_v a ON a.algorithm = agg.algorithm)
SELECT 'by_algorithm' AS metric, algorithm AS key, count(*) AS n FROM g GROUP BY algorithm
UNION ALL SELECT 'by_risk_level', risk_level, count(*) FROM g GROUP BY risk_level
UNION ALL SELECT 'by_quantum_status', quantum_status, count(*) FROM g GROUP BY quantum_status
UNION ALL SELECT 'total_findings', NULL, count(*) FROM g UNION ALL SELECT 'total_hosts', NULL, count(DISTINCT host_id) FROM g""")
def runtime_summary(i: Inputs) -> DataFrame:
    return reports.runtime_summary(runtime.with_registry(_aggregated(i)))


@check("runtime_windows", f"""WITH {_PROBE_CTE}
SELECT time_bucket(INTERVAL '30 seconds', e.ts) AS window_start, e.host_id, e.pid, p.symbol, p.algorithm, count(*) AS occurrences,
  min(e.ts) AS first_seen, max(e.ts) AS last_seen
FROM raw_events_v e JOIN probes p ON p.probe_id = e.probe_id GROUP BY ALL""")
def runtime_windows(i: Inputs) -> DataFrame:
    return stream_runtime.windowed_calls(i.view("raw_events_v")).select(
        "window_start", "host_id", "pid", "symbol", "algorithm", "occurrences", "first_seen", "last_seen")


def _reported(i: Inputs, earlier: bool) -> DataFrame:
    rows = i.view("raw_events_v").where((F.col("event_id") % 2 == 0) if earlier else (F.col("event_id") % 2 != 0))
    found = runtime.resolve_probes(runtime.aggregate_events(rows))
    return found.withColumn("process_name", F.when(F.col("pid") % 3 != 0, F.lit("proc")))


@check("runtime_upsert", f"""WITH {_PROBE_CTE}, e AS (
  SELECT host_id, p.algorithm, p.symbol, p.library, pid, CASE WHEN pid % 3 <> 0 THEN 'proc' END AS process_name, event_id % 2 AS half, ts
  FROM raw_events_v r JOIN probes p ON p.probe_id = r.probe_id)
SELECT host_id, algorithm, symbol, process_name, pid, any_value(library) AS library, count(*) AS occurrences, min(ts) AS first_seen,
  coalesce(max(ts) FILTER (half = 1), max(ts)) AS last_seen FROM e GROUP BY host_id, algorithm, symbol, process_name, pid""")
def runtime_upsert(i: Inputs) -> DataFrame:
    return runtime.upsert(_reported(i, True), _reported(i, False))


@check("runtime_merge", f"""WITH {_PROBE_CTE}
SELECT host_id, algorithm, symbol, library, pid, CASE WHEN pid % 3 <> 0 THEN 'proc' END AS process_name, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen
FROM raw_events_v r JOIN probes p ON p.probe_id = r.probe_id GROUP BY ALL""")
def runtime_merge(i: Inputs) -> DataFrame:
    return runtime.merge(_reported(i, True).unionByName(_reported(i, False)))


@check("heartbeats", """
SELECT host_id, arg_max(comm, (ts, event_id)) AS hostname, max(ts) AS last_seen_at FROM raw_events_v GROUP BY host_id""")
def heartbeats(i: Inputs) -> DataFrame:
    newest = i.view("raw_events_v").select("host_id", F.struct("ts", "event_id").alias("received_at"), F.col("comm").alias("hostname"),
                                           F.lit(None).cast("string").alias("agent_version"), F.lit("").alias("kernel_info"))
    return runtime.heartbeats(newest).select("host_id", "hostname", F.col("last_seen_at.ts").alias("last_seen_at"))


@check("static_runtime", f"""WITH {_AGG},
h AS (SELECT DISTINCT host_id, CAST(right(host_id, 1) AS BIGINT) + 1 AS repo_id FROM agg),
s AS (SELECT DISTINCT repo_id, algorithm FROM findings_v WHERE NOT archived),
r AS (SELECT DISTINCT h.repo_id, agg.algorithm FROM agg JOIN h ON h.host_id = agg.host_id)
SELECT coalesce(s.repo_id, r.repo_id) AS repo_id, coalesce(s.algorithm, r.algorithm) AS algorithm, s.repo_id IS NOT NULL AS seen_static, r.repo_id IS NOT NULL AS seen_runtime
FROM s FULL JOIN r ON r.repo_id = s.repo_id AND r.algorithm = s.algorithm""")
def static_runtime(i: Inputs) -> DataFrame:
    live = _aggregated(i)
    hosts = live.select("host_id").distinct().withColumn("repo_id", F.substring("host_id", 6, 9).cast("bigint") + 1)
    return runtime.correlate(i.view("findings_v"), live, hosts)


_AS_OF = "1998-06-01 00:00:00"
_KEY = """CASE key_type WHEN 'RSA' THEN CASE WHEN key_size <= 1024 THEN ['BROKEN', 'CRITICAL'] WHEN key_size = 4096 THEN ['VULNERABLE', 'MEDIUM'] ELSE ['VULNERABLE', 'HIGH'] END
  WHEN 'EC' THEN CASE key_curve WHEN 'secp384r1' THEN ['VULNERABLE', 'MEDIUM'] ELSE ['VULNERABLE', 'HIGH'] END WHEN 'DSA' THEN ['BROKEN', 'CRITICAL'] ELSE ['VULNERABLE', 'HIGH'] END"""
_TLS = """CASE tls_version WHEN 'SSLv3' THEN ['BROKEN', 'CRITICAL'] WHEN 'TLSv1.2' THEN ['WEAK', 'MEDIUM'] WHEN 'TLSv1.3' THEN ['MONITOR', 'LOW'] ELSE ['BROKEN', 'HIGH'] END"""
_GRADED = f"""g AS (SELECT *, ({_KEY})[1] AS kq, ({_KEY})[2] AS kr, ({_TLS})[1] AS tq, ({_TLS})[2] AS tr, scan_status = 'complete' AS done FROM tls_v),
w AS (SELECT *, CASE WHEN done THEN CASE WHEN kq = 'BROKEN' OR tq <> 'BROKEN' THEN kq ELSE tq END END AS quantum_status,
  CASE WHEN done THEN CASE WHEN kq = 'BROKEN' OR tq <> 'BROKEN' THEN kr ELSE tr END END AS risk_level FROM g)"""


def _graded(i: Inputs) -> DataFrame:
    rows = i.view("tls_v").withColumn("cert_not_after", F.col("cert_not_after").cast("timestamp"))
    return tls.grade(rows, F.lit(_AS_OF).cast("timestamp"))


@check("tls_grade", f"""WITH {_GRADED}
SELECT finding_id, CASE WHEN done THEN CASE key_type WHEN 'RSA' THEN 'RSA-' || key_size WHEN 'EC' THEN 'EC-' || key_curve WHEN 'DSA' THEN 'DSA-' || key_size ELSE key_type END END AS algorithm,
  quantum_status, risk_level, CASE WHEN NOT done THEN NULL WHEN key_type IN ('Ed25519', 'DSA') THEN 'ML-DSA-44' ELSE 'ML-KEM-768' END AS nist_replacement FROM w""")
def tls_grade(i: Inputs) -> DataFrame:
    return _graded(i).select("finding_id", "algorithm", "quantum_status", "risk_level", "nist_replacement")


@check("tls_issues", f"""WITH {_GRADED}, d AS (SELECT *, floor((epoch(cert_not_after) - epoch(TIMESTAMP '{_AS_OF}')) / 86400) AS days FROM w)
SELECT finding_id, CASE WHEN NOT done THEN '' ELSE concat_ws('; ',
  CASE key_type WHEN 'RSA' THEN 'RSA-' || key_size || ' is quantum-vulnerable (Shor''s algorithm)' WHEN 'EC' THEN 'Elliptic curve ' || key_curve || ' is quantum-vulnerable (Shor''s algorithm)'
    WHEN 'DSA' THEN 'DSA is broken and quantum-vulnerable' ELSE key_type || ' is quantum-vulnerable' END,
  CASE WHEN tls_version IN ('SSLv3', 'TLSv1', 'TLSv1.1') THEN 'Deprecated TLS version: ' || tls_version END,
  CASE WHEN cert_not_after < TIMESTAMP '{_AS_OF}' THEN 'Certificate is expired' WHEN days < 30 THEN 'Certificate expires in ' || CAST(days AS BIGINT) || ' days' END) END AS issues FROM d""")
def tls_issues(i: Inputs) -> DataFrame:
    return _graded(i).select("finding_id", F.array_join("issues", "; ").alias("issues"))


@check("network_summary", f"""WITH {_GRADED}
SELECT 'scan_status' AS metric, scan_status AS key, count(*) AS n FROM w GROUP BY ALL
UNION ALL SELECT 'by_quantum_status', quantum_status, count(*) FROM w WHERE done GROUP BY ALL
UNION ALL SELECT 'by_tls_version', tls_version, count(*) FROM w WHERE done GROUP BY ALL
UNION ALL SELECT 'by_risk_level', risk_level, count(*) FROM w WHERE done GROUP BY ALL""")
def network_summary(i: Inputs) -> DataFrame:
    return reports.network_summary(_graded(i))


_DELIVERIES = """SELECT o_orderkey AS delivery_id, o_custkey % 10 + 1 AS repo_id, CASE o_orderkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'unknown' END AS provider,
  CASE o_custkey % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'Push Hook' WHEN 2 THEN 'issues' ELSE 'pull_request' END AS event_type,
  CASE o_orderkey % 3 WHEN 0 THEN concat('{"ref":"refs/heads/', CASE o_custkey % 2 WHEN 0 THEN 'main' ELSE 'develop' END, '",', CASE WHEN o_orderkey % 2 = 0 THEN '"after":"a' ELSE '"head_commit":{"id":"h' END, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '"}' ELSE '"}}' END)
    WHEN 1 THEN concat('{"ref":"refs/heads/main","commits":[{"id":"c', o_orderkey, '"},{"id":"z"}]}') ELSE '{}' END AS body FROM orders"""


@check("webhook_requests", f"""WITH d AS ({_DELIVERIES}),
p AS (SELECT *, CASE provider WHEN 'github' THEN CASE WHEN body LIKE '%heads/main%' THEN 'main' ELSE 'develop' END WHEN 'gitlab' THEN 'main' END AS branch,
  CASE provider WHEN 'github' THEN CASE WHEN delivery_id % 2 = 0 THEN 'a' ELSE 'h' END || delivery_id WHEN 'gitlab' THEN 'c' || delivery_id END AS commit_sha FROM d)
SELECT p.delivery_id, p.branch, p.commit_sha, CASE WHEN lower(p.event_type) IN ('push', 'push hook', 'pull_request') AND (p.branch IS NULL OR r.branch IS NULL OR p.branch = r.branch) THEN 'scan_queued' ELSE 'ignored' END AS status
FROM p LEFT JOIN repos_v r ON r.repo_id = p.repo_id""")
def webhook_requests(i: Inputs) -> DataFrame:
    return stream_events.scan_requests(i.sql(_DELIVERIES), i.view("repos_v")).select("delivery_id", "branch", "commit_sha", "status")


_CHANGES = """SELECT o_custkey AS scan_run_id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' ELSE 'failed' END AS status, o_orderkey AS changed_at FROM orders"""


@check("run_states", f"""WITH c AS ({_CHANGES})
SELECT scan_run_id, arg_max(status, changed_at) AS status, min(changed_at) AS started_at, max(changed_at) AS changed_at FROM c GROUP BY scan_run_id""")
def run_states(i: Inputs) -> DataFrame:
    return stream_events.run_states(i.sql(_CHANGES))


_RESPONSES = """SELECT doc_id, concat(CASE doc_id % 4
  WHEN 0 THEN concat('```json', chr(10), '{"is_crypto_usage": false, "confidence": 1.7, "label": "false_positive", "explanation": "e', doc_id, '"}', chr(10), '``` ')
  WHEN 1 THEN concat('Answer: {"confidence": 0.', doc_id % 9, '5} thanks ') WHEN 2 THEN 'This is a variable name. ' ELSE 'Looks real {broken ' END,
  CASE WHEN doc_id % 4 > 1 THEN replace(replace(text, '{', '('), '}', ')') ELSE '' END) AS response FROM documents"""
_WORDS = " OR ".join(f"contains(lower(response), {quoted(w)})" for w in grades.FALSE_POSITIVE_WORDS)


@check("verdicts", f"""WITH r AS ({_RESPONSES})
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE NOT ({_WORDS}) END AS is_crypto_usage,
  CAST(CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN (doc_id % 9) / 10.0 + 0.05 ELSE 0.4 END AS DOUBLE) AS confidence,
  CASE doc_id % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'uncertain' ELSE CASE WHEN {_WORDS} THEN 'false_positive' ELSE 'uncertain' END END AS label
FROM r""")
def verdict_rows(i: Inputs) -> DataFrame:
    rows = verdicts.normalise(i.spread(_RESPONSES))
    return rows.select("doc_id", "is_crypto_usage", F.round("confidence", 6).alias("confidence"), "label")


@check("network_page", f"""WITH {_GRADED}
SELECT finding_id, risk_level FROM w WHERE quantum_status = 'BROKEN' AND scan_status = 'complete' ORDER BY cert_not_after DESC, finding_id LIMIT 100""")
def network_page(i: Inputs) -> DataFrame:
    rows = _graded(i).withColumn("archived", F.lit(False))
    chosen = explorer.equal_to(rows, quantum_status="BROKEN", scan_status="complete")
    return explorer.newest(chosen, "cert_not_after", "finding_id", limit=100).select("finding_id", "risk_level")


@check("runtime_page", f"""WITH {_AGG}
SELECT host_id, symbol, pid, occurrences FROM agg WHERE host_id = 'host-3' AND algorithm = 'ECDSA' ORDER BY last_seen DESC, pid LIMIT 100""")
def runtime_page(i: Inputs) -> DataFrame:
    rows = _aggregated(i).withColumn("archived", F.lit(False))
    chosen = explorer.equal_to(rows, host_id="host-3", algorithm="ECDSA")
    return explorer.newest(chosen, "last_seen", "pid", limit=100).select("host_id", "symbol", "pid", "occurrences")


@check("symbol_probes", f"""WITH {_PROBE_CTE}
SELECT p.library, p.algorithm, count(*) AS events FROM raw_events_v e JOIN probes p ON p.probe_id = e.probe_id GROUP BY ALL""")
def symbol_probes(i: Inputs) -> DataFrame:
    rows = runtime.resolve_probes(i.view("raw_events_v"))
    return rows.groupBy("library", "algorithm").agg(F.count("*").alias("events"))


_REPORTS = """SELECT event_id, ts, host_id, concat('[{"algorithm":"MD5","symbol":"s', probe_id, '","pid":', pid, ',"occurrences":', event_id % 9, '},',
  '{"algorithm":"RC4","symbol":"t","pid":', pid, ',"occurrences":1}]') AS body FROM raw_events_v"""


@check("reported_findings", """
SELECT host_id, 'MD5' AS algorithm, 's' || probe_id AS symbol, pid, event_id % 9 AS occurrences, ts AS first_seen FROM raw_events_v
UNION ALL SELECT host_id, 'RC4', 't', pid, 1, ts FROM raw_events_v""")
def reported_findings(i: Inputs) -> DataFrame:
    shape = ("array<struct<algorithm:string,symbol:string,library:string,process_name:string,pid:long,occurrences:long,"
             "first_seen:timestamp_ntz,last_seen:timestamp_ntz>>")
    reports_ = i.sql(_REPORTS).select("host_id", F.col("ts").alias("received_at"), F.from_json("body", shape).alias("findings"))
    return tables.reported_findings(reports_).select("host_id", "algorithm", "symbol", "pid", "occurrences", "first_seen")


@check("decoded_text", """
SELECT doc_id, md5(replace(content, chr(13), chr(10))) AS digest FROM files_v""")
def decoded_text(i: Inputs) -> DataFrame:
    raw = F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FFFE")))  # bytes that are no text are dropped
    return i.files().select("doc_id", F.md5(decode_text(raw)).alias("digest"))
