"""Checks of reports, lifecycle, gates and exports over the findings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.checks.base import check, quoted
from keyfathom.checks.views import Inputs
from keyfathom.dims import grades
from keyfathom.dims.registry import REGISTRY
from keyfathom.operators import bom, explorer, gate, lifecycle, playbooks, reports
from keyfathom.session import checkpoint_dir
from keyfathom.sinks import exports

_RANK = "CASE {0} WHEN 'BROKEN' THEN 0 WHEN 'VULNERABLE' THEN 1 WHEN 'WEAK' THEN 2 WHEN 'MONITOR' THEN 3 WHEN 'SAFE' THEN 4 ELSE 99 END"
_RISK = "CASE {0} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END"
_AS_OF = "1998-12-01 00:00:00"


def _rank(column: str) -> str:
    return _RANK.format(column)


def _risk(column: str) -> str:
    return _RISK.format(column)


@check("findings_summary", """
SELECT 'by_risk' AS metric, risk_level AS key, count(*) AS n FROM findings_v WHERE NOT archived GROUP BY ALL
UNION ALL SELECT 'by_quantum_status', quantum_status, count(*) FROM findings_v WHERE NOT archived GROUP BY ALL
UNION ALL SELECT 'by_status', migration_status, count(*) FROM findings_v WHERE NOT archived GROUP BY ALL
UNION ALL SELECT 'by_source', source_type, count(*) FROM findings_v WHERE NOT archived GROUP BY ALL
UNION ALL SELECT 'total', CASE WHEN archived THEN 'archived' ELSE 'active' END, count(*) FROM findings_v GROUP BY ALL""")
def findings_summary(i: Inputs) -> DataFrame:
    return reports.findings_summary(i.view("findings_v"))


@check("top_algorithms", """
SELECT algorithm, count(*) AS n FROM findings_v WHERE NOT archived GROUP BY algorithm ORDER BY n DESC, algorithm LIMIT 10""")
def top_algorithms(i: Inputs) -> DataFrame:
    return reports.top_algorithms(i.view("findings_v"))


_LATEST = """latest AS (SELECT scan_run_id, repo_id, scan_type, started_at FROM scan_runs_v WHERE status = 'complete'
  QUALIFY rank() OVER (PARTITION BY repo_id ORDER BY started_at DESC) = 1)"""


@check("latest_runs", f"WITH {_LATEST} SELECT * FROM latest")
def latest_runs(i: Inputs) -> DataFrame:
    return bom.latest_runs(i.view("scan_runs_v")).select("scan_run_id", "repo_id", "scan_type", "started_at")


@check("latest_runs_per_type", """
SELECT scan_run_id, repo_id, scan_type, started_at FROM scan_runs_v WHERE status = 'complete'
QUALIFY rank() OVER (PARTITION BY repo_id, scan_type ORDER BY started_at DESC) = 1""")
def latest_runs_per_type(i: Inputs) -> DataFrame:
    return bom.latest_runs(i.view("scan_runs_v"), per_scan_type=True).select(
        "scan_run_id", "repo_id", "scan_type", "started_at")


@check("latest_findings", f"""WITH {_LATEST}
SELECT repo_id, algorithm, count(*) AS n FROM findings_v WHERE scan_run_id IN (SELECT scan_run_id FROM latest) GROUP BY ALL""")
def latest_findings(i: Inputs) -> DataFrame:
    rows = bom.in_latest_runs(i.view("findings_v"), i.view("scan_runs_v"))
    return rows.groupBy("repo_id", "algorithm").agg(F.count("*").alias("n"))


@check("other_artifact_findings", f"""WITH {_LATEST}
SELECT repo_id, algorithm, count(*) AS n FROM findings_v
WHERE source_type = 'artifact' AND scan_run_id NOT IN (SELECT scan_run_id FROM latest) GROUP BY ALL""")
def other_artifact_findings(i: Inputs) -> DataFrame:
    rows = bom.outside_latest_runs(i.view("findings_v"), i.view("scan_runs_v"))
    return rows.groupBy("repo_id", "algorithm").agg(F.count("*").alias("n"))


_SECRETS = """SELECT o_custkey % 10 AS repo_id, o_orderkey AS scan_run_id, concat('keys/k', o_custkey % 50, '.pem') AS file_path,
  CASE o_orderkey % 5 WHEN 0 THEN 'RSA-2048' WHEN 1 THEN 'ECDSA-secp256r1' WHEN 2 THEN 'DSA-1024' WHEN 3 THEN 'Ed25519' ELSE 'ECDSA-secp384r1' END AS algorithm,
  CASE o_orderkey % 3 WHEN 0 THEN 'SSH_PRIVATE_KEY' WHEN 1 THEN 'TLS_CERT' ELSE 'GPG_KEY' END AS finding_type,
  CASE o_orderkey % 5 WHEN 2 THEN 'BROKEN' ELSE 'VULNERABLE' END AS quantum_status,
  CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  'ML-DSA-65' AS nist_replacement, CASE WHEN o_orderkey % 7 = 0 THEN 'false_positive' ELSE 'open' END AS migration_status,
  o_orderkey % 11 = 0 AS archived FROM orders"""
_ALGO = "CASE WHEN algorithm LIKE 'ECDSA-%' THEN 'ECDSA' WHEN algorithm LIKE 'DSA-%' THEN 'DSA' ELSE algorithm END"


@check("cbom_rebuild", f"""WITH {_LATEST}, secrets AS ({_SECRETS}),
rows AS (
  SELECT algorithm, repo_id, quantum_status, algo_type, source_type = 'artifact' AS art, false AS sec,
    lat AND reachable IS NOT NULL AND NOT reachable AS unreach, CASE WHEN lat THEN call_depth END AS depth
  FROM (SELECT *, scan_run_id IN (SELECT scan_run_id FROM latest) AS lat FROM findings_v
        WHERE NOT archived AND migration_status IN ('open', 're_opened')) WHERE lat OR source_type = 'artifact'
  UNION ALL
  SELECT {_ALGO}, repo_id, quantum_status, CASE finding_type WHEN 'TLS_CERT' THEN 'Certificate' ELSE 'Asymmetric' END, false, true, false, NULL
  FROM secrets WHERE NOT archived AND migration_status IN ('open', 're_opened') AND scan_run_id IN (SELECT scan_run_id FROM latest)),
grp AS (SELECT algorithm, count(*) AS total_usages, count(*) FILTER (NOT art AND NOT sec) AS code_usages,
  count(*) FILTER (sec) AS secret_usages, count(*) FILTER (art) AS artifact_usages, count(*) FILTER (unreach) AS unreachable_count,
  min(depth) AS min_call_depth, count(DISTINCT repo_id) AS affected_repos, min({_rank('quantum_status')}) AS wr FROM rows GROUP BY algorithm)
SELECT g.algorithm, coalesce(a.quantum_status, CASE wr WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'VULNERABLE' WHEN 2 THEN 'WEAK' WHEN 3 THEN 'MONITOR' ELSE 'SAFE' END) AS quantum_status,
  1 + {_rank("coalesce(a.quantum_status, CASE wr WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'VULNERABLE' WHEN 2 THEN 'WEAK' WHEN 3 THEN 'MONITOR' ELSE 'SAFE' END)")} AS priority,
  total_usages, code_usages, secret_usages, artifact_usages, unreachable_count, min_call_depth, affected_repos
FROM grp g LEFT JOIN algo_v a ON a.algorithm = g.algorithm""")
def cbom_rebuild(i: Inputs) -> DataFrame:
    return bom.rebuild(i.view("findings_v"), i.view("scan_runs_v"), i.sql(_SECRETS)).select(
        "algorithm", "quantum_status", "priority", "total_usages", "code_usages", "secret_usages",
        "artifact_usages", "unreachable_count", "min_call_depth", "affected_repos")


@check("project_algorithms", f"""WITH secrets AS ({_SECRETS})
SELECT DISTINCT r.project_id, f.algorithm FROM (
  SELECT repo_id, algorithm FROM findings_v WHERE NOT archived AND migration_status <> 'false_positive'
  UNION SELECT repo_id, algorithm FROM secrets WHERE NOT archived AND migration_status <> 'false_positive') f
JOIN repos_v r ON r.repo_id = f.repo_id""")
def project_algorithms(i: Inputs) -> DataFrame:
    return bom.project_algorithms(i.view("findings_v"), i.sql(_SECRETS), i.view("repos_v"))


_ARTIFACTS = """SELECT o_orderkey AS artifact_id, o_custkey % 10 AS repo_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'complete' END AS scan_status FROM orders WHERE o_orderstatus = 'F'"""


@check("dashboard", f"""WITH artifacts AS ({_ARTIFACTS}), {_LATEST},
f AS (SELECT count(*) AS total_findings, count(*) FILTER (quantum_status = 'VULNERABLE') AS vulnerable,
  count(*) FILTER (quantum_status = 'BROKEN') AS broken, count(*) FILTER (quantum_status IN ('SAFE', 'MONITOR')) AS safe,
  count(*) FILTER (source_type = 'artifact') AS artifact_findings, count(*) FILTER (source_type = 'source_code') AS src,
  count(*) FILTER (source_type = 'source_code' AND reachable IS NOT NULL) AS call_graph_analyzed,
  count(*) FILTER (source_type = 'source_code' AND NOT reachable) AS unreachable_findings FROM findings_v WHERE NOT archived),
r AS (SELECT count(*) AS total_repos, count(*) FILTER (risk_level = 'CRITICAL') AS critical_repos FROM repos_v),
c AS (SELECT count(DISTINCT algorithm) AS cbom_entries FROM findings_v WHERE NOT archived AND migration_status IN ('open', 're_opened')
  AND (source_type = 'artifact' OR scan_run_id IN (SELECT scan_run_id FROM latest))),
a AS (SELECT count(DISTINCT repo_id) AS artifact_repos, count(*) AS total_artifacts FROM artifacts WHERE scan_status = 'complete'),
s AS (SELECT max(started_at) AS last_scan_at FROM scan_runs_v)
SELECT total_repos, critical_repos, total_findings, vulnerable, broken, safe, cbom_entries, last_scan_at, artifact_repos, total_artifacts,
  artifact_findings, CAST(round_even(artifact_repos / total_repos * 100, 0) AS BIGINT) AS artifact_coverage_pct, call_graph_analyzed,
  CAST(round_even(call_graph_analyzed / src * 100, 0) AS BIGINT) AS call_graph_coverage_pct, unreachable_findings
FROM f, r, c, a, s""")
def dashboard(i: Inputs) -> DataFrame:
    findings, runs = i.view("findings_v"), i.view("scan_runs_v")
    return reports.dashboard(findings, i.view("repos_v"), runs, bom.rebuild(findings, runs), i.sql(_ARTIFACTS))


@check("coverage_matrix", f"""
SELECT r.repo_id, r.name, f.algorithm, arg_min(f.quantum_status, {_rank('f.quantum_status')}) AS worst_status, count(*) AS n
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id
WHERE NOT f.archived AND f.migration_status <> 'false_positive' GROUP BY r.repo_id, r.name, f.algorithm""")
def coverage_matrix(i: Inputs) -> DataFrame:
    return reports.coverage_matrix(i.view("findings_v"), i.view("repos_v"))


@check("algorithm_order", f"""
SELECT algorithm, min({_rank('quantum_status')}) AS rank FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id
WHERE NOT archived AND migration_status <> 'false_positive' GROUP BY algorithm ORDER BY rank, algorithm""")
def algorithm_order(i: Inputs) -> DataFrame:
    return reports.algorithm_order(reports.coverage_matrix(i.view("findings_v"), i.view("repos_v")))


@check("coverage_grid", f"""
SELECT r.repo_id, r.name, min(quantum_status) FILTER (algorithm = 'MD5') AS MD5, min(quantum_status) FILTER (algorithm = 'RC4') AS RC4,
  min(quantum_status) FILTER (algorithm = 'ECDSA') AS ECDSA
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id WHERE NOT archived AND migration_status <> 'false_positive' GROUP BY ALL""")
def coverage_grid(i: Inputs) -> DataFrame:
    matrix = reports.coverage_matrix(i.view("findings_v"), i.view("repos_v"))
    return reports.coverage_grid(matrix, ["MD5", "RC4", "ECDSA"])


@check("blast_radius", f"""
SELECT r.repo_id, r.name, r.risk_level, count(*) AS finding_count, array_to_string(list_sort(list(DISTINCT f.source_type)), ',') AS source_types,
  arg_min(f.quantum_status, {_rank('f.quantum_status')}) AS worst_status
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id
WHERE f.algorithm = 'RSA-2048' AND NOT f.archived AND f.migration_status <> 'false_positive'
GROUP BY r.repo_id, r.name, r.risk_level ORDER BY finding_count DESC, r.repo_id""")
def blast_radius(i: Inputs) -> DataFrame:
    rows = reports.blast_radius(i.view("findings_v"), i.view("repos_v"), "RSA-2048")
    return rows.withColumn("source_types", F.array_join("source_types", ","))


@check("blast_totals", f"""WITH {_LATEST}
SELECT 'RSA-2048' AS algorithm, count(DISTINCT r.repo_id) AS total_repos, count(*) AS total_findings, 'VULNERABLE' AS quantum_status, 'Asymmetric' AS algo_type
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id
WHERE f.algorithm = 'RSA-2048' AND NOT f.archived AND f.migration_status <> 'false_positive'""")
def blast_totals(i: Inputs) -> DataFrame:
    findings = i.view("findings_v")
    radius = reports.blast_radius(findings, i.view("repos_v"), "RSA-2048")
    return reports.blast_totals(radius, bom.rebuild(findings, i.view("scan_runs_v")), "RSA-2048").select(
        "algorithm", "total_repos", "total_findings", "quantum_status", "algo_type")


@check("migration_stats", f"""
SELECT algorithm, any_value(risk_level) AS risk_level, any_value(quantum_status) AS quantum_status,
  count(*) FILTER (migration_status = 'open') AS open, count(*) FILTER (migration_status = 'auto_resolved') AS auto_resolved,
  count(*) FILTER (migration_status = 'manually_resolved') AS manually_resolved, count(*) FILTER (migration_status = 're_opened') AS re_opened,
  count(*) FILTER (migration_status = 'false_positive') AS false_positive, count(*) AS total,
  count(*) FILTER (migration_status IN ('auto_resolved', 'manually_resolved')) AS resolved,
  CAST(round_even(count(*) FILTER (migration_status IN ('auto_resolved', 'manually_resolved')) / count(*) * 100, 0) AS BIGINT) AS progress_pct
FROM findings_v WHERE NOT archived GROUP BY algorithm""")
def migration_stats(i: Inputs) -> DataFrame:
    return reports.migration_stats(i.view("findings_v"))


@check("migration_targets", """
SELECT algorithm, migrated_to, count(*) AS n FROM findings_v WHERE NOT archived AND migrated_to IS NOT NULL GROUP BY ALL""")
def migration_targets(i: Inputs) -> DataFrame:
    return reports.migration_targets(i.view("findings_v"))


@check("hybrid_repos", "SELECT repo_id, name, agility_level FROM repos_v WHERE has_hybrid")
def hybrid_repos(i: Inputs) -> DataFrame:
    return reports.hybrid_repos(i.view("repos_v")).select("repo_id", "name", "agility_level")


@check("cve_stats", """
WITH j AS (SELECT c.cve_id FROM cves_v c JOIN findings_id_v f ON f.finding_id = c.finding_id WHERE NOT f.archived),
d AS (SELECT f.finding_id, f.finding_id IN (SELECT finding_id FROM cves_v) AS has FROM findings_id_v f WHERE source_type = 'dependency' AND NOT archived)
SELECT (SELECT count(*) FROM j) AS total_cve_records, (SELECT count(DISTINCT cve_id) FROM j) AS distinct_cves,
  count(*) AS dependency_findings_total, count(*) FILTER (has) AS dependency_findings_with_cve,
  CAST(round_even(count(*) FILTER (has) / count(*) * 100, 0) AS BIGINT) AS coverage_pct FROM d""")
def cve_stats(i: Inputs) -> DataFrame:
    return reports.cve_stats(i.view("findings_id_v"), i.view("cves_v"))


@check("top_cves", """
SELECT c.cve_id, c.cvss_severity, count(DISTINCT f.repo_id) AS affected_repos FROM cves_v c JOIN findings_id_v f ON f.finding_id = c.finding_id
WHERE NOT f.archived GROUP BY c.cve_id, c.cvss_severity ORDER BY affected_repos DESC, c.cve_id, c.cvss_severity LIMIT 5""")
def top_cves(i: Inputs) -> DataFrame:
    return reports.top_cves(i.view("findings_id_v"), i.view("cves_v"))


@check("cve_exposed", """
SELECT finding_id, algorithm FROM findings_id_v WHERE source_type = 'dependency' AND NOT archived AND finding_id IN (SELECT finding_id FROM cves_v)""")
def cve_exposed(i: Inputs) -> DataFrame:
    return reports.cve_exposed(i.view("findings_id_v"), i.view("cves_v")).select("finding_id", "algorithm")


@check("cve_missing", """
SELECT finding_id, algorithm FROM findings_id_v WHERE source_type = 'dependency' AND NOT archived AND finding_id NOT IN (SELECT finding_id FROM cves_v)""")
def cve_missing(i: Inputs) -> DataFrame:
    return reports.cve_missing(i.view("findings_id_v"), i.view("cves_v")).select("finding_id", "algorithm")


@check("cves_of_findings", """
SELECT f.finding_id, c.cve_id, c.cvss_severity FROM findings_id_v f LEFT JOIN cves_v c ON c.finding_id = f.finding_id""")
def cves_of_findings(i: Inputs) -> DataFrame:
    return reports.cves_of_findings(i.view("findings_id_v"), i.view("cves_v")).select("finding_id", "cve_id", "cvss_severity")


_GATE = f"""
WITH o AS (SELECT * FROM findings_v WHERE NOT archived AND migration_status IN ('open', 're_opened')),
cfg AS (SELECT repo_id, name, repo_id % 2 = 0 AS fail_on_broken, true AS fail_on_vulnerable, repo_id % 5 = 0 AS fail_on_weak, repo_id % 3 = 0 AS fail_on_critical, true AS fail_on_high,
  CASE WHEN agility_level IS NOT NULL THEN 1 END AS last_scanned_at FROM repos_v),
c AS (SELECT cfg.repo_id, count(*) FILTER (quantum_status = 'BROKEN') AS broken, count(*) FILTER (quantum_status = 'VULNERABLE') AS vulnerable,
  count(*) FILTER (quantum_status = 'WEAK') AS weak, count(*) FILTER (risk_level = 'CRITICAL' AND fail_on_critical) AS critical,
  count(*) FILTER (risk_level = 'HIGH' AND fail_on_high) AS high, count(o.repo_id) AS total,
  count(*) FILTER ((quantum_status = 'BROKEN' AND fail_on_broken) OR (quantum_status = 'VULNERABLE' AND fail_on_vulnerable) OR (quantum_status = 'WEAK' AND fail_on_weak)) AS failing
  FROM cfg LEFT JOIN o ON o.repo_id = cfg.repo_id GROUP BY cfg.repo_id),
m AS (SELECT o.repo_id, quantum_status || ' finding: ' || algorithm || ' in ' || file_path || ':' || line_number AS msg,
  row_number() OVER (PARTITION BY o.repo_id ORDER BY {_rank('quantum_status')}, algorithm, file_path, line_number) AS rn
  FROM o JOIN cfg ON cfg.repo_id = o.repo_id
  WHERE (quantum_status = 'BROKEN' AND fail_on_broken) OR (quantum_status = 'VULNERABLE' AND fail_on_vulnerable) OR (quantum_status = 'WEAK' AND fail_on_weak)),
g AS (SELECT c.*, cfg.last_scanned_at, failing = 0 AS passed, CAST(failing AS BIGINT) AS failure_count,
  (SELECT string_agg(msg, ';' ORDER BY rn) FROM m WHERE m.repo_id = c.repo_id AND rn <= 20) AS failures
  FROM c JOIN cfg ON cfg.repo_id = c.repo_id)
"""
_CONFIGS = """SELECT repo_id, repo_id % 2 = 0 AS fail_on_broken, true AS fail_on_vulnerable, repo_id % 5 = 0 AS fail_on_weak,
  repo_id % 3 = 0 AS fail_on_critical, true AS fail_on_high FROM repos_v"""


def _gates(i: Inputs) -> DataFrame:
    repos = i.view("repos_v").withColumn("last_scanned_at", F.when(F.col("agility_level").isNotNull(), 1))
    return gate.evaluate(i.view("findings_v"), repos, i.sql(_CONFIGS))


@check("gate_eval", _GATE + """SELECT repo_id, broken, vulnerable, weak, critical, high, total, passed, failure_count, coalesce(failures, '') AS failures FROM g""")
def gate_eval(i: Inputs) -> DataFrame:
    return _gates(i).select("repo_id", "broken", "vulnerable", "weak", "critical", "high", "total", "passed",
                            "failure_count", F.array_join("failures", ";").alias("failures"))


@check("gate_status", _GATE + """SELECT count(*) AS total, count(*) FILTER (passed) AS passing,
  count(*) FILTER (NOT passed AND last_scanned_at IS NOT NULL) AS failing, count(*) FILTER (last_scanned_at IS NULL) AS not_scanned FROM g""")
def gate_status(i: Inputs) -> DataFrame:
    return gate.totals(_gates(i))


@check("gate_badges", _GATE + """SELECT repo_id, CASE WHEN last_scanned_at IS NULL THEN 'not scanned' WHEN passed THEN 'passing'
  ELSE 'failing (' || failure_count || ')' END AS badge FROM g""")
def gate_badges(i: Inputs) -> DataFrame:
    return gate.badges(_gates(i))


@check("project_rollup", """
SELECT p.project_id, p.name, count(r.repo_id) AS repo_count,
  coalesce(arg_min(r.risk_level, CASE r.risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END), 'UNKNOWN') AS risk_level
FROM projects_v p LEFT JOIN repos_v r ON r.project_id = p.project_id GROUP BY p.project_id, p.name""")
def project_rollup(i: Inputs) -> DataFrame:
    return reports.project_rollup(i.view("projects_v"), i.view("repos_v")).drop("last_scanned_at")


@check("agility_portfolio", """
SELECT count(agility_level) AS scored_repos, CAST(floor(avg(agility_level) + 0.5) AS BIGINT) AS mean_level,
  count(*) FILTER (has_hybrid) AS hybrid_repos, count(*) FILTER (agility_level = 1) AS urgent_repos FROM repos_v""")
def agility_portfolio(i: Inputs) -> DataFrame:
    return reports.agility_portfolio(i.view("repos_v"))


@check("repo_risk", f"""WITH secrets AS ({_SECRETS})
SELECT repo_id, CASE min(least({_risk('risk_level')}, 3)) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT repo_id, risk_level FROM findings_v UNION ALL SELECT repo_id, risk_level FROM secrets) GROUP BY repo_id""")
def repo_risk(i: Inputs) -> DataFrame:
    return reports.repo_risk(i.view("findings_v"), i.sql(_SECRETS))


@check("risk_totals", "SELECT risk_level, count(*) AS n FROM findings_v GROUP BY risk_level")
def risk_totals(i: Inputs) -> DataFrame:
    return reports.risk_totals(i.view("findings_v"))


@check("fail_on_threshold", f"SELECT count(*) AS n FROM findings_v WHERE {_risk('risk_level')} <= 1")
def fail_on_threshold(i: Inputs) -> DataFrame:
    return reports.at_or_above(i.view("findings_v"), "HIGH")


@check("min_risk_filter", f"SELECT finding_id, risk_level, file_path FROM findings_id_v WHERE {_risk('risk_level')} <= 1")
def min_risk_filter(i: Inputs) -> DataFrame:
    return explorer.by_risk_and_path(explorer.at_least(i.view("findings_id_v"), "high")).select(
        "finding_id", "risk_level", "file_path")


@check("findings_page", """
SELECT finding_id, risk_level, algorithm, created_at FROM findings_id_v WHERE NOT archived AND migration_status = 'open'
  AND algorithm ILIKE '%rsa%' AND (file_path ILIKE '%F1%' OR algorithm ILIKE '%F1%')
ORDER BY risk_level, created_at DESC, finding_id LIMIT 200 OFFSET 20""")
def findings_page(i: Inputs) -> DataFrame:
    rows = explorer.findings(i.view("findings_id_v"), migration_status="open", algorithm="rsa", search="F1")
    return explorer.findings_page(rows, skip=20).select("finding_id", "risk_level", "algorithm", "created_at")


@check("findings_filter", """
SELECT finding_id, repo_id, algorithm FROM findings_id_v
WHERE NOT archived AND quantum_status = 'VULNERABLE' AND source_type = 'dependency'
  AND repo_id IN (SELECT repo_id FROM repos_v WHERE project_id < 13)
  AND finding_id IN (SELECT finding_id FROM cves_v WHERE cve_id ILIKE '%cve-2024-10%')""")
def findings_filter(i: Inputs) -> DataFrame:
    # the repositories of projects 0 to 12 are treated as one project
    repos = i.view("repos_v").withColumn("project_id", (F.col("project_id") < 13).cast("int"))
    return explorer.findings(
        i.view("findings_id_v"), repos=repos, cves=i.view("cves_v"), project_id=1, quantum_status="VULNERABLE",
        source_type="dependency", cve_id="cve-2024-10").select("finding_id", "repo_id", "algorithm")


@check("archived_list", """
SELECT finding_id, algorithm, file_path FROM findings_id_v WHERE archived AND (file_path ILIKE '%f2%' OR algorithm ILIKE '%f2%')""")
def archived_list(i: Inputs) -> DataFrame:
    return explorer.archived(i.view("findings_id_v"), search="f2").select("finding_id", "algorithm", "file_path")


@check("newest_runs", "SELECT scan_run_id, started_at FROM scan_runs_v ORDER BY started_at DESC, scan_run_id LIMIT 50")
def newest_runs(i: Inputs) -> DataFrame:
    return explorer.newest(i.view("scan_runs_v"), "started_at", "scan_run_id", limit=50).select("scan_run_id", "started_at")


@check("row_search", """
SELECT finding_id FROM findings_id_v WHERE contains(lower(concat_ws(chr(1), file_path, algorithm, risk_level)), 'x25519')""")
def row_search(i: Inputs) -> DataFrame:
    return explorer.containing(i.view("findings_id_v"), ["file_path", "algorithm", "risk_level"], "X25519").select("finding_id")


@check("unvalidated", """
SELECT finding_id, 'pending' AS ai_label FROM findings_id_v WHERE source_type = 'source_code' AND NOT archived AND finding_id % 5 <> 0""")
def unvalidated(i: Inputs) -> DataFrame:
    rows = i.view("findings_id_v").withColumn("ai_validated", F.col("finding_id") % 5 == 0)
    return explorer.unvalidated(rows).select("finding_id", "ai_label")


@check("bulk_archive", """
SELECT finding_id, archived OR migration_status IN ('auto_resolved', 'manually_resolved') AS archived,
  NOT archived AND migration_status IN ('auto_resolved', 'manually_resolved') AS newly_archived FROM findings_id_v""")
def bulk_archive(i: Inputs) -> DataFrame:
    return lifecycle.archive_resolved(i.view("findings_id_v")).select("finding_id", "archived", "newly_archived")


_UPDATES = """SELECT o_orderkey AS finding_id, CASE o_custkey % 5 WHEN 0 THEN 'manually_resolved' WHEN 1 THEN 'open' WHEN 2 THEN 'false_positive'
  WHEN 3 THEN 're_opened' ELSE 'auto_resolved' END AS status, 'analyst' AS resolved_by, concat('note ', o_custkey) AS resolution_note,
  'ML-KEM-768' AS migrated_to FROM orders WHERE o_orderpriority = '1-URGENT'"""


@check("status_update", f"""WITH u AS ({_UPDATES})
SELECT f.finding_id, coalesce(u.status, f.migration_status) AS migration_status, u.resolved_by,
  CASE WHEN u.status IS NULL THEN f.resolution_note ELSE u.resolution_note END AS resolution_note,
  CASE WHEN u.status IN ('manually_resolved', 'false_positive') THEN TIMESTAMP '{_AS_OF}' END AS resolved_at
FROM findings_id_v f LEFT JOIN u ON u.finding_id = f.finding_id AND u.status <> 'auto_resolved'""")
def status_update(i: Inputs) -> DataFrame:
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    rows = i.view("findings_id_v").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    return lifecycle.change_status(rows, i.sql(_UPDATES), as_of).select(
        "finding_id", "migration_status", "resolved_by", "resolution_note", "resolved_at")


@check("archive_restore", """
SELECT finding_id, CASE WHEN finding_id IN (SELECT finding_id FROM cves_v) THEN true ELSE archived END AS archived FROM findings_id_v""")
def archive_restore(i: Inputs) -> DataFrame:
    return lifecycle.set_archived(i.view("findings_id_v"), i.view("cves_v"), True, F.lit(None)).select("finding_id", "archived")


@check("dedupe_latest", """
SELECT finding_id, archived FROM findings_id_v WHERE archived
UNION ALL SELECT finding_id, archived FROM (SELECT * FROM findings_id_v WHERE NOT archived
  QUALIFY row_number() OVER (PARTITION BY repo_id, file_path, algorithm ORDER BY created_at DESC, finding_id) = 1)""")
def dedupe_latest(i: Inputs) -> DataFrame:
    return lifecycle.newest_of_duplicates(i.view("findings_id_v")).select("finding_id", "archived")


# scanned are the known repositories; findings also belong to an unknown one
_SCANNED = "SELECT DISTINCT n.repo_id FROM new_pairs_v n JOIN repos_v r ON r.repo_id = n.repo_id"
_RUNS = f"SELECT repo_id, CAST(7 AS BIGINT) AS scan_run_id FROM ({_SCANNED}) s"
_RECONCILED = f"""
WITH runs AS ({_RUNS}),
j AS (SELECT f.*, r.scan_run_id AS run, n.repo_id IS NOT NULL AS present FROM findings_id_v f LEFT JOIN runs r ON r.repo_id = f.repo_id
  LEFT JOIN new_pairs_v n ON n.repo_id = f.repo_id AND n.file_path = f.file_path AND n.algorithm = f.algorithm),
e AS (SELECT *, run IS NOT NULL AND NOT archived AND source_type = 'source_code' AND scan_run_id <> run AS el FROM j)
"""


@check("reconcile", _RECONCILED + """
SELECT finding_id,
  CASE WHEN NOT el THEN migration_status
    WHEN migration_status = 'open' AND NOT present AND resolution_note IS NOT NULL THEN 'auto_resolved'
    WHEN migration_status = 'auto_resolved' AND present THEN 'open'
    WHEN migration_status = 'manually_resolved' AND present THEN 're_opened' ELSE migration_status END AS migration_status,
  CASE WHEN el AND present AND migration_status <> 'false_positive' THEN run ELSE scan_run_id END AS scan_run_id,
  CASE WHEN NOT el OR migration_status = 'false_positive' THEN resolution_note
    WHEN migration_status IN ('open', 're_opened') AND present THEN NULL
    WHEN migration_status = 'open' AND resolution_note IS NOT NULL THEN 'Not detected in 2 consecutive scans'
    WHEN migration_status = 'open' THEN 'Missed scan: 7'
    WHEN migration_status = 'auto_resolved' AND present THEN 'Re-introduced in latest scan'
    WHEN migration_status = 'manually_resolved' AND present THEN 'Re-detected after manual resolution — please review'
    ELSE resolution_note END AS resolution_note
FROM e""")
def reconcile(i: Inputs) -> DataFrame:
    return lifecycle.reconcile(i.view("findings_id_v"), i.view("new_pairs_v"), i.sql(_RUNS), F.lit(None)).select(
        "finding_id", "migration_status", "scan_run_id", "resolution_note")


_NEW = """SELECT repo_id, file_path, algorithm FROM new_pairs_v
UNION SELECT repo_id, file_path, algorithm FROM findings_v WHERE source_type = 'source_code'"""


@check("untracked_pairs", _RECONCILED + f"""
SELECT n.repo_id, n.file_path, n.algorithm FROM ({_NEW}) n
WHERE NOT EXISTS (SELECT 1 FROM e WHERE el AND e.repo_id = n.repo_id AND e.file_path = n.file_path AND e.algorithm = n.algorithm)""")
def untracked_pairs(i: Inputs) -> DataFrame:
    return lifecycle.untracked(i.view("findings_id_v"), i.sql(_NEW), i.sql(_RUNS))


@check("still_present", """
SELECT DISTINCT f.repo_id, f.file_path, f.algorithm FROM findings_id_v f JOIN new_pairs_v n
  ON n.repo_id = f.repo_id AND n.file_path = f.file_path AND n.algorithm = f.algorithm WHERE NOT f.archived""")
def still_present(i: Inputs) -> DataFrame:
    return lifecycle.still_present(i.view("findings_id_v"), i.view("new_pairs_v"))


_IN_TEST = "(repo_id % 3 = 0)"


@check("false_positive_hints", f"""
SELECT finding_id, CAST(CASE WHEN dead AND {_IN_TEST} THEN 0.85 WHEN dead THEN 0.75 WHEN {_IN_TEST} THEN 0.65 END AS DOUBLE) AS ai_confidence,
  CASE WHEN dead OR {_IN_TEST} THEN 'false_positive' END AS ai_label
FROM (SELECT *, finding_id % 4 = 1 AS dead FROM findings_id_v) WHERE source_type = 'source_code'
UNION ALL SELECT finding_id, NULL, NULL FROM findings_id_v WHERE source_type <> 'source_code'""")
def false_positive_hints(i: Inputs) -> DataFrame:
    rows = i.view("findings_id_v").withColumns({
        "ai_validated": F.lit(False), "in_test_path": F.col("repo_id") % 3 == 0,
        "reachable": F.when(F.col("finding_id") % 4 == 0, None).otherwise(F.col("finding_id") % 4 != 1)})
    return lifecycle.suggest_false_positives(rows).select("finding_id", "ai_confidence", "ai_label")


_URL = "regexp_replace(r.url, '\\.git$', '') || '/blob/' || r.branch || '/' || f.file_path || CASE WHEN f.line_number <> 0 THEN '#L' || f.line_number ELSE '' END"


@check("blob_url", f"""
SELECT f.repo_id, f.file_path, f.line_number, {_URL} AS source_url, count(*) AS n
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id WHERE f.source_type <> 'dependency' GROUP BY ALL""")
def blob_url(i: Inputs) -> DataFrame:
    rows = explorer.with_links(i.view("findings_v"), i.view("repos_v")).where(F.col("source_url").isNotNull())
    return rows.groupBy("repo_id", "file_path", "line_number", "source_url").agg(F.count("*").alias("n"))


_EXPORT_SQL = f"""WITH {_LATEST}, secrets AS ({_SECRETS}),
cb AS (SELECT algorithm, count(*) AS total_usages, count(DISTINCT repo_id) AS affected_repos FROM findings_v
  WHERE NOT archived AND migration_status IN ('open', 're_opened') AND (source_type = 'artifact' OR scan_run_id IN (SELECT scan_run_id FROM latest)) GROUP BY algorithm),
x AS (SELECT f.algorithm, f.algo_type AS type, f.quantum_status, f.risk_level, r.name AS repo, f.file_path, f.line_number, {_URL} AS source_url, 'code' AS source, f.migration_status
  FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id WHERE NOT f.archived AND f.migration_status <> 'false_positive'
  UNION ALL SELECT f.algorithm, f.finding_type, f.quantum_status, f.risk_level, r.name, f.file_path, NULL, regexp_replace(r.url, '\\.git$', '') || '/blob/' || r.branch || '/' || f.file_path, 'secret', 'open'
  FROM secrets f JOIN repos_v r ON r.repo_id = f.repo_id WHERE NOT f.archived AND f.migration_status <> 'false_positive')
SELECT x.*, cb.total_usages, cb.affected_repos FROM x LEFT JOIN cb ON cb.algorithm = x.algorithm"""


@check("export_rows", _EXPORT_SQL)
def export_rows(i: Inputs) -> DataFrame:
    findings = i.view("findings_v")
    cbom = bom.rebuild(findings, i.view("scan_runs_v"))
    return exports.inventory_rows(findings, i.view("repos_v"), cbom, i.sql(_SECRETS)).drop("nist_replacement")


@check("evidence", f"""WITH secrets AS ({_SECRETS}),
c AS (SELECT f.algorithm, {_URL} AS location FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id WHERE NOT f.archived AND f.migration_status <> 'false_positive'),
s AS (SELECT DISTINCT f.algorithm, regexp_replace(r.url, '\\.git$', '') || '/blob/' || r.branch || '/' || f.file_path AS location
  FROM secrets f JOIN repos_v r ON r.repo_id = f.repo_id WHERE NOT f.archived AND f.migration_status <> 'false_positive')
SELECT algorithm, location, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT algorithm, location, 1 FROM s WHERE (algorithm, location) NOT IN (SELECT (algorithm, location) FROM c)""")
def evidence(i: Inputs) -> DataFrame:
    rows = bom.evidence(i.view("findings_v"), i.view("repos_v"), i.sql(_SECRETS))
    return rows.groupBy("algorithm", "location").agg(F.count("*").alias("n"))


_META = ", ".join(f"({quoted(a.name)}, {quoted(a.algo_type)}, {quoted(a.quantum_status)}, {quoted(a.nist_replacement)}, "
                  f"{grades.PRIORITY[a.quantum_status]}, {grades.NIST_LEVEL.get(a.quantum_status, 0)})" for a in REGISTRY)


@check("cyclonedx", f"""WITH {_LATEST},
cb AS (SELECT algorithm, count(*) AS total, count(DISTINCT repo_id) AS repos FROM findings_v
  WHERE NOT archived AND migration_status IN ('open', 're_opened') AND (source_type = 'artifact' OR scan_run_id IN (SELECT scan_run_id FROM latest)) GROUP BY algorithm),
ev AS (SELECT f.algorithm, {_URL} AS location, count(*) AS copies FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id
  WHERE NOT f.archived AND f.migration_status <> 'false_positive' GROUP BY ALL),
fst AS (SELECT algorithm, min(location) AS first FROM ev GROUP BY algorithm),
h AS (SELECT cb.*, m.*, fst.first, row_number() OVER (ORDER BY m.priority, cb.algorithm) AS rn
  FROM cb JOIN (VALUES {_META}) AS m(name, type, status, nist, priority, lvl) ON m.name = cb.algorithm LEFT JOIN fst ON fst.algorithm = cb.algorithm)
SELECT 1 AS part, priority, algorithm, 0 AS sub, '' AS location, 0 AS copy,
  CASE WHEN rn = 1 THEN '' ELSE ',' END || '{{"type":"cryptographic-asset","bom-ref":"' || sha256(algorithm) || '","name":"' || algorithm
  || '","cryptoProperties":{{"assetType":"' || type || '","algorithmProperties":{{"nistQuantumSecurityLevel":' || lvl || '}}}},"x-pqc-status":"' || status
  || '","x-nist-replacement":"' || nist || '","x-total-usages":' || total || ',"x-affected-repos":' || repos
  || CASE WHEN first IS NOT NULL THEN ',"evidence":{{"occurrences":[' ELSE '' END AS line FROM h
UNION ALL SELECT 1, priority, algorithm, 1, location, n, CASE WHEN location = first AND n = 1 THEN '' ELSE ',' END || '{{"location":"' || location || '"}}'
  FROM (SELECT h.priority, h.algorithm, h.first, ev.location, unnest(range(1, ev.copies + 1)) AS n FROM ev JOIN h ON h.algorithm = ev.algorithm)
UNION ALL SELECT 1, priority, algorithm, 2, '', 0, CASE WHEN first IS NOT NULL THEN ']}}}}' ELSE '}}' END FROM h
UNION ALL SELECT 0, 0, '', 0, '', 0, '{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"serialNumber":"urn:uuid:00000000-0000-0000-0000-000000000000","metadata":{{"timestamp":"1998-12-01T00:00:00+00:00","component":{{"type":"application","name":"inventory"}}}},"components":[' FROM (SELECT 1)
UNION ALL SELECT 2, 0, '', 0, '', 0, ']}}' FROM (SELECT 1)""")
def cyclonedx(i: Inputs) -> DataFrame:
    checkpoint_dir(i.spark)
    findings = i.view("findings_v")
    cbom = bom.rebuild(findings, i.view("scan_runs_v")).checkpoint()  # a small table, read several times
    places = bom.evidence(findings, i.view("repos_v"))
    return exports.cyclonedx_lines(cbom, places, "inventory", "urn:uuid:00000000-0000-0000-0000-000000000000",
                                   "1998-12-01T00:00:00+00:00").select("part", "priority", "algorithm", "sub", "location", "copy", "line")


@check("scan_export", """
SELECT 'code' AS source, file_path AS file, line_number AS line, algorithm, algo_type AS type, risk_level, quantum_status, count(*) AS n FROM findings_v GROUP BY ALL""")
def scan_export(i: Inputs) -> DataFrame:
    rows = exports.scan_rows(i.view("findings_v").withColumn("nist_replacement", F.lit(None).cast("string")))
    return rows.groupBy("source", "file", "line", "algorithm", "type", "risk_level", "quantum_status").agg(F.count("*").alias("n"))


@check("replaced_dependencies", f"""WITH s AS ({_SCANNED})
SELECT repo_id, source_type, count(*) AS n FROM (
  SELECT repo_id, source_type FROM findings_id_v WHERE source_type <> 'dependency' OR repo_id NOT IN (SELECT repo_id FROM s)
  UNION ALL SELECT repo_id, 'dependency' FROM new_pairs_v WHERE repo_id IN (SELECT repo_id FROM s)) GROUP BY ALL""")
def replaced_dependencies(i: Inputs) -> DataFrame:
    findings = i.view("findings_id_v")
    fresh = i.view("new_pairs_v").withColumn("source_type", F.lit("dependency"))
    scanned = i.sql(_SCANNED)
    fresh = fresh.join(scanned, "repo_id", "left_semi")
    old = findings.where(F.col("source_type") == "dependency")
    rest = findings.where(F.col("source_type") != "dependency")
    table = rest.unionByName(exports.full_replace(old, fresh, scanned), allowMissingColumns=True)
    return table.groupBy("repo_id", "source_type").agg(F.count("*").alias("n"))


_PLAYBOOKS = ", ".join(f"({quoted(p[0])}, {quoted(p[2])}, {quoted(p[3])}, {quoted(','.join(p[5]))})" for p in grades.PLAYBOOKS)


@check("finding_playbooks", f"""
SELECT f.finding_id, p.severity AS playbook_severity, p.effort AS migration_effort, p.languages
FROM findings_id_v f LEFT JOIN (VALUES {_PLAYBOOKS}) AS p(key, severity, effort, languages)
  ON p.key = replace(upper(f.algorithm), ' ', '-')""")
def finding_playbooks(i: Inputs) -> DataFrame:
    return playbooks.attach(i.view("findings_id_v")).select(
        "finding_id", "playbook_severity", "migration_effort", F.array_join("playbook_languages", ",").alias("languages"))


@check("playbooks_for_language", f"""
SELECT f.finding_id, p.key AS playbook FROM findings_id_v f JOIN (VALUES {_PLAYBOOKS}) AS p(key, severity, effort, languages)
  ON p.key = replace(upper(f.algorithm), ' ', '-') AND contains(p.languages, 'go')""")
def playbooks_for_language(i: Inputs) -> DataFrame:
    return playbooks.for_language(i.view("findings_id_v"), "Go").select("finding_id", playbooks.key_of(F.col("algorithm")).alias("playbook"))


@check("cbom_by_status", f"""WITH {_LATEST}
SELECT f.algorithm, count(*) AS total_usages FROM findings_v f WHERE NOT archived AND migration_status IN ('open', 're_opened')
  AND (source_type = 'artifact' OR scan_run_id IN (SELECT scan_run_id FROM latest)) AND quantum_status = 'VULNERABLE' GROUP BY f.algorithm""")
def cbom_by_status(i: Inputs) -> DataFrame:
    cbom = bom.rebuild(i.view("findings_v"), i.view("scan_runs_v"))
    return bom.with_status(cbom, "VULNERABLE").select("algorithm", "total_usages")


@check("project_cbom", f"""WITH {_LATEST}, secrets AS ({_SECRETS}),
cb AS (SELECT algorithm, count(*) AS total_usages FROM findings_v WHERE NOT archived AND migration_status IN ('open', 're_opened')
  AND (source_type = 'artifact' OR scan_run_id IN (SELECT scan_run_id FROM latest)) GROUP BY algorithm)
SELECT algorithm, total_usages FROM cb WHERE algorithm IN (
  SELECT algorithm FROM findings_v WHERE NOT archived AND migration_status <> 'false_positive' AND repo_id IN (SELECT repo_id FROM repos_v WHERE project_id = 7)
  UNION SELECT algorithm FROM secrets WHERE NOT archived AND migration_status <> 'false_positive' AND repo_id IN (SELECT repo_id FROM repos_v WHERE project_id = 7))""")
def project_cbom(i: Inputs) -> DataFrame:
    findings = i.view("findings_v")
    algorithms = bom.project_algorithms(findings, i.sql(_SECRETS), i.view("repos_v"))
    return bom.for_project(bom.rebuild(findings, i.view("scan_runs_v")), algorithms, 7).select("algorithm", "total_usages")


@check("project_findings", """
SELECT f.finding_id FROM findings_id_v f WHERE f.repo_id IN (SELECT repo_id FROM repos_v WHERE project_id = 20)""")
def project_findings(i: Inputs) -> DataFrame:
    return explorer.of_project(i.view("findings_id_v"), i.view("repos_v"), 20).select("finding_id")


@check("project_coverage", """
SELECT r.repo_id, r.name, f.algorithm, any_value(f.quantum_status) AS worst_status, count(*) AS n
FROM findings_v f JOIN repos_v r ON r.repo_id = f.repo_id AND r.project_id = 7
WHERE NOT f.archived AND f.migration_status <> 'false_positive' GROUP BY r.repo_id, r.name, f.algorithm""")
def project_coverage(i: Inputs) -> DataFrame:
    return reports.coverage_matrix(i.view("findings_v"), i.view("repos_v"), project_id=7)


@check("scan_evidence", """
SELECT algorithm, file_path || '#' || line_number AS location, count(*) AS n FROM findings_v GROUP BY ALL""")
def scan_evidence(i: Inputs) -> DataFrame:
    return exports.scan_evidence(i.view("findings_v")).groupBy("algorithm", "location").agg(F.count("*").alias("n"))


@check("severity_page", f"""
SELECT finding_id, risk_level FROM findings_id_v WHERE NOT archived ORDER BY {_risk('risk_level')}, created_at DESC, finding_id LIMIT 200""")
def severity_page(i: Inputs) -> DataFrame:
    rows = explorer.findings(i.view("findings_id_v"))
    return explorer.findings_page(rows, severity_order=True).select("finding_id", "risk_level")
