"""Aggregated reports.

The pattern throughout: count by all needed columns first, with number-only
buffers that combine on the map side, then fold the few resulting rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions import grades as g
from keyfathom.operators.bom import reportable


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Several one-row results as one row: stacked, then folded, so nothing is joined."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _tally(cells: DataFrame, *metrics: tuple[str, Column | str | None, Column | str]) -> DataFrame:
    """(metric, key, n) rows from counted cells, all metrics in one pass.

    A metric is (name, key column or None, how much a cell counts); cells that
    count null are left out of it.
    """
    def entry(metric: str, key: Column | str | None, weight: Column | str) -> Column:
        key = F.lit(None) if key is None else F.col(key) if isinstance(key, str) else key
        weight = F.col(weight) if isinstance(weight, str) else weight
        return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"),
                        weight.cast("long").alias("n"))

    entries = F.filter(F.array(*[entry(*m) for m in metrics]), lambda e: e["n"].isNotNull())
    return cells.select(F.inline(entries)).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """(metric, key, n): counts by risk, status, state and source, total and archived."""
    cells = findings.groupBy("archived", "risk_level", "quantum_status", "migration_status",
                             "source_type").agg(F.count("*").alias("n"))
    active = F.when(~F.col("archived"), F.col("n"))
    flag = F.when(F.col("archived"), "archived").otherwise("active")
    return _tally(cells, ("by_risk", "risk_level", active), ("by_quantum_status", "quantum_status", active),
                  ("by_status", "migration_status", active), ("by_source", "source_type", active),
                  ("total", flag, "n"))


def top_algorithms(findings: DataFrame, n: int = 10) -> DataFrame:
    return (findings.where(~F.col("archived")).groupBy("algorithm").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "algorithm").limit(n))


def dashboard(findings: DataFrame, repos: DataFrame, scan_runs: DataFrame, cbom: DataFrame,
              artifacts: DataFrame) -> DataFrame:
    """One row of portfolio numbers, with one pass over each input."""
    source = F.col("source_type") == "source_code"
    f = findings.where(~F.col("archived")).agg(
        F.count("*").alias("total_findings"),
        count_if(F.col("quantum_status") == "VULNERABLE").alias("vulnerable"),
        count_if(F.col("quantum_status") == "BROKEN").alias("broken"),
        count_if(g.is_quantum_safe(F.col("quantum_status"))).alias("safe"),
        count_if(F.col("source_type") == "artifact").alias("artifact_findings"),
        count_if(source).alias("source_findings"),
        count_if(source & F.col("reachable").isNotNull()).alias("call_graph_analyzed"),
        count_if(source & (F.col("reachable") == False)).alias("unreachable_findings"))  # noqa: E712
    r = repos.agg(F.count("*").alias("total_repos"),
                  count_if(F.col("risk_level") == "CRITICAL").alias("critical_repos"))
    s = scan_runs.agg(F.max("started_at").alias("last_scan_at"))
    c = cbom.agg(F.count("*").alias("cbom_entries"))
    done = artifacts.where(F.col("scan_status") == "complete")
    a = done.agg(F.countDistinct("repo_id").alias("artifact_repos"), F.count("*").alias("total_artifacts"))
    one = side_by_side(f, r, s, c, a)
    zero = {k: F.coalesce(k, F.lit(0)) for k in (
        "vulnerable", "broken", "safe", "artifact_findings", "source_findings",
        "call_graph_analyzed", "unreachable_findings", "critical_repos")}
    return one.withColumns(zero).select(
        "total_repos", "critical_repos", "total_findings", "vulnerable", "broken", "safe",
        "cbom_entries", "last_scan_at", "artifact_repos", "total_artifacts", "artifact_findings",
        g.percent(F.col("artifact_repos"), F.col("total_repos")).alias("artifact_coverage_pct"),
        "call_graph_analyzed",
        g.percent(F.col("call_graph_analyzed"), F.col("source_findings")).alias("call_graph_coverage_pct"),
        "unreachable_findings")


def coverage_matrix(findings: DataFrame, repos: DataFrame, project_id: object = None) -> DataFrame:
    """(repo_id, name, algorithm, worst_status, n) cells of the repo × algorithm grid."""
    cells = reportable(findings).groupBy("repo_id", "algorithm", "quantum_status").agg(
        F.count("*").alias("n"))
    folded = cells.groupBy("repo_id", "algorithm").agg(
        g.worst_status(F.col("quantum_status")).alias("worst_status"), F.sum("n").alias("n"))
    chosen = repos if project_id is None else repos.where(F.col("project_id") == project_id)
    return folded.join(chosen.select("repo_id", "name"), "repo_id").select(
        "repo_id", "name", "algorithm", "worst_status", "n")


def algorithm_order(matrix: DataFrame) -> DataFrame:
    """Algorithms of a coverage matrix, worst status seen anywhere first."""
    return (matrix.groupBy("algorithm").agg(F.min(g.status_rank(F.col("worst_status"))).alias("rank"))
            .orderBy("rank", "algorithm"))


def coverage_grid(matrix: DataFrame, algorithms: list[str]) -> DataFrame:
    """The matrix as one row per repository with a column per given algorithm."""
    return matrix.groupBy("repo_id", "name").pivot("algorithm", algorithms).agg(F.first("worst_status"))


def blast_radius(findings: DataFrame, repos: DataFrame, algorithm: str,
                 project_id: object = None) -> DataFrame:
    """Repositories touched when ``algorithm`` falls, most findings first."""
    cells = (reportable(findings).where(F.col("algorithm") == algorithm)
             .groupBy("repo_id", "source_type", "quantum_status").agg(F.count("*").alias("n")))
    ranked = F.least(g.status_rank(F.col("quantum_status")), F.lit(grades.STATUS_RANK["SAFE"]))
    folded = cells.groupBy("repo_id").agg(
        F.sum("n").alias("finding_count"), F.sort_array(F.collect_set("source_type")).alias("source_types"),
        F.min(ranked).alias("rank"))
    names = {rank: status for status, rank in grades.STATUS_RANK.items()}
    chosen = repos if project_id is None else repos.where(F.col("project_id") == project_id)
    return (folded.join(chosen.select("repo_id", "name", "risk_level"), "repo_id")
            .select("repo_id", "name", F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"),
                    "finding_count", "source_types",
                    g.lookup(F.col("rank"), names).alias("worst_status"))
            .orderBy(F.col("finding_count").desc(), "repo_id"))


def blast_totals(radius: DataFrame, cbom: DataFrame, algorithm: str) -> DataFrame:
    totals = radius.agg(F.count("*").alias("total_repos"),
                        F.coalesce(F.sum("finding_count"), F.lit(0)).alias("total_findings"))
    entry = cbom.where(F.col("algorithm") == algorithm).select(
        "quantum_status", "nist_replacement", "algo_type")
    return side_by_side(totals, entry).withColumn("algorithm", F.lit(algorithm))


def migration_stats(findings: DataFrame, repo_id: object = None) -> DataFrame:
    """Per algorithm: how many findings are in each state and how far migration is."""
    rows = findings.where(~F.col("archived"))
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    cells = rows.groupBy("algorithm", "risk_level", "quantum_status",
                         F.coalesce("migration_status", F.lit("open")).alias("state")).agg(
        F.count("*").alias("n"))

    def state(name: str) -> Column:
        return F.sum(F.when(F.col("state") == name, F.col("n")).otherwise(0)).alias(name)

    folded = cells.groupBy("algorithm").agg(
        F.min(F.struct(g.risk_rank(F.col("risk_level")), "risk_level")).alias("_risk"),
        g.worst_status(F.col("quantum_status")).alias("_status"),
        *[state(s) for s in ("open", "auto_resolved", "manually_resolved", "re_opened", "false_positive")],
        F.sum("n").alias("total"))
    resolved = F.col("auto_resolved") + F.col("manually_resolved")
    name = F.col("algorithm")
    return folded.select(
        "algorithm",
        F.coalesce(g.registry_field(name, "risk_level"), F.col("_risk.risk_level")).alias("risk_level"),
        F.coalesce(g.registry_field(name, "quantum_status"), F.col("_status")).alias("quantum_status"),
        "open", "auto_resolved", "manually_resolved", "re_opened", "false_positive", "total",
        resolved.alias("resolved"), g.percent(resolved, F.col("total")).alias("progress_pct"),
    ).orderBy(g.risk_rank(F.col("risk_level"), 9), F.col("open").desc(), "algorithm")


def migration_targets(findings: DataFrame) -> DataFrame:
    """(algorithm, migrated_to, n): what replaced each algorithm, one row per target."""
    moved = findings.where(~F.col("archived") & (F.coalesce("migrated_to", F.lit("")) != ""))
    return moved.groupBy("algorithm", "migrated_to").agg(F.count("*").alias("n"))


def hybrid_repos(repos: DataFrame) -> DataFrame:
    return repos.where(F.col("has_hybrid"))


def _exposed(cves: DataFrame, findings: DataFrame) -> DataFrame:
    """(cve_id, cvss_severity, repo_id, n) over findings that are not archived."""
    active = findings.where(~F.col("archived")).select("finding_id", "repo_id")
    return (cves.join(active, "finding_id").groupBy("cve_id", "cvss_severity", "repo_id")
            .agg(F.count("*").alias("n")))


def cve_exposed(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Active dependency findings with a known CVE."""
    return _dependencies(findings).join(cves.select("finding_id"), "finding_id", "left_semi")


def cve_missing(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Active dependency findings without one."""
    return _dependencies(findings).join(cves.select("finding_id"), "finding_id", "left_anti")


def _dependencies(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("archived") & (F.col("source_type") == "dependency"))


def cve_stats(findings: DataFrame, cves: DataFrame) -> DataFrame:
    records = _exposed(cves, findings).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_cve_records"),
        F.countDistinct("cve_id").alias("distinct_cves"))
    with_cve = cves.select("finding_id").distinct().withColumn("_cve", F.lit(True))
    coverage = _dependencies(findings).select("finding_id").join(with_cve, "finding_id", "left").agg(
        F.count("*").alias("dependency_findings_total"),
        F.count("_cve").alias("dependency_findings_with_cve"))
    return side_by_side(records, coverage).select(
        "*", g.percent(F.col("dependency_findings_with_cve"),
                       F.col("dependency_findings_total")).alias("coverage_pct"))


def top_cves(findings: DataFrame, cves: DataFrame, n: int = 5) -> DataFrame:
    return (_exposed(cves, findings).groupBy("cve_id", "cvss_severity")
            .agg(F.countDistinct("repo_id").alias("affected_repos"))
            .orderBy(F.col("affected_repos").desc(), "cve_id", "cvss_severity").limit(n))


def cves_of_findings(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Findings with their CVE records, one row per record (null for none)."""
    return findings.join(cves, "finding_id", "left")


def project_rollup(projects: DataFrame, repos: DataFrame) -> DataFrame:
    ranks = {**grades.RISK_RANK, "UNKNOWN": 4}
    rank = F.coalesce(g.lookup(F.col("risk_level"), ranks), F.lit(4))
    scanned = F.max("last_scanned_at") if "last_scanned_at" in repos.columns else F.max(F.lit(None).cast("timestamp"))
    per = repos.groupBy("project_id").agg(F.count("*").alias("repo_count"), F.min(rank).alias("_rank"),
                                          scanned.alias("last_scanned_at"))
    label = g.lookup(F.coalesce("_rank", F.lit(4)), {v: k for k, v in ranks.items()})
    return projects.join(per, "project_id", "left").select(
        *projects.columns, F.coalesce("repo_count", F.lit(0)).alias("repo_count"),
        label.alias("risk_level"), "last_scanned_at")


def agility_portfolio(repos: DataFrame) -> DataFrame:
    """Scored repositories, mean level (halves up), hybrid count and urgent count."""
    level = F.col("agility_level")
    return repos.agg(
        F.count(level).alias("scored_repos"), F.floor(F.avg(level) + 0.5).cast("long").alias("mean_level"),
        F.coalesce(count_if(F.col("has_hybrid")), F.lit(0)).alias("hybrid_repos"),
        F.coalesce(count_if(level == 1), F.lit(0)).alias("urgent_repos"))


def repo_risk(*finding_sets: DataFrame) -> DataFrame:
    """Worst risk per repository over code, dependency and secret findings."""
    rows = finding_sets[0].select("repo_id", "risk_level")
    for more in finding_sets[1:]:
        rows = rows.unionAll(more.select("repo_id", "risk_level"))
    # every unranked risk counts as the starting value LOW
    rank = F.least(g.risk_rank(F.col("risk_level")), F.lit(grades.RISK_RANK["LOW"]))
    label = g.lookup(F.col("_rank"), {v: k for k, v in grades.RISK_RANK.items()})
    return rows.groupBy("repo_id").agg(F.min(rank).alias("_rank")).select(
        "repo_id", label.alias("risk_level"))


def scan_run_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files and findings of each repository's scan (code and dependency findings)."""
    f = files.groupBy("repo_id").agg(F.count("*").alias("total_files"))
    n = findings.groupBy("repo_id").agg(F.count("*").alias("total_findings"))
    return f.join(n, "repo_id", "left").select(
        "repo_id", "total_files", F.col("total_files").alias("scanned_files"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"))


def network_summary(network: DataFrame) -> DataFrame:
    """(metric, key, n) over TLS findings; the breakdowns cover complete scans only."""
    cells = network.groupBy("scan_status", "quantum_status", "tls_version", "risk_level").agg(
        F.count("*").alias("n"))
    done = F.when(F.col("scan_status") == "complete", F.col("n"))
    return _tally(cells, ("by_quantum_status", "quantum_status", done), ("by_tls_version", "tls_version", done),
                  ("by_risk_level", "risk_level", done), ("scan_status", "scan_status", "n"))


def runtime_summary(runtime_findings: DataFrame) -> DataFrame:
    """(metric, key, n): findings by algorithm, risk and status, plus totals."""
    cells = runtime_findings.groupBy("host_id", "algorithm", "risk_level", "quantum_status").agg(
        F.count("*").alias("n"))
    hosts = cells.agg(F.lit("total_hosts").alias("metric"), F.lit(None).cast("string").alias("key"),
                      F.countDistinct("host_id").alias("n"))
    return _tally(cells, ("by_algorithm", "algorithm", "n"), ("by_risk_level", "risk_level", "n"),
                  ("by_quantum_status", "quantum_status", "n"), ("total_findings", None, "n")).unionByName(hosts)


def secrets_summary(secrets: DataFrame) -> DataFrame:
    """(metric, key, n): total, expiring or expired, and counts by risk."""
    active = secrets.where(~F.col("archived")) if "archived" in secrets.columns else secrets
    cells = active.groupBy("risk_level", "expiry_status").agg(F.count("*").alias("n"))
    expiring = F.col("expiry_status").isin("EXPIRED", "EXPIRES_SOON", "EXPIRES_90D")
    return _tally(cells, ("by_risk", "risk_level", "n"), ("total", None, "n"),
                  ("expiring", None, F.when(expiring, F.col("n")).otherwise(0)))


def risk_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("risk_level").agg(F.count("*").alias("n"))


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    """How many findings would fail a build that tolerates less than ``threshold``."""
    limit = grades.RISK_RANK[threshold.upper()]
    return findings.agg(F.coalesce(count_if(g.risk_rank(F.col("risk_level")) <= limit),
                                   F.lit(0)).alias("n"))
