"""The cryptographic bill of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import grades as g
from keyfathom.functions import paths
from keyfathom.functions.groups import join_each, newest_per
from keyfathom.operators.lifecycle import OPEN


def latest_runs(scan_runs: DataFrame, per_scan_type: bool = False) -> DataFrame:
    """The newest complete run of each repository; runs that started together all count."""
    keys = ["repo_id", "scan_type"] if per_scan_type else ["repo_id"]
    done = scan_runs.where(F.col("status") == "complete")
    return newest_per(done, keys, F.col("started_at").desc())


def in_latest_runs(findings: DataFrame, scan_runs: DataFrame) -> DataFrame:
    ids = latest_runs(scan_runs).select("scan_run_id")
    return findings.join(ids, "scan_run_id", "left_semi")


def outside_latest_runs(findings: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """Artifact findings no latest run accounts for."""
    ids = latest_runs(scan_runs).select("scan_run_id")
    return findings.where(F.col("source_type") == "artifact").join(ids, "scan_run_id", "left_anti")


def normal_secret_algorithm(algorithm: Column) -> Column:
    name = F.coalesce(algorithm, F.lit(""))
    return (F.when(F.startswith(name, F.lit("ECDSA-")), "ECDSA")
            .when(F.startswith(name, F.lit("DSA-")), "DSA").otherwise(name))


def secret_algo_type(finding_type: Column) -> Column:
    from keyfathom.dims import grades
    return g.lookup(finding_type, grades.SECRET_TYPES, grades.SECRET_TYPE_DEFAULT)


def _countable(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("archived") & F.col("migration_status").isin(OPEN))


def rebuild(findings: DataFrame, scan_runs: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """One row per algorithm over everything currently open.

    Counted are findings and secrets of the latest runs, plus artifact findings
    of any other run.  Usages are first added up per algorithm and repository,
    with buffers of plain numbers, so hot algorithms are reduced on the map side.
    """
    ids = latest_runs(scan_runs).select("scan_run_id").distinct()
    marked = (_countable(findings)
              .join(ids.withColumn("_latest", F.lit(True)), "scan_run_id", "left")
              .where(F.col("_latest").isNotNull() | (F.col("source_type") == "artifact")))
    latest = F.col("_latest").isNotNull()
    nist = F.col("nist_replacement") if "nist_replacement" in findings.columns else F.lit(None).cast("string")
    code = marked.select(
        "algorithm", "repo_id", "algo_type", "quantum_status", nist.alias("nist_replacement"),
        (F.col("source_type") == "artifact").cast("long").alias("artifact"),
        F.lit(0).cast("long").alias("secret"),
        (latest & (F.col("reachable") == False)).cast("long").alias("unreachable"),  # noqa: E712
        F.when(latest, F.col("call_depth")).alias("call_depth"))
    if secrets is not None:
        kept = _countable(secrets).join(ids, "scan_run_id", "left_semi")
        code = code.unionByName(kept.select(
            normal_secret_algorithm(F.col("algorithm")).alias("algorithm"), "repo_id",
            secret_algo_type(F.col("finding_type")).alias("algo_type"),
            F.coalesce("quantum_status", F.lit("VULNERABLE")).alias("quantum_status"),
            "nist_replacement", F.lit(0).cast("long").alias("artifact"),
            F.lit(1).cast("long").alias("secret"), F.lit(0).cast("long").alias("unreachable"),
            F.lit(None).cast("int").alias("call_depth")))
    per_repo = code.groupBy("algorithm", "repo_id", "algo_type", "quantum_status", "nist_replacement").agg(
        F.count("*").alias("total"), F.sum("artifact").alias("artifact"),
        F.sum("secret").alias("secret"), F.sum("unreachable").alias("unreachable"),
        F.min("call_depth").alias("depth"))
    worst = F.struct(g.status_rank(F.col("quantum_status")).alias("r"),
                     "quantum_status", "algo_type", "nist_replacement")
    totals = per_repo.groupBy("algorithm").agg(
        F.sum("total").alias("total_usages"),
        (F.sum("total") - F.sum("artifact") - F.sum("secret")).alias("code_usages"),
        F.sum("secret").alias("secret_usages"),
        F.sum("artifact").alias("artifact_usages"),
        F.sum("unreachable").alias("unreachable_count"),
        F.min("depth").alias("min_call_depth"),
        F.countDistinct("repo_id").alias("affected_repos"),
        F.min(worst).alias("w"))
    name = F.col("algorithm")
    status = F.coalesce(g.registry_field(name, "quantum_status"), F.col("w.quantum_status"))
    return totals.select(
        "algorithm",
        F.coalesce(g.registry_field(name, "algo_type"), F.col("w.algo_type")).alias("algo_type"),
        status.alias("quantum_status"),
        F.coalesce(g.registry_field(name, "nist_replacement"), F.col("w.nist_replacement")).alias("nist_replacement"),
        g.priority(status).alias("priority"), g.risk_score(status).alias("risk_score"),
        "total_usages", "code_usages", "secret_usages", "artifact_usages",
        "unreachable_count", "min_call_depth", "affected_repos")


def by_priority(entries: DataFrame) -> DataFrame:
    return entries.orderBy("priority", "algorithm")


def scan_inventory(findings: DataFrame) -> DataFrame:
    """Bill of materials of one ad-hoc scan; the first path segment stands for the repository."""
    top = F.substring_index("file_path", "/", 1)
    per_repo = (findings.groupBy("algorithm", "algo_type", "quantum_status", "nist_replacement",
                                 top.alias("top"))
                .agg(F.count("*").alias("n")))
    return per_repo.groupBy("algorithm", "algo_type", "quantum_status", "nist_replacement").agg(
        F.sum("n").alias("total_usages"), F.count("*").alias("affected_repos")).select(
        "algorithm", "algo_type", "quantum_status", "nist_replacement",
        g.scan_priority(F.col("quantum_status")).alias("priority"),
        g.scan_risk_score(F.col("quantum_status")).alias("risk_score"),
        "total_usages", "affected_repos")


def reportable(rows: DataFrame) -> DataFrame:
    """Findings reports show: not archived and not dismissed."""
    return rows.where(~F.col("archived") & (F.col("migration_status") != "false_positive"))


def project_algorithms(findings: DataFrame, secrets: DataFrame, repos: DataFrame) -> DataFrame:
    """Distinct (project_id, algorithm), from code and from secrets."""
    def of(rows: DataFrame) -> DataFrame:
        return reportable(rows).select("repo_id", "algorithm").distinct()

    pairs = of(findings).union(of(secrets)).distinct()
    return pairs.join(repos.select("repo_id", "project_id"), "repo_id").select(
        "project_id", "algorithm").distinct()


def for_project(entries: DataFrame, algorithms: DataFrame, project_id: object) -> DataFrame:
    """Entries of one project's algorithms; a project without any gets none."""
    wanted = algorithms.where(F.col("project_id") == project_id).select("algorithm")
    return by_priority(entries.join(wanted, "algorithm", "left_semi"))


def with_status(entries: DataFrame, status: str | None) -> DataFrame:
    return entries if status in (None, "ALL") else entries.where(F.col("quantum_status") == status)


def evidence(findings: DataFrame, repos: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """(algorithm, location) rows: links to every place an algorithm was found.

    Code locations keep their duplicates, secret locations do not repeat.
    """
    where = repos.select("repo_id", "url", "branch")
    code = join_each(reportable(findings), where, "repo_id").select(
        "algorithm", paths.blob_url(F.col("url"), F.col("branch"), F.col("file_path"),
                                    F.col("line_number")).alias("location"), F.lit("code").alias("source"))
    if secrets is None:
        return code
    secret = (join_each(reportable(secrets), where, "repo_id").select(
        "algorithm", paths.blob_url(F.col("url"), F.col("branch"), F.col("file_path")).alias("location"))
        .distinct().join(code.select("algorithm", "location"), ["algorithm", "location"], "left_anti")
        .withColumn("source", F.lit("secret")))
    return code.unionByName(secret)
