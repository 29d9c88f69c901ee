"""CI gates: may this repository be merged?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions import grades as g
from keyfathom.functions.groups import limit_per
from keyfathom.operators.lifecycle import OPEN
from keyfathom.operators.reports import count_if

#: Failures that a report lists.
MAX_FAILURES = 20
_FLAG_OF = {"BROKEN": "fail_on_broken", "VULNERABLE": "fail_on_vulnerable", "WEAK": "fail_on_weak"}


def with_config(repos: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Repositories with their gate flags, defaults where none are set."""
    flags = list(grades.GATE_DEFAULTS)
    if configs is None:
        return repos.withColumns({f: F.lit(grades.GATE_DEFAULTS[f]) for f in flags})
    joined = repos.join(configs.select("repo_id", *flags), "repo_id", "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(grades.GATE_DEFAULTS[f])) for f in flags})


def _flag(status: Column) -> Column:
    chosen = F.lit(False)
    for name, flag in _FLAG_OF.items():
        chosen = F.when(status == name, F.col(flag)).otherwise(chosen)
    return chosen


def evaluate(findings: DataFrame, repos: DataFrame, configs: DataFrame | None = None,
             enforce_risk: bool = False, listed_failures: int = MAX_FAILURES) -> DataFrame:
    """One row per repository: verdict, counts and the first failures.

    ``failure_count`` counts all failures.  The list shows the first
    ``listed_failures`` of them, so no more than that per repository and status
    leave the map side.  Only the status flags fail a gate; the risk flags
    switch counting, unless ``enforce_risk`` makes them count as failures too.
    """
    upper = findings.where(~F.col("archived") & F.col("migration_status").isin(OPEN)).withColumns({
        "status": F.upper(F.coalesce("quantum_status", F.lit(""))),
        "risk": F.upper(F.coalesce("risk_level", F.lit("")))})
    counts = upper.groupBy("repo_id").agg(
        count_if(F.col("status") == "BROKEN").alias("broken"),
        count_if(F.col("status") == "VULNERABLE").alias("vulnerable"),
        count_if(F.col("status") == "WEAK").alias("weak"),
        count_if(F.col("risk") == "CRITICAL").alias("critical"),
        count_if(F.col("risk") == "HIGH").alias("high"),
        F.count("*").alias("total"))
    gated = with_config(repos, configs)
    flags = gated.select("repo_id", *grades.GATE_DEFAULTS)
    failing = upper.where(F.col("status").isin(list(_FLAG_OF)))
    rank = g.status_rank(F.col("status"))
    order = ["algorithm", "file_path", "line_number"]
    few = limit_per(failing.select("repo_id", "status", *order), ["repo_id", "status"], listed_failures, *order)
    few = few.join(flags, "repo_id").where(_flag(F.col("status")))
    few = limit_per(few, ["repo_id"], listed_failures, rank, *order)
    message = F.concat(F.col("status"), F.lit(" finding: "), F.col("algorithm"), F.lit(" in "),
                       F.col("file_path"), F.lit(":"), F.col("line_number").cast("string"))
    listed = few.groupBy("repo_id").agg(F.sort_array(F.collect_list(
        F.struct(rank.alias("r"), *order, message.alias("message")))).alias("f")).select(
        "repo_id", F.col("f.message").alias("failures"))
    result = (gated.join(counts, "repo_id", "left").join(listed, "repo_id", "left")
              .na.fill(0, ["broken", "vulnerable", "weak", "critical", "high", "total"]))
    failures = F.coalesce("failures", F.array().cast("array<string>"))
    failing_of = [F.when(F.col(flag), F.col(status.lower())).otherwise(0) for status, flag in _FLAG_OF.items()]
    result = result.withColumns({
        "critical": F.when(F.col("fail_on_critical"), F.col("critical")).otherwise(0),
        "high": F.when(F.col("fail_on_high"), F.col("high")).otherwise(0),
        "failures": failures, "failure_count": failing_of[0] + failing_of[1] + failing_of[2]})
    passed = F.col("failure_count") == 0
    if enforce_risk:
        passed = passed & (F.col("critical") == 0) & (F.col("high") == 0)
    return result.withColumn("passed", passed).withColumn(
        "gate_status", F.when(F.col("passed"), "PASS").otherwise("FAIL"))


def totals(gates: DataFrame) -> DataFrame:
    """Repositories passing, failing (scanned ones only) and not scanned."""
    scanned = F.col("last_scanned_at").isNotNull()
    return gates.agg(
        F.count("*").alias("total"), F.coalesce(count_if(F.col("passed")), F.lit(0)).alias("passing"),
        F.coalesce(count_if(~F.col("passed") & scanned), F.lit(0)).alias("failing"),
        F.coalesce(count_if(~scanned), F.lit(0)).alias("not_scanned"))


def badges(gates: DataFrame) -> DataFrame:
    """(repo_id, badge): what a repository's badge says."""
    text = (F.when(F.col("last_scanned_at").isNull(), "not scanned").when(F.col("passed"), "passing")
            .otherwise(F.concat(F.lit("failing ("), F.col("failure_count").cast("string"), F.lit(")"))))
    return gates.select("repo_id", text.alias("badge"))
