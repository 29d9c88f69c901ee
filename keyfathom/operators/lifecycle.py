"""Following findings from scan to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions.groups import first_per

PAIR = ["repo_id", "file_path", "algorithm"]
OPEN = ["open", "re_opened"]
RESOLVED = ["auto_resolved", "manually_resolved"]

# ---- FIXED VALUES: texts stored with findings ---------------------------------

MISSED = "Missed scan:"
NOTE_GONE = "Not detected in 2 consecutive scans"
NOTE_BACK = "Re-introduced in latest scan"
NOTE_REVIEW = "Re-detected after manual resolution — please review"
TEST_PATH_TEXT = (
    "This file's path matches common test/fixture/example/vendor patterns, so this "
    "crypto usage is unlikely to represent production risk. Review before confirming.")
TEST_AND_DEAD_TEXT = TEST_PATH_TEXT + (
    " In addition, static call graph analysis found no path from any known entry point to this "
    "function — the crypto usage is very likely test-only or dead code.")
DEAD_TEXT = (
    "Static call graph analysis found no path from any known entry point to this function. "
    "The crypto usage may be dead code or test-only. Review before confirming.")
TEST_PATH_CONFIDENCE = 0.65
DEAD_CONFIDENCE = 0.75
TEST_AND_DEAD_CONFIDENCE = 0.85

# ---- END OF FIXED VALUES ------------------------------------------------------


def _missed_before() -> Column:
    return F.coalesce(F.startswith("resolution_note", F.lit(MISSED)), F.lit(False))


#: Runs of one scan that are sent to every task, at most; a row of them is two ids.
BROADCAST_RUNS = 500_000


def _marked(existing: DataFrame, runs: DataFrame) -> DataFrame:
    """Existing rows with the run of their repository, and whether the run has a say about them.

    Few runs, as all but the largest scans have, are broadcast, so that no row of the table moves.
    """
    marks = runs.select("repo_id", F.col("scan_run_id").alias("_run"))
    if marks.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        marks = F.broadcast(marks)
    eligible = (F.col("_run").isNotNull() & ~F.col("archived")
                & (F.col("source_type") == "source_code") & (F.col("scan_run_id") != F.col("_run")))
    return existing.join(marks, "repo_id", "left").withColumn("_eligible", F.coalesce(eligible, F.lit(False)))


def _decided(rows: DataFrame, as_of: Column) -> DataFrame:
    """Eligible rows after the scan, from `_run` and `_present`, with an `action`."""
    seen = F.col("_present")
    status = F.col("migration_status")
    gone = ~seen & (status == "open")
    action = (F.when(seen & status.isin(OPEN), "still_present")
              .when(gone & _missed_before(), "auto_resolved")
              .when(gone, "missed_once")
              .when(seen & (status == "auto_resolved"), "reintroduced")
              .when(seen & (status == "manually_resolved"), "needs_review")
              .otherwise("unchanged"))
    decided = rows.withColumn("action", action)
    act = F.col("action")
    back = act.isin("reintroduced", "needs_review")
    miss_note = F.concat(F.lit(MISSED + " "), F.left(F.col("_run").cast("string"), F.lit(8)))
    changes = {
        "migration_status": F.when(act == "auto_resolved", "auto_resolved")
        .when(act == "reintroduced", "open").when(act == "needs_review", "re_opened").otherwise(status),
        "scan_run_id": F.when(back | (act == "still_present"), F.col("_run"))
        .otherwise(F.col("scan_run_id")),
        "resolution_note": F.when(act == "missed_once", miss_note)
        .when(act == "auto_resolved", NOTE_GONE).when(act == "reintroduced", NOTE_BACK)
        .when(act == "needs_review", NOTE_REVIEW).when(act == "still_present", None)
        .otherwise(F.col("resolution_note")),
    }
    if "resolved_at" in rows.columns:
        changes["resolved_at"] = (F.when(act == "auto_resolved", as_of).when(back, None)
                                  .otherwise(F.col("resolved_at")))
    if "resolved_by" in rows.columns:
        changes["resolved_by"] = (F.when(act == "auto_resolved", "scanner").when(back, None)
                                  .otherwise(F.col("resolved_by")))
    return decided.withColumns(changes)


def reconcile(existing: DataFrame, new_findings: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Existing findings after one more scan of the repositories in ``runs``.

    ``runs(repo_id, scan_run_id)`` names the scan of each scanned repository and
    ``new_findings`` holds what those scans found.  Rows of other repositories,
    archived rows and rows that do not come from source code pass through and are not
    moved; the others are, once.  An ``action`` column tells what happened.
    """
    marked = _marked(existing, runs)
    present = new_findings.select(*PAIR).distinct().withColumn("_found", F.lit(True))
    judged = marked.where("_eligible").join(present, PAIR, "left").withColumn("_present", F.col("_found").isNotNull())
    columns = [*existing.columns, "action"]
    passed = marked.where("NOT _eligible").withColumn("action", F.lit("unchanged"))
    return _decided(judged, as_of).select(columns).unionByName(passed.select(columns))


def untracked(existing: DataFrame, new_findings: DataFrame, runs: DataFrame) -> DataFrame:
    """New findings whose (repo, path, algorithm) no earlier source finding covers."""
    tracked = _marked(existing, runs).where("_eligible").select(*PAIR)
    return new_findings.join(tracked, PAIR, "left_anti")


def scan_step(existing: DataFrame, new_findings: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """What reconcile and untracked give, from one exchange: old and new rows meet by pair.

    All existing rows after the scan, and the new findings that none of them covers with the action "new" and
    nulls where they lack a column of `existing`.  Pairs with a null in them are no pairs.
    """
    marked = _marked(existing, runs)
    shared = [c for c in existing.columns if c in new_findings.columns and c != "scan_run_id"]
    both = marked.where("_eligible").select(*existing.columns, "_run", F.lit(True).alias("_old")).unionByName(
        new_findings.select(*shared, F.lit(False).alias("_old")), allowMissingColumns=True)
    whole = F.lit(True)
    for c in PAIR:
        whole = whole & F.col(c).isNotNull()
    pair = Window.partitionBy(*PAIR)
    met = both.withColumns({"_present": F.max(~F.col("_old")).over(pair) & whole, "_tracked": F.max("_old").over(pair) & whole})
    columns = [*existing.columns, "action"]
    return (_decided(met.where("_old"), as_of).select(columns)
            .unionByName(met.where("NOT _old AND NOT _tracked").withColumn("action", F.lit("new")).select(columns))
            .unionByName(marked.where("NOT _eligible").withColumn("action", F.lit("unchanged")).select(columns)))


def still_present(existing: DataFrame, new_findings: DataFrame) -> DataFrame:
    """Distinct (repo, path, algorithm) found before and found again."""
    return (existing.where(~F.col("archived")).select(*PAIR).distinct()
            .join(new_findings.select(*PAIR), PAIR, "left_semi"))


def newest_of_duplicates(findings: DataFrame) -> DataFrame:
    """Keep the newest non-archived row of each pair; archived rows all stay."""
    active = first_per(findings.where(~F.col("archived")), PAIR,
                       F.col("created_at").desc(), F.col("finding_id"))
    return active.unionByName(findings.where(F.col("archived")))


def change_status(findings: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Apply ``updates(finding_id, status, resolved_by, resolution_note, migrated_to)``.

    Updates to a status nobody may set are ignored.
    """
    allowed = updates.where(F.col("status").isin(grades.SETTABLE_STATUSES)).select(
        "finding_id", F.col("status").alias("_status"), F.col("resolved_by").alias("_by"),
        F.col("resolution_note").alias("_note"), F.col("migrated_to").alias("_to"))
    joined = findings.join(allowed, "finding_id", "left")
    changed = F.col("_status").isNotNull()
    closed = F.contains("_status", F.lit("resolved")) | (F.col("_status") == "false_positive")
    new_values = {
        "migration_status": F.col("_status"),
        "resolved_by": F.col("_by"),
        "resolution_note": F.col("_note"),
        "migrated_to": F.col("_to"),
        "resolved_at": F.when(closed, as_of),
    }
    def previous(c: str) -> Column:
        if c in findings.columns:
            return F.col(c)
        return F.lit(None).cast("timestamp" if c == "resolved_at" else "string")

    return joined.withColumns({
        c: F.when(changed, v).otherwise(previous(c)) for c, v in new_values.items()
    }).drop("_status", "_by", "_note", "_to")


def set_archived(rows: DataFrame, ids: DataFrame, archived: bool, as_of: Column,
                 by: str | None = None, key: str = "finding_id") -> DataFrame:
    """Archive (or restore) the rows named in ``ids``."""
    named = ids.select(key).distinct().withColumn("_named", F.lit(True))
    joined = rows.join(named, key, "left")
    hit = F.col("_named").isNotNull()
    changes = {"archived": F.when(hit, F.lit(archived)).otherwise(F.col("archived"))}
    if "archived_at" in rows.columns:
        changes["archived_at"] = F.when(hit, as_of if archived else None).otherwise(F.col("archived_at"))
    if "archived_by" in rows.columns:
        changes["archived_by"] = F.when(hit, F.lit(by) if archived else None).otherwise(F.col("archived_by"))
    return joined.withColumns(changes).drop("_named")


def archive_resolved(findings: DataFrame) -> DataFrame:
    """Archive every resolved finding; ``newly_archived`` marks what changed."""
    newly = ~F.col("archived") & F.col("migration_status").isin(RESOLVED)
    return findings.withColumn("newly_archived", newly).withColumn(
        "archived", F.col("archived") | F.col("newly_archived"))


def suggest_false_positives(findings: DataFrame) -> DataFrame:
    """Label findings that are probably harmless, from path class and reachability.

    Rows a reviewer or model has already validated are left alone.
    """
    fresh = ~F.coalesce(F.col("ai_validated"), F.lit(False)) & (F.col("source_type") == "source_code")
    in_test = F.coalesce(F.col("in_test_path"), F.lit(False))
    dead = F.coalesce(~F.col("reachable"), F.lit(False))
    confidence = (F.when(in_test & dead, TEST_AND_DEAD_CONFIDENCE).when(dead, DEAD_CONFIDENCE)
                  .when(in_test, TEST_PATH_CONFIDENCE))
    explanation = F.when(in_test & dead, TEST_AND_DEAD_TEXT).when(dead, DEAD_TEXT).when(in_test, TEST_PATH_TEXT)
    suspect = fresh & (in_test | dead)
    return findings.select(
        *[c for c in findings.columns if c not in ("ai_label", "ai_confidence", "ai_explanation")],
        F.when(suspect, "false_positive").otherwise(_or_null(findings, "ai_label")).alias("ai_label"),
        F.when(suspect, confidence).otherwise(_or_null(findings, "ai_confidence", "double")).alias("ai_confidence"),
        F.when(suspect, explanation).otherwise(_or_null(findings, "ai_explanation")).alias("ai_explanation"))


def _or_null(rows: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in rows.columns else F.lit(None).cast(kind)
