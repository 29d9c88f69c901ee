from __future__ import annotations

import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from keyfathom.operators import bom, dependencies, gate, lifecycle, reports, runtime

FOUND = ("finding_id string, repo_id string, scan_run_id string, file_path string, algorithm string, migration_status string, "
         "resolution_note string, source_type string, archived boolean")
MISS = "Missed scan: old"
NOW = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("status, present, note, expected", [
    ("open", True, None, ("open", "run-2-abcdef", None)),
    ("open", True, MISS, ("open", "run-2-abcdef", None)),
    ("open", False, None, ("open", "run-1", "Missed scan: run-2-ab")),
    ("open", False, MISS, ("auto_resolved", "run-1", "Not detected in 2 consecutive scans")),
    ("re_opened", True, MISS, ("re_opened", "run-2-abcdef", None)),
    ("re_opened", False, None, ("re_opened", "run-1", None)),
    ("auto_resolved", True, None, ("open", "run-2-abcdef", "Re-introduced in latest scan")),
    ("auto_resolved", False, "x", ("auto_resolved", "run-1", "x")),
    ("manually_resolved", True, "x", ("re_opened", "run-2-abcdef", "Re-detected after manual resolution — please review")),
    ("manually_resolved", False, "x", ("manually_resolved", "run-1", "x")),
    ("false_positive", True, "x", ("false_positive", "run-1", "x")),
    ("false_positive", False, None, ("false_positive", "run-1", None)),
])
def test_reconcile(table, status, present, note, expected):
    old = table(FOUND, ("1", "r", "run-1", "a.py", "MD5", status, note, "source_code", False))
    new = table("repo_id string, file_path string, algorithm string", ("r", "a.py" if present else "b.py", "MD5"))
    runs = table("repo_id string, scan_run_id string", ("r", "run-2-abcdef"))
    got = lifecycle.reconcile(old, new, runs, F.lit(NOW)).first()
    assert (got.migration_status, got.scan_run_id, got.resolution_note) == expected
    assert lifecycle.untracked(old, new, runs).count() == (0 if present else 1)


def test_reconcile_leaves_others_alone(table):
    old = table(FOUND, ("1", "r", "run-1", "a", "MD5", "open", None, "artifact", False),
                ("2", "r", "run-1", "a", "MD5", "open", None, "source_code", True),
                ("3", "other", "run-1", "a", "MD5", "open", None, "source_code", False))
    new = table("repo_id string, file_path string, algorithm string", ("r", "z", "MD5"))
    runs = table("repo_id string, scan_run_id string", ("r", "run-2"))
    got = lifecycle.reconcile(old, new, runs, F.lit(NOW))
    assert {r.action for r in got.collect()} == {"unchanged"}


def test_gate_counts_but_passes_on_risk_alone(table):
    findings = table("repo_id int, algorithm string, file_path string, line_number int, quantum_status string, risk_level string, "
                     "migration_status string, archived boolean", (1, "AES-128", "a", 3, "MONITOR", "HIGH", "open", False))
    repos = table("repo_id int, last_scanned_at timestamp", (1, NOW), (2, None))
    got = {r.repo_id: r for r in gate.evaluate(findings, repos).collect()}
    assert (got[1].passed, got[1].high, got[1].total) == (True, 1, 1)
    assert got[2].passed
    strict = {r.repo_id: r.passed for r in gate.evaluate(findings, repos, enforce_risk=True).collect()}
    assert strict == {1: False, 2: True}


def test_gate_lists_at_most_twenty_of_a_hot_repository(table, spark):
    findings = spark.range(5000).select(
        F.lit(1).alias("repo_id"), F.lit("MD5").alias("algorithm"), F.lit("a").alias("file_path"),
        F.col("id").cast("int").alias("line_number"), F.lit("BROKEN").alias("quantum_status"),
        F.lit("CRITICAL").alias("risk_level"), F.lit("open").alias("migration_status"), F.lit(False).alias("archived"))
    got = gate.evaluate(findings, table("repo_id int, last_scanned_at timestamp", (1, NOW))).first()
    assert (got.broken, got.failure_count, len(got.failures), got.failures[0], got.gate_status) == (
        5000, 5000, 20, "BROKEN finding: MD5 in a:0", "FAIL")


def test_latest_runs_keep_ties(table):
    runs = table("scan_run_id string, repo_id int, status string, scan_type string, started_at int",
                 ("a", 1, "complete", "code", 5), ("b", 1, "complete", "artifact", 5), ("c", 1, "failed", "code", 9), ("d", 1, "complete", "code", 1))
    assert rows(bom.latest_runs(runs), "scan_run_id") == [("a",), ("b",)]
    assert rows(bom.latest_runs(runs, per_scan_type=True), "scan_run_id") == [("a",), ("b",)]


def test_inventory_metadata_of_unregistered_algorithm_is_the_worst(table):
    findings = table("scan_run_id string, repo_id int, algorithm string, algo_type string, quantum_status string, migration_status string, "
                     "archived boolean, source_type string, reachable boolean, call_depth int",
                     ("x", 1, "Odd", "Hash", "WEAK", "open", False, "source_code", False, 4),
                     ("x", 2, "Odd", "Hash", "BROKEN", "open", False, "artifact", True, 2),
                     ("x", 2, "Odd", "Hash", "SAFE", "auto_resolved", False, "artifact", True, 1))
    runs = table("scan_run_id string, repo_id int, status string, started_at int", ("x", 1, "complete", 1))
    got = bom.rebuild(findings, runs).first()
    assert (got.quantum_status, got.priority, got.total_usages, got.code_usages, got.artifact_usages, got.unreachable_count,
            got.min_call_depth, got.affected_repos) == ("BROKEN", 1, 2, 1, 1, 1, 2, 2)


@pytest.mark.parametrize("version, below, expected", [
    ("1.70", "1.70.0", True), ("", "2.0", True), ("2.4.0+local", "2.4.0", False), ("2.4.0", "2.4.0", False), ("9.9", None, True),
    ("10.0", "9.0", False), ("1.0-beta", "1.0", False), ("beta", "0.1", True), ("v2.3.9", "2.4", True)])
def test_versions(table, version, below, expected):
    row = table("v string, b string", (version, below))
    assert row.select(dependencies.is_vulnerable(F.col("v"), F.col("b")).alias("x")).first().x is expected


EVENTS = "host_id string, ts int, pid int, probe_id int, comm string"


def test_aggregate_and_unknown_probe(table):
    events = table(EVENTS, *[("h", i, 100, 0, "a") for i in range(3)], ("h", 9, 100, 1, "b"), ("h", 1, 1, 9999, "c"))
    got = runtime.resolve_probes(runtime.aggregate_events(events))
    assert rows(got, "algorithm", "occurrences") == [("MD5", 3), ("SHA-1", 1)]


def test_merge_of_undelivered_counts(table):
    batch = table("algorithm string, pid int, occurrences int, first_seen int, last_seen int", ("MD5", 1, 1, 5, 6), ("MD5", 1, 1, 3, 9))
    assert rows(runtime.merge(batch), "occurrences", "first_seen", "last_seen") == [(2, 3, 9)]


def test_upsert(table):
    schema = "host_id string, algorithm string, symbol string, process_name string, pid int, library string, occurrences int, first_seen int, last_seen int"
    old = table(schema, ("h", "MD5", "s", None, None, "lib", 5, 10, 20))
    new = table(schema, ("h", "MD5", "s", None, None, None, -3, 8, 15), ("h", "X", "t", "p", 1, "l2", 2, 1, 2))
    got = rows(runtime.upsert(old, new), "algorithm", "library", "occurrences", "first_seen", "last_seen")
    assert got == [("MD5", "lib", 5, 8, 15), ("X", "l2", 2, 1, 2)]
    graded = {r.algorithm: r for r in runtime.with_registry(runtime.upsert(old, new)).collect()}
    assert graded["X"].quantum_status is None and graded["X"].quantum_safe is False
    assert graded["MD5"].risk_level == "CRITICAL"


def test_probe_table_is_consistent(spark):
    probes = runtime.probes(spark).collect()
    assert len({p.probe_id for p in probes}) == len(probes) == 18
    assert {p.library for p in probes} == {"libcrypto", "libssl", "liboqs"}


def test_migration_progress_rounds_half_to_even(table):
    rows_ = [("MD5", "CRITICAL", "BROKEN", "open" if i else "auto_resolved", False) for i in range(8)]
    findings = table("algorithm string, risk_level string, quantum_status string, migration_status string, archived boolean", *rows_)
    got = reports.migration_stats(findings).first()
    assert (got.total, got.resolved, got.progress_pct) == (8, 1, 12)
