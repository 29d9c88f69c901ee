"""Tables from scan to scan: one exchange, replaced dependencies, secrets and CVE records."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F
from tests.conftest import rows

from keyfathom import schemas
from keyfathom.operators import lifecycle
from keyfathom.plans import scans

T0 = dt.datetime(2024, 1, 1)
OLD = ("finding_id long, scan_run_id string, repo_id string, file_path string, algorithm string, migration_status string, "
       "resolution_note string, source_type string, archived boolean, resolved_at timestamp, resolved_by string")
NEW = "repo_id string, file_path string, algorithm string, line_number int"


def some(spark, seed):
    chance = random.Random(seed)
    old = [(n, chance.choice("012"), chance.choice("abc"), f"p{chance.randrange(6)}", chance.choice(["MD5", "RC4"]),
            chance.choice(["open", "re_opened", "auto_resolved", "manually_resolved", "false_positive"]),
            chance.choice([None, "Missed scan: 1", "x"]), chance.choice(["source_code", "source_code", "dependency"]),
            chance.random() < 0.2, T0, "u") for n in range(300)]
    new = [(chance.choice("ab"), f"p{chance.randrange(8)}", chance.choice(["MD5", "RC4", "DES"]), chance.randrange(5)) for _ in range(40)]
    return (spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW),
            spark.createDataFrame([("a", "2"), ("b", "9")], "repo_id string, scan_run_id string"))


def test_one_step_is_both(spark):
    for seed in (1, 2):
        old, new, runs = some(spark, seed)
        step = lifecycle.scan_step(old, new, runs, F.lit(T0))
        kept = step.where("action <> 'new'")
        assert rows(kept) == rows(lifecycle.reconcile(old, new, runs, F.lit(T0)))
        keys = ["repo_id", "file_path", "algorithm"]
        assert rows(step.where("action = 'new'"), *keys) == rows(lifecycle.untracked(old, new, runs), *keys)
        plan = step.select("finding_id", "action", "scan_run_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Window") // 2 or "Window" in plan
        assert rows(kept.where("repo_id = 'c'"), *old.columns) == rows(old.where("repo_id = 'c'"))


def test_one_exchange_of_findings(spark):
    old, new, runs = some(spark, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lifecycle.reconcile(old, new, runs, F.lit(T0))._jdf.queryExecution().executedPlan().toString()
        # old rows by pair, and the new pairs; the runs are broadcast and other rows stay
        assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" in plan and "repo_id" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scan_of(table, code, packages, secrets):
    from keyfathom.operators import dependencies
    code = table("repo_id string, file_path string, line_number int, algorithm string, source_type string, risk_level string", *code)
    deps = dependencies.dependency_findings(table(
        "repo_id string, manifest string, ord int, ecosystem string, name string, version string", *packages))
    hidden = table("repo_id string, file_path string, line_number int, finding_type string, algorithm string, key_size int, curve string, "
                   "config_key string, config_value string, quantum_status string, risk_level string, nist_replacement string, context string", *secrets)
    return scans.RepositoryScan(code=code, dependencies=deps, cves=dependencies.curated_cves(deps), secrets=hidden,
                                agility=None, risk=None, stats=None)


def secret(repo, line):
    return (repo, "id_rsa", line, "SSH_PRIVATE_KEY", "RSA", None, None, None, None, "VULNERABLE", "HIGH", None, "k")


def test_two_scans(spark, table):
    findings, secrets, cves = (spark.createDataFrame([], s) for s in (schemas.FINDINGS, schemas.SECRETS, schemas.CVES))
    runs = table("repo_id string, scan_run_id string", ("r", "1"), ("q", "1"))
    scan = scan_of(table, [("r", "a.py", 1, "MD5", "source_code", "HIGH"), ("q", "a.py", 1, "MD5", "source_code", "HIGH")],
                   [("r", "req.txt", 0, "pypi", "python-jose", "1.0"), ("q", "req.txt", 0, "pypi", "python-jose", "1.0")],
                   [secret("r", 1), secret("r", 2), secret("q", 1)])

    def stored(*tables):  # as written and read again
        return [spark.createDataFrame(t.collect(), t.schema) for t in tables]

    def after():
        return stored(scans.next_findings(findings, scan, runs, F.lit(T0)), scans.next_secrets(secrets, scan, runs),
                      scans.next_cves(cves, findings, scan, runs))

    findings, secrets, cves = after()
    assert rows(findings, "repo_id", "scan_run_id", "source_type", "migration_status") == [
        ("q", "1", "dependency", "open"), ("q", "1", "source_code", "open"), ("r", "1", "dependency", "open"), ("r", "1", "source_code", "open")]
    assert rows(cves.join(findings, "finding_id"), "repo_id", "cve_id") == [("q", "CVE-2022-29217"), ("r", "CVE-2022-29217")]
    assert rows(secrets, "repo_id", "scan_run_id", "line_number") == [("q", "1", 1), ("r", "1", 1), ("r", "1", 2)]

    runs = table("repo_id string, scan_run_id string", ("r", "2"))
    scan = scan_of(table, [("r", "b.py", 3, "RC4", "source_code", "HIGH")], [("r", "req.txt", 0, "pypi", "pyjwt", "1.0")], [secret("r", 2)])
    findings, secrets, cves = after()
    assert rows(findings, "repo_id", "scan_run_id", "algorithm", "source_type", "resolution_note") == [
        ("q", "1", "JWT-RS256", "dependency", None), ("q", "1", "MD5", "source_code", None), ("r", "1", "MD5", "source_code", "Missed scan: 2"),
        ("r", "2", "JWT-RS256", "dependency", None), ("r", "2", "RC4", "source_code", None)]
    assert rows(cves.join(findings, "finding_id"), "repo_id", "cve_id") == [("q", "CVE-2022-29217")] and cves.count() == 1
    assert rows(secrets, "repo_id", "scan_run_id", "line_number") == [("q", "1", 1), ("r", "2", 2)]
    assert findings.select("finding_id").distinct().count() == 5 and secrets.select("secret_id").distinct().count() == 2
