"""Joins that a hot key does not slow down."""

from __future__ import annotations

from itertools import groupby

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tests.conftest import rows

from keyfathom.functions import groups
from keyfathom.functions.groups import join_each, partitions
from keyfathom.operators import callgraph, dependencies
from keyfathom.sinks import exports


def test_small_and_large_tables_give_the_same(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    small = left.select("key").distinct().where("key <> '5'").withColumn("n", F.length("key"))
    for how in ("inner", "left"):
        plain = left.join(small, "key", how)
        assert rows(join_each(left, small, "key", how), "id", "n") == rows(plain, "id", "n")
        salted = join_each(left, small, "key", how, most=10)
        assert rows(salted, "id", "n") == rows(plain, "id", "n") and salted.columns == plain.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_each(left, small, "key")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert "_salt" in join_each(left, small, "key", most=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_copies_of_one_location(spark, table):
    cbom = table("algorithm string, algo_type string, quantum_status string, nist_replacement string, priority int, total_usages long, affected_repos long",
                 ("MD5", "Hash", "BROKEN", "x", 1, 3, 1))
    places = spark.range(10_000).select(F.lit("MD5").alias("algorithm"), F.lit("a#L1").alias("location"))
    lines = exports.cyclonedx_lines(cbom, places, "app", "urn:uuid:1", "2024-01-01T00:00:00+00:00")
    copies = [r.copy for r in lines.where("sub = 1").select("copy").collect()]
    assert copies == list(range(1, 10_001))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_findings_of_one_package_do_not_meet_in_one_task(spark, table):
    findings = spark.range(2000).selectExpr("id AS finding_id", "'dependency' AS source_type", "false AS archived",
                                            "if(id % 50 = 0, 'Left', 'PyJWT') AS dependency_name", "'pypi' AS ecosystem")
    told = table("id string, ecosystem string, package string, summary string, details string, aliases array<string>, severity array<string>",
                 *[(f"A{n}", "PyPI", "pyjwt", "jwt check", None, [], ["7.5"]) for n in range(5)],
                 ("B", "PyPI", "left", "rsa", "", [], []), ("C", "npm", "pyjwt", "rsa", "", [], []))
    got = dependencies.backfill_cves(findings, table("finding_id long", (1,), (1,), (50,), (None,)), told)
    expected = [(n, f"A{k}") for n in range(2000) if n % 50 and n != 1 for k in range(5)] + [(n, "B") for n in range(0, 2000, 50) if n != 50]
    assert rows(got, "finding_id", "cve_id") == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))
    tasks = got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(tasks) == partitions(spark) and max(r["count"] for r in tasks) < len(expected) / 2


def test_records_of_many_pairs_are_short_on_disk(spark, tmp_path, monkeypatch):
    """Each finding has a record of each advisory; whether these are broadcast or dealt, records of one advisory follow each other."""
    findings = spark.range(1600).select(
        F.when(F.col("id") > 2, F.col("id") - F.col("id") % 2).alias("finding_id"), F.lit("dependency").alias("source_type"),
        F.lit(False).alias("archived"), F.lit("PyPI").alias("ecosystem"), F.lit("Lib").alias("dependency_name"))
    told = spark.range(100).select(
        F.format_string("ADV-%s", F.xxhash64("id")).alias("id"), F.lit("PyPI").alias("ecosystem"), F.lit("lib").alias("package"),
        F.lit("rsa key").alias("summary"), F.lit("").alias("details"), F.array().cast("array<string>").alias("aliases"),
        F.array(F.concat((F.col("id") % 10).cast("string"), F.lit(".5"))).alias("severity"))
    cves = spark.range(100).select((F.col("id") * 2).alias("finding_id"))
    findings = findings.withColumn("ecosystem", F.lower("ecosystem"))
    left = findings.where("finding_id is null or finding_id >= 200").count()
    for most in (200_000, 10):
        monkeypatch.setattr(groups, "BROADCAST_ROWS", most)
        path = tmp_path / str(most)
        dependencies.backfill_cves(findings, cves, told).select("finding_id", "cve_id", "cvss_severity").write.parquet(str(path))
        got = spark.read.parquet(str(path))
        per = got.groupBy("finding_id").agg(F.count("*").alias("n"), F.countDistinct("cve_id").alias("d")).collect()
        assert {r.finding_id: r.n for r in per} == {None: 300} | {k: 200 for k in range(200, 1600, 2)}
        assert all(r.d == 100 for r in per) and got.count() == left * 100
        runs = sum(1 for f in path.glob("*.parquet") for _ in groupby(pq.read_table(f).column("cve_id").to_pylist()))
        assert runs < left * 100 / 8


def test_rows_that_a_join_makes_many_are_dealt_to_all_tasks(spark):
    left = spark.range(900).select("id", (F.col("id") % 3).alias("key"), F.lit("x").alias("kind"))
    small = spark.range(90).select((F.col("id") % 3).alias("key"), F.lit("x").alias("kind"), F.col("id").alias("n"))
    dealt, coalesced = (join_each(left, small, ["kind", "key"], most=10, deal=deal) for deal in (True, False))
    assert rows(dealt, "key", "id", "n") == rows(coalesced, "key", "id", "n") and dealt.columns == coalesced.columns
    assert len(dealt.select(F.spark_partition_id().alias("p")).distinct().collect()) > partitions(spark) / 2


def test_functions_are_dealt_before_they_are_cut(spark):
    functions = spark.range(4000, numPartitions=1).selectExpr(
        "0 AS repo_id", "'a.py' AS file_path", "id AS func_id", "CAST(id * 10 + 1 AS INT) AS start_line", "CAST(id * 10 + 9 AS INT) AS end_line")
    lines = spark.range(100).selectExpr("0 AS repo_id", "'a.py' AS file_path", "CAST(id AS INT) AS line_number")
    found = callgraph.enclosing_functions(lines, functions)
    assert rows(found, "line_number", "func_id") == sorted(((n, n // 10) for n in range(100) if n % 10), key=lambda r: tuple((True, str(v)) for v in r))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cut = plan[plan.index("Generate inline(concat("):]
    assert "RepartitionByExpression" in cut[:cut.index("Range")]
