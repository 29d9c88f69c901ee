"""Reading inputs: files, manifests, events, reports, advisories, webhooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom import schemas
from keyfathom.functions import paths
from keyfathom.functions.text import decode_text


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``; the first folder level names the repository."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    return files.select(
        F.substring_index(relative, "/", 1).alias("repo_id"),
        F.regexp_replace(relative, "^[^/]+/", "").alias("file_path"), "length", "content")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo_id, file_path, content) of every scannable file; others are never opened."""
    tree = _tree(spark, root).where(paths.is_source_file(F.col("file_path")))
    return tree.select("repo_id", "file_path", decode_text(F.col("content")).alias("content"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The same for dependency manifests."""
    tree = _tree(spark, root).where(paths.is_manifest(F.col("file_path")))
    return tree.select("repo_id", "file_path", decode_text(F.col("content")).alias("content"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(artifact_id, artifact_name, content bytes) of uploaded packages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.sha2("path", 256).alias("artifact_id"),
                        F.substring_index("path", "/", -1).alias("artifact_name"), "content")


def runtime_reports(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Reports of runtime agents, one JSON object per host and interval."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.RUNTIME_REPORT).json(path)


def reported_findings(reports: DataFrame) -> DataFrame:
    """One row per reported finding; missing times are the time of receipt."""
    rows = reports.select("host_id", "received_at", F.inline("findings"))
    return rows.withColumns({"first_seen": F.coalesce("first_seen", "received_at"),
                             "last_seen": F.coalesce("last_seen", "received_at")})


def raw_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw call events with nanosecond stamps as (host_id, ts, pid, probe_id, comm)."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(schemas.RAW_EVENTS).parquet(path)
    return rows.select("host_id", F.timestamp_micros(F.expr("timestamp_ns div 1000")).alias("ts"),
                       "pid", "probe_id", "comm")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ADVISORIES).json(path)


def tls_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TLS_OBSERVATIONS).parquet(path)


def webhook_events(deliveries: DataFrame) -> DataFrame:
    """Branch and commit of webhook bodies, in either provider's shape."""
    body = F.col("body")
    branch = F.replace(F.coalesce(F.get_json_object(body, "$.ref"), F.lit("")), F.lit("refs/heads/"), F.lit(""))
    github = F.coalesce(F.nullif(F.get_json_object(body, "$.after"), F.lit("")),
                        F.get_json_object(body, "$.head_commit.id"))
    gitlab = F.get_json_object(body, "$.commits[0].id")
    provider = F.col("provider")
    known = provider.isin("github", "gitlab")
    return deliveries.select(
        *[c for c in deliveries.columns if c != "body"],
        F.when(known, branch).alias("branch"),
        F.when(provider == "github", github).when(provider == "gitlab", gitlab).alias("commit_sha"))
