"""Writing the inventory: CSV, CycloneDX JSON, flat JSON, replaced partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import grades as g
from keyfathom.functions import paths
from keyfathom.functions.groups import join_each
from keyfathom.operators.bom import reportable
from keyfathom.session import checkpoint_dir

#: Repeats of a location that are written out in one go.
LOT = 4096
CSV_COLUMNS = ["algorithm", "type", "quantum_status", "risk_level", "nist_replacement", "repo", "file_path",
               "line_number", "source_url", "source", "migration_status", "total_usages", "affected_repos"]


def inventory_rows(findings: DataFrame, repos: DataFrame, cbom: DataFrame,
                   secrets: DataFrame | None = None) -> DataFrame:
    """One row per location in the column order of the CSV export."""
    checkpoint_dir(findings.sparkSession)
    where = repos.select("repo_id", F.col("name").alias("repo"), "url", "branch")
    meta = cbom.select("algorithm", "total_usages", "affected_repos").checkpoint()  # a row per algorithm
    nist = F.col("nist_replacement") if "nist_replacement" in findings.columns else F.lit("")
    code = reportable(findings).select(
        "repo_id", "algorithm", F.col("algo_type").alias("type"), "quantum_status", "risk_level",
        F.coalesce(nist, F.lit("")).alias("nist_replacement"), "file_path",
        F.nullif("line_number", F.lit(0)).alias("line_number"), F.lit("code").alias("source"),
        F.coalesce("migration_status", F.lit("open")).alias("migration_status"))
    if secrets is not None:
        code = code.unionByName(reportable(secrets).select(
            "repo_id", "algorithm", F.col("finding_type").alias("type"), "quantum_status", "risk_level",
            F.coalesce("nist_replacement", F.lit("")).alias("nist_replacement"), "file_path",
            F.lit(None).cast("int").alias("line_number"), F.lit("secret").alias("source"),
            F.lit("open").alias("migration_status")))
    url = paths.blob_url(F.col("url"), F.col("branch"), F.col("file_path"), F.col("line_number"))
    placed = join_each(join_each(code, where, "repo_id"), meta, "algorithm", "left")
    return placed.withColumn("source_url", url).select(*CSV_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files of even size, each with a header."""
    rows.hint("rebalance").write.mode("overwrite").option("header", "true").csv(path)


def scan_rows(findings: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """The eight columns of an ad-hoc scan's CSV and JSON output."""
    blank = F.lit("")
    rows = findings.select(
        F.lit("code").alias("source"), F.col("file_path").alias("file"), F.col("line_number").alias("line"),
        "algorithm", F.col("algo_type").alias("type"), "risk_level", "quantum_status",
        F.coalesce("nist_replacement", blank).alias("nist_replacement"))
    if secrets is None:
        return rows
    return rows.unionByName(secrets.select(
        F.lit("secret").alias("source"), F.col("file_path").alias("file"), F.lit(None).cast("int").alias("line"),
        "algorithm", F.col("finding_type").alias("type"), F.coalesce("risk_level", blank).alias("risk_level"),
        F.coalesce("quantum_status", blank).alias("quantum_status"),
        F.coalesce("nist_replacement", blank).alias("nist_replacement")))


def scan_evidence(findings: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """(algorithm, location) of an ad-hoc scan: ``path#line`` or the bare path."""
    rows = findings.select("algorithm", F.concat_ws("#", "file_path", F.col("line_number").cast("string")).alias("location"))
    return rows if secrets is None else rows.unionByName(
        secrets.select("algorithm", F.col("file_path").alias("location")))


def component_head(cbom: DataFrame) -> Column:
    """A component's JSON without its closing brace and without evidence."""
    counts = [F.col(c).alias(f"x-{c.replace('_', '-')}") for c in ("total_usages", "affected_repos")
              if c in cbom.columns]
    body = F.to_json(F.struct(
        F.lit("cryptographic-asset").alias("type"), F.sha2("algorithm", 256).alias("bom-ref"),
        F.col("algorithm").alias("name"),
        F.struct(F.col("algo_type").alias("assetType"), F.struct(
            g.nist_level(F.col("quantum_status")).alias("nistQuantumSecurityLevel")
        ).alias("algorithmProperties")).alias("cryptoProperties"),
        F.col("quantum_status").alias("x-pqc-status"),
        F.col("nist_replacement").alias("x-nist-replacement"), *counts), {"ignoreNullFields": "false"})
    return F.regexp_replace(body, r"\}\z", "")


def cyclonedx_lines(cbom: DataFrame, evidence: DataFrame, application: str, serial: str, timestamp: str) -> DataFrame:
    """A CycloneDX 1.5 document as lines (line) in document order.

    An algorithm may have more locations than one task can hold, so they are
    never gathered: each location is its own line, and a sort brings the lines
    into place.  Only the first location of an algorithm, which takes no comma,
    is told apart, by an aggregate.  Locations are counted once and checkpointed;
    what is known of an algorithm comes to them, not they to it.
    """
    checkpoint_dir(cbom.sparkSession)
    places = evidence.groupBy("algorithm", "location").agg(F.count("*").alias("copies")).checkpoint()
    first = places.groupBy("algorithm").agg(F.min("location").alias("first"))
    heads = cbom.withColumn("head", component_head(cbom)).join(first, "algorithm", "left")
    lowest = cbom.orderBy("priority", "algorithm").limit(1).select("algorithm", F.lit(True).alias("_first"))
    comma = F.when(F.col("_first"), "").otherwise(",")
    opened = heads.join(lowest, "algorithm", "left")
    has = F.col("first").isNotNull()
    open_line = F.concat(comma, F.col("head"), F.when(has, F.lit(',"evidence":{"occurrences":[')).otherwise(""))
    order = [F.lit(1).alias("part"), F.col("priority"), F.col("algorithm")]
    lines = opened.select(*order, F.lit(0).alias("sub"), F.lit("").alias("location"), F.lit(0).alias("copy"), open_line.alias("line"))
    where = F.to_json(F.struct("location"))
    # repeats of one location are counted, then written out again
    known = heads.select("algorithm", "priority", "first").checkpoint()
    placed = join_each(places, known, "algorithm").withColumn(
        "_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT))))
    placed = placed.withColumn("copy", F.explode(F.sequence(
        (F.col("_lot") * LOT + 1).cast("int"), F.least("copies", (F.col("_lot") + 1) * LOT).cast("int"))))
    lead = F.when((F.col("location") == F.col("first")) & (F.col("copy") == 1), "").otherwise(",")
    lines = lines.unionAll(placed.select(*order, F.lit(1), "location", "copy", F.concat(lead, where)))
    lines = lines.unionAll(heads.select(*order, F.lit(2), F.lit(""), F.lit(0), F.when(has, "]}}").otherwise("}")))
    spark = cbom.sparkSession
    head = F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"),
        F.lit(serial).alias("serialNumber"), F.struct(F.lit(timestamp).alias("timestamp"), F.struct(
            F.lit("application").alias("type"), F.lit(application).alias("name")).alias("component")
        ).alias("metadata")))
    prefix = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"components":['))
    one = spark.range(1)
    ends = one.select(F.lit(0), F.lit(0), F.lit(""), F.lit(0), F.lit(""), F.lit(0), prefix).unionAll(
        one.select(F.lit(2), F.lit(0), F.lit(""), F.lit(0), F.lit(""), F.lit(0), F.lit("]}")))
    return lines.unionAll(ends).orderBy("part", "priority", "algorithm", "sub", "location", "copy")


def write_cyclonedx(lines: DataFrame, path: str) -> None:
    """Text files that, read in name order, are one JSON document."""
    lines.select("line").write.mode("overwrite").text(path)


def replace_partitions(rows: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Write rows over the partitions they belong to, leaving all others as they are.

    A repository whose new result is empty keeps its old rows here; use
    :func:`full_replace` and a new table version where that can happen.
    """
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def full_replace(existing: DataFrame, new_rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Table contents after the scanned repositories' rows are replaced.

    Also right for a scanned repository that has no rows any more.
    """
    kept = existing.join(scanned.select("repo_id").distinct(), "repo_id", "left_anti")
    return kept.unionByName(new_rows, allowMissingColumns=True)
