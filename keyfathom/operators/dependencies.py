"""Vulnerable cryptography brought in by dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfathom.dims import packages as dim
from keyfathom.functions import grades as g
from keyfathom.functions.groups import first_per, join_each, partitions, spread
from keyfathom.operators.detect import unnest
from keyfathom.session import checkpoint_dir, small_table

_NUMBER = "decimal(38,0)"
#: Findings that meet an advisory at once, so that its columns repeat for as many rows.
MEET_AT_ONCE = 256


def version_key(version: Column) -> Column:
    """Version as an array of numbers; arrays compare element by element.

    Local and pre-release parts are cut off, other text is dropped, and a
    version without numbers counts as 0.
    """
    cut = F.substring_index(F.substring_index(version, "+", 1), "-", 1)
    parts = F.filter(F.split(F.regexp_replace(cut, "[^0-9.]", ""), "\\."), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.cast(_NUMBER))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0).cast(_NUMBER)))


def is_vulnerable(version: Column, vulnerable_below: Column) -> Column:
    """Without a threshold or a pinned version the answer is yes."""
    return (F.when(F.coalesce(vulnerable_below, F.lit("")) == "", True)
            .when(F.coalesce(version, F.lit("")) == "", True)
            .otherwise(version_key(version) < version_key(vulnerable_below)))


def curated_packages(packages: DataFrame) -> DataFrame:
    """Packages that join the built-in list of 44 and are old enough to matter."""
    spark = packages.sparkSession
    listed = small_table(spark, dim.CURATED_PACKAGES, dim.COLUMNS).withColumnRenamed("name", "_name")
    eco = F.lower("ecosystem")
    joined = packages.withColumn("ecosystem", eco).join(
        F.broadcast(listed.withColumnRenamed("ecosystem", "_eco")),
        (F.col("ecosystem") == F.col("_eco")) & (F.lower("name") == F.col("_name")))
    return joined.where(is_vulnerable(F.col("version"), F.col("vulnerable_below"))).drop("_eco", "_name")


def dependency_findings(packages: DataFrame, keys: list[str] = ["repo_id"]) -> DataFrame:
    """One finding per manifest and package, the first mention winning.

    ``packages(keys, manifest, ord, ecosystem, name, version)``.
    """
    hits = curated_packages(packages).withColumn("_name", F.lower("name"))
    once = first_per(hits, [*keys, "manifest", "_name"], "ord").drop("_name")
    shown = F.when(F.col("version") != "", F.concat(F.lit("=="), F.col("version"))).otherwise(" (unpinned)")
    context = F.concat(F.lit("Dependency: "), F.col("name"), shown, F.lit("\nManifest:   "), F.col("manifest"),
                       F.lit("\nIssue:      "), F.col("reason"), F.lit("\nReplace with: "),
                       F.col("nist_replacement"))
    return once.select(
        *keys, "manifest", "ord", "ecosystem", F.col("name").alias("dependency_name"),
        F.col("version").alias("dependency_version"), "algorithm", "algo_type", "risk_level",
        "quantum_status", g.is_quantum_safe(F.col("quantum_status")).alias("quantum_safe"),
        "nist_replacement", "reason", context.alias("context"), F.lit("dependency").alias("source_type"))


def artifact_findings(packages: DataFrame, keys: list[str] = ["repo_id"]) -> DataFrame:
    """For packages inside artifacts: one finding per manifest and algorithm."""
    hits = curated_packages(packages)
    once = first_per(hits, [*keys, "manifest", "algorithm"], "ord")
    version = F.when(F.col("version") != "", F.concat(F.lit(" "), F.col("version"))).otherwise("")
    return once.select(
        *keys, "manifest", "ord", "ecosystem", F.col("name").alias("dependency_name"),
        F.col("version").alias("dependency_version"), "algorithm", "algo_type", "risk_level",
        "quantum_status", F.lit(False).alias("quantum_safe"), "nist_replacement",
        F.concat(F.col("name"), version, F.lit(" — "), F.col("reason")).alias("context"),
        F.lit("artifact").alias("source_type"))


def layer_packages(packages: DataFrame, keys: list[str]) -> DataFrame:
    """Packages of an image: the first layer that names one wins."""
    return first_per(packages, [*keys, "ecosystem", "name"], "layer", "manifest", "ord")


def curated_cves(findings: DataFrame) -> DataFrame:
    """CVE records named in the reason a package is listed."""
    ids = F.regexp_extract_all("reason", F.lit(f"({dim.CVE_PATTERN})"), F.lit(1))
    return findings.select("*", F.explode(ids).alias("cve_id")).withColumns({
        "summary": F.col("reason"), "cvss_score": F.lit(None).cast("double"),
        "cvss_severity": F.col("risk_level"), "source": F.lit("curated")})


def lookup_packages(packages: DataFrame) -> DataFrame:
    """Distinct (ecosystem, name) with the version mentioned last."""
    return first_per(packages, ["ecosystem", "name"], F.col("ord").desc()).select(
        "ecosystem", "name", "version")


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def is_crypto_text(said: Column) -> Column:
    """Whether lower-cased advisory text mentions cryptography at all."""
    return reduce(lambda a, b: a | b, [F.contains(said, F.lit(k)) for k in dim.ADVISORY_KEYWORDS])


def inferred_algorithm(said: Column) -> Column:
    chosen = F.lit(dim.ADVISORY_DEFAULT_ALGORITHM)
    for fragment, algorithm in reversed(dim.ADVISORY_ALGORITHMS):
        chosen = F.when(F.contains(said, F.lit(fragment)), algorithm).otherwise(chosen)
    return chosen


def cvss_score(severity: Column) -> Column:
    """The first severity score that ends in a decimal number."""
    numeric = F.filter(severity, lambda s: s.rlike(r"\d+\.\d+$"))
    return F.regexp_extract(F.get(numeric, F.lit(0)), r"(\d+\.\d+)$", 1).cast("double")


def cvss_risk(score: Column) -> Column:
    return (F.when(score.isNull(), "HIGH").when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH")
            .when(score >= 4.0, "MEDIUM").otherwise("LOW"))


def grade_advisories(advisories: DataFrame) -> DataFrame:
    """Crypto-relevant advisories with algorithm, score and risk.

    ``advisories(id, ecosystem, package, summary, details, aliases, severity)``
    in the feed's own ecosystem names; ``aliases`` and ``severity`` are arrays
    of text.
    """
    texts = advisories.select(
        "id", "ecosystem", "package", "summary", "severity", F.lower(_text("summary", "details")).alias("said"),
        F.lower(F.array_join("aliases", " ")).alias("aliased"))
    score = cvss_score(F.col("severity"))
    graded = F.struct(
        F.col("id"), g.lookup(F.col("ecosystem"), dim.FEED_ECOSYSTEMS).alias("ecosystem"),
        F.col("package").alias("name"), F.coalesce("summary", F.lit(dim.ADVISORY_DEFAULT_SUMMARY)).alias("summary"),
        inferred_algorithm(F.col("said")).alias("algorithm"), score.alias("cvss_score"),
        cvss_risk(score).alias("risk_level"))
    # as an array and not as a filter, which would lower the text once per keyword
    relevant = is_crypto_text(F.col("said")) | is_crypto_text(F.col("aliased"))
    return unnest(texts.select(F.array_compact(F.array(F.when(relevant, graded))).alias("_g")), [], "_g")


def advisory_findings(packages: DataFrame, advisories: DataFrame, keys: list[str] = ["repo_id"]) -> DataFrame:
    """One finding per manifest, package and inferred algorithm.

    Advisories are cut to the first of each (package, algorithm) before the
    join, and so are package mentions, so the join yields just the result.
    """
    first_advisory = first_per(grade_advisories(advisories), ["ecosystem", "name", "algorithm"], "id")
    mentioned = packages.withColumn("_name", F.lower("name"))
    mentioned = first_per(mentioned, [*keys, "manifest", "ecosystem", "_name"], "ord")
    joined = mentioned.join(first_advisory.withColumnRenamed("name", "_name"), ["ecosystem", "_name"])
    once = first_per(joined, [*keys, "manifest", "_name", "algorithm"], "ord")
    return once.select(
        *keys, "manifest", "ord", "ecosystem", F.col("name").alias("dependency_name"),
        F.col("version").alias("dependency_version"), F.col("id").alias("cve_id"), "summary",
        "cvss_score", "algorithm", F.lit("Asymmetric").alias("algo_type"), "risk_level",
        F.lit("VULNERABLE").alias("quantum_status"), F.lit(False).alias("quantum_safe"),
        F.lit(dim.ADVISORY_REPLACEMENT).alias("nist_replacement"),
        F.lit("dependency").alias("source_type"), F.lit("osv").alias("source"))


def backfill_cves(findings: DataFrame, cves: DataFrame, advisories: DataFrame) -> DataFrame:
    """CVE records for active dependency findings that have none yet.

    A package may have very many advisories and be named by very many findings, and every pair is a record.  So the
    findings are dealt by id and the graded advisories, which are cut to their names and grades, come to them:
    no package's findings meet in one task, and no record is moved once it is made.  Findings meet an advisory some at
    a time: an advisory's columns stay the same for so many rows, and the same ids follow for the next one, so that the
    records, by far the most that is written, are short on disk.
    """
    bare = findings.where((F.col("source_type") == "dependency") & ~F.col("archived")
                          & (F.coalesce("dependency_name", F.lit("")) != "")
                          & (F.coalesce("ecosystem", F.lit("")) != ""))
    bare = bare.select("finding_id", "ecosystem", F.lower("dependency_name").alias("name"))
    bare = bare.join(cves.select("finding_id"), "finding_id", "left_anti")
    checkpoint_dir(findings.sparkSession)
    found = join_each(_some_at_a_time(bare), grade_advisories(advisories).checkpoint(), ["ecosystem", "name"], deal=True)
    return found.select(F.explode("finding_ids").alias("finding_id"), F.col("id").alias("cve_id"), "summary", "cvss_score",
                        F.col("risk_level").alias("cvss_severity"), F.lit("osv").alias("source"))


def _some_at_a_time(bare: DataFrame) -> DataFrame:
    """(ecosystem, name, finding_ids): at most MEET_AT_ONCE findings of a package in a row, dealt by id.

    There are several deals to a partition, as few would fill the partitions unevenly.  Ids may be null or repeat.
    """
    deals = 8 * partitions(bare.sparkSession)
    dealt = spread(bare.withColumn("_deal", F.pmod(F.xxhash64("finding_id", "name"), F.lit(deals))), "_deal")
    place = F.row_number().over(Window.partitionBy("_deal", "ecosystem", "name").orderBy("finding_id"))
    some = dealt.withColumn("_some", F.floor((place - 1) / MEET_AT_ONCE))
    # as structures, since a list of plain values is without its nulls
    return some.groupBy("_deal", "ecosystem", "name", "_some").agg(
        F.collect_list(F.struct("finding_id")).alias("_found")).select(
        "ecosystem", "name", F.col("_found.finding_id").alias("finding_ids"))


def dependency_tree(findings: DataFrame, keys: list[str] = ["repo_id"]) -> DataFrame:
    """Manifest → package → algorithms, one row per package of a manifest."""
    node = [*keys, "manifest", "dependency_name", "dependency_version"]
    leaves = findings.groupBy(*node, "algorithm", "quantum_status").agg(F.count("*").alias("n"))
    rank = F.least(g.status_rank(F.col("quantum_status")), F.lit(4))
    return leaves.groupBy(*node).agg(
        F.sort_array(F.collect_set("algorithm")).alias("algorithms"), F.min(rank).alias("_rank"),
    ).select(*node, "algorithms", g.lookup(
        F.col("_rank"), {0: "BROKEN", 1: "VULNERABLE", 2: "WEAK", 3: "MONITOR", 4: "SAFE"}).alias("worst_status"))
