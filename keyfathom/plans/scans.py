"""Whole jobs: a repository scan and an artifact scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import paths, text
from keyfathom.operators import (agility, callgraph, dependencies, detect, lifecycle, manifests, native, reports,
                                 secrets)
from keyfathom.session import checkpoint_dir
from keyfathom.sources import archives


KEYS = ["repo_id", "file_path"]


def match_corpus(files: DataFrame) -> DataFrame:
    """All that is looked for in text, in one pass over the corpus.

    One row per file with arrays ``code``, ``signals``, ``hits`` (secrets),
    ``functions`` (Go and Java) and ``packages``.  The text itself, by far the
    largest column, goes no further, and nothing is shuffled.
    """
    tokens = sorted({*detect.registry_tokens(), *agility.signal_tokens()})
    source = paths.is_source_file(F.col("file_path"))
    production = source & agility.is_production(F.col("file_path"))
    ready = text.with_lines(files, tokens)
    shown = text.split_lines(text.without_last_newline(F.col("content")))
    found = ready.select(
        *KEYS, source.alias("is_source"), shown.alias("shown"), F.when(source, detect.hit_array()).alias("code"),
        F.when(production, agility.signal_array()).alias("signals"), secrets.secret_array().alias("hits"),
        callgraph.span_array().alias("spans"), manifests.package_array(F.col("content")).alias("packages"))
    return found.select(
        *KEYS, "is_source", detect.with_context(F.col("code"), F.col("shown")).alias("code"),
        agility.signal_context("signals", "shown").alias("signals"), "hits",
        callgraph.body_array("spans", "shown").alias("functions"), "packages")


@dataclass
class RepositoryScan:
    code: DataFrame
    dependencies: DataFrame
    cves: DataFrame
    secrets: DataFrame
    agility: DataFrame
    risk: DataFrame
    stats: DataFrame


def scan_repositories(files: DataFrame, reachability: bool = True,
                      advisories: DataFrame | None = None) -> RepositoryScan:
    """Everything one scan finds in ``files(repo_id, file_path, content)``.

    What matching finds is checkpointed: it is small, everything after it reads
    it, and matching the corpus is the costly part.
    """
    checkpoint_dir(files.sparkSession)
    matched = match_corpus(files).checkpoint()
    code = detect.describe(detect.unnest(matched, KEYS, "code")).withColumns({
        "source_type": F.lit("source_code"), "ai_validated": F.lit(False)})
    packages = manifests.opened(matched, ["repo_id"], "packages")
    deps = dependencies.dependency_findings(packages)
    cves = dependencies.curated_cves(deps)
    if advisories is not None:
        found = dependencies.advisory_findings(packages, advisories)
        deps = deps.unionByName(found, allowMissingColumns=True)
    hidden = secrets.graded(matched, KEYS)
    scanned = matched.where(F.col("is_source"))
    levels = agility.agility_levels(matched.select("repo_id"), detect.unnest(matched, KEYS, "signals"), code)
    annotated = code
    if reachability:
        extracted = callgraph.python_functions(files).unionByName(
            callgraph.declared(matched)).checkpoint()
        functions = callgraph.functions_of(extracted)
        reached = callgraph.reach(functions, callgraph.calls_of(extracted))
        keys = ["repo_id", "file_path", "line_number", "algorithm"]
        seen = callgraph.verdicts(code.select(*keys, "source_type"), functions, reached).select(
            *keys, "reachable", "call_depth", "call_chain")
        annotated = code.join(seen, keys, "left")
    else:
        annotated = code.withColumn("reachable", F.lit(None).cast("boolean"))
    return RepositoryScan(
        code=lifecycle.suggest_false_positives(annotated), dependencies=deps, cves=cves, secrets=hidden,
        agility=levels, risk=reports.repo_risk(code, deps, hidden),
        stats=reports.scan_run_stats(scanned, code.select("repo_id").unionAll(deps.select("repo_id"))))


def _of_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Rows of the scanned repositories (left_semi) or of all others (left_anti)."""
    return rows.join(runs.select("repo_id"), "repo_id", how)


def _identity(*columns: str) -> Column:
    """An id that the same row of the same scan always has."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


FINDING_ID = ["scan_run_id", "repo_id", "file_path", "line_number", "algorithm", "source_type", "dependency_name"]
SECRET_ID = ["scan_run_id", "repo_id", "file_path", "line_number", "finding_type", "algorithm", "config_key", "config_value"]


def _dependency_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Dependency findings of a scan as rows of the findings table, with their ids."""
    named = rows.withColumnRenamed("manifest", "file_path").withColumn("line_number", F.lit(0))
    return named.join(runs.select("repo_id", "scan_run_id"), "repo_id").withColumn("finding_id", _identity(*FINDING_ID))


def next_findings(existing: DataFrame, scan: RepositoryScan, runs: DataFrame, as_of: Column) -> DataFrame:
    """The findings table after a scan: source rows reconciled, dependency rows replaced."""
    code = scan.code.withColumn("source_type", F.lit("source_code")) if "source_type" not in scan.code.columns else scan.code
    stepped = lifecycle.scan_step(existing.where("source_type <> 'dependency' OR source_type IS NULL"), code, runs, as_of)
    state = {"migration_status": F.lit("open"), "archived": F.lit(False), "created_at": as_of}
    stamps = runs.select("repo_id", "scan_run_id")
    fresh = stepped.where("action = 'new'").drop("scan_run_id", "action").join(stamps, "repo_id").withColumns(
        {c: v for c, v in state.items() if c in existing.columns}).withColumn("finding_id", _identity(*FINDING_ID))
    deps = _dependency_rows(scan.dependencies, runs).withColumns(state)
    columns = existing.columns
    others = _of_runs(existing.where("source_type = 'dependency'"), runs, "left_anti")
    return (stepped.where("action <> 'new'").select(columns).unionByName(fresh.select(columns)).unionByName(others.select(columns))
            .unionByName(deps.select(*[c for c in columns if c in deps.columns]), allowMissingColumns=True))


def next_secrets(existing: DataFrame, scan: RepositoryScan, runs: DataFrame) -> DataFrame:
    """The secrets table after a scan: those of the scanned repositories are replaced."""
    found = scan.secrets.join(runs.select("repo_id", "scan_run_id"), "repo_id").withColumns(
        {"secret_id": _identity(*SECRET_ID), "migration_status": F.lit("open"), "archived": F.lit(False)})
    return _of_runs(existing, runs, "left_anti").unionByName(
        found.select(*[c for c in existing.columns if c in found.columns]), allowMissingColumns=True)


def next_cves(existing: DataFrame, findings: DataFrame, scan: RepositoryScan, runs: DataFrame) -> DataFrame:
    """The CVE records after a scan.

    ``findings`` is the findings table before it: records of its dependency findings in scanned repositories go,
    those of the scan's dependencies come, under the ids that next_findings gives these.
    """
    replaced = _of_runs(findings.where("source_type = 'dependency'"), runs, "left_semi").select("finding_id")
    found = _dependency_rows(scan.cves, runs)
    return existing.join(replaced, "finding_id", "left_anti").unionByName(
        found.select(*[c for c in existing.columns if c in found.columns]), allowMissingColumns=True)


@dataclass
class ArtifactScan:
    findings: DataFrame
    ledger: DataFrame


def scan_artifact_files(artifacts: DataFrame, piece_bytes: int = archives.PIECE_BYTES) -> ArtifactScan:
    """Findings in artifacts (declared packages, programs, bytecode) and a row of each artifact's state.

    ``artifacts(artifact_id, artifact_name, content)``.  Artifacts are opened and searched in one pass;
    what is checkpointed are packages, symbols and states, no contents.  The ledger has
    (artifact_id, artifact_name, artifact_type, status, reason, n_members, n_unread, n_findings).
    """
    checkpoint_dir(artifacts.sparkSession)
    pieces = archives.artifact_pieces(artifacts, piece_bytes)
    manifest = F.when(F.col("kind") == "manifest", text.unify_newlines(text.decode_text(F.col("content"))))
    found = native.piece_symbols(pieces.withColumn("packages", manifests.packed_array(manifest)))
    found = found.where("kind = 'status' OR size(hits) > 0 OR size(packages) > 0").checkpoint()

    keys = ["artifact_id", "artifact_name", "layer"]
    packages = manifests.packed_opened(found.where("kind = 'manifest'"), keys, "packages")
    in_image = F.col("layer").isNotNull()
    layered = dependencies.layer_packages(packages.where(in_image), ["artifact_id"])
    packages = packages.where(~in_image).unionByName(layered.select(*packages.columns))
    columns = ["algorithm", "algo_type", "risk_level", "quantum_status", "quantum_safe", "nist_replacement", "context"]
    declared = dependencies.artifact_findings(packages, ["artifact_id", "artifact_name"]).select(
        "artifact_id", F.concat_ws("/", "artifact_name", "manifest").alias("file_path"), *columns, "dependency_name",
        "dependency_version", F.lit(0).alias("ord"))
    symbols = native.artifact_symbols(found.where("kind IN ('class', 'native', 'macho')")).select(
        "artifact_id", F.concat_ws("/", "artifact_name", F.nullif("file_path", F.lit(""))).alias("file_path"), *columns,
        F.lit("").alias("dependency_name"), F.lit("").alias("dependency_version"), F.lit(1).alias("ord"))
    findings = native.once_per_path(declared.unionByName(symbols)).drop("ord").withColumn("source_type", F.lit("artifact"))

    # counts come to the states as rows of the same groups
    state = ["artifact_name", "artifact_type", "status", "reason", "n_members", "n_unread"]
    states = found.where("kind = 'status'").select("artifact_id", *state, F.lit(0).alias("n_findings")).unionByName(
        findings.select("artifact_id", F.lit(1).alias("n_findings")), allowMissingColumns=True)
    ledger = states.groupBy("artifact_id").agg(*[F.max(c).alias(c) for c in state], F.sum("n_findings").alias("n_findings"))
    return ArtifactScan(findings, ledger)


def scan_artifacts(artifacts: DataFrame) -> DataFrame:
    """The findings of scan_artifact_files."""
    return scan_artifact_files(artifacts).findings
