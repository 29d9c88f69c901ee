"""Filtered, sorted and paged lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions import grades as g
from keyfathom.functions import paths


def _like(column: str, part: str) -> Column:
    return F.col(column).ilike(f"%{part}%")


def _text_match(part: str) -> Column:
    return _like("file_path", part) | _like("algorithm", part)


def findings(rows: DataFrame, *, repos: DataFrame | None = None, cves: DataFrame | None = None,
             project_id: object = None, repo_id: object = None, risk_level: str | None = None,
             quantum_status: str | None = None, algorithm: str | None = None,
             migration_status: str | None = None, source_type: str | None = None,
             cve_id: str | None = None, search: str | None = None,
             include_archived: bool = False) -> DataFrame:
    """Findings that meet every given condition."""
    if not include_archived:
        rows = rows.where(~F.col("archived"))
    exact = {"repo_id": repo_id, "risk_level": risk_level, "quantum_status": quantum_status,
             "migration_status": migration_status, "source_type": source_type}
    for column, value in exact.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if algorithm:
        rows = rows.where(_like("algorithm", algorithm))
    if search:
        rows = rows.where(_text_match(search))
    if project_id is not None:
        ids = repos.where(F.col("project_id") == project_id).select("repo_id")
        rows = rows.join(ids, "repo_id", "left_semi")
    if cve_id:
        ids = cves.where(_like("cve_id", cve_id)).select("finding_id")
        rows = rows.join(ids, "finding_id", "left_semi")
    return rows


def page(rows: DataFrame, order: list[Column | str], skip: int = 0, limit: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def findings_page(rows: DataFrame, skip: int = 0, limit: int = 200, severity_order: bool = False) -> DataFrame:
    """By risk text (or by severity), newest first."""
    first = g.risk_rank(F.col("risk_level")) if severity_order else F.col("risk_level")
    return page(rows, [first, F.col("created_at").desc(), "finding_id"], skip, limit)


def archived(rows: DataFrame, repo_id: object = None, search: str | None = None) -> DataFrame:
    rows = rows.where(F.col("archived"))
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    return rows.where(_text_match(search)) if search else rows


def newest(rows: DataFrame, time_column: str, key: str, skip: int = 0, limit: int = 200) -> DataFrame:
    return page(rows, [F.col(time_column).desc(), key], skip, limit)


def at_least(rows: DataFrame, min_risk: str | None) -> DataFrame:
    """Findings at or above a risk; an unknown threshold lets everything through."""
    if not min_risk:
        return rows
    limit = grades.RISK_RANK.get(min_risk.upper(), grades.UNRANKED)
    return rows.where(g.risk_rank(F.col("risk_level")) <= limit)


def by_risk_and_path(rows: DataFrame) -> DataFrame:
    return rows.orderBy(g.risk_rank(F.col("risk_level")), "file_path")


def unvalidated(rows: DataFrame, repo_id: object = None) -> DataFrame:
    """Source findings waiting for validation, labelled pending."""
    rows = rows.where((F.col("source_type") == "source_code") & ~F.col("archived")
                      & ~F.coalesce(F.col("ai_validated"), F.lit(False)))
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    return rows.withColumn("ai_label", F.lit("pending"))


def equal_to(rows: DataFrame, archived: bool = False, **conditions: object) -> DataFrame:
    """Runtime and network lists: exact conditions, archived or not."""
    rows = rows.where(F.col("archived") == archived)
    for column, value in conditions.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def containing(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in which any of the columns holds the text, ignoring case."""
    if not query:
        return rows
    return rows.where(F.contains(F.lower(F.concat_ws("\u0001", *columns)), F.lit(query.lower())))


def of_project(rows: DataFrame, repos: DataFrame, project_id: object) -> DataFrame:
    ids = repos.where(F.col("project_id") == project_id).select("repo_id")
    return rows.join(ids, "repo_id", "left_semi")


def with_links(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Repository name and link to the code; dependency findings have no link."""
    named = rows.join(repos.select("repo_id", F.col("name").alias("repo_name"), "url", "branch"),
                      "repo_id", "left")
    url = paths.blob_url(F.col("url"), F.col("branch"), F.col("file_path"), F.col("line_number"))
    shown = F.when(F.col("url").isNotNull() & (F.col("source_type") != "dependency"), url)
    return named.withColumn("source_url", shown).drop("url", "branch")
