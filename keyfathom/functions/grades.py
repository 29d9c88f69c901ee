"""Column expressions for ranks, scores and label lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.dims.registry import REGISTRY


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """Value of ``key`` in a small fixed table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def status_rank(status: Column) -> Column:
    return lookup(status, grades.STATUS_RANK, grades.UNRANKED)


def risk_rank(risk: Column, default: int = grades.UNRANKED) -> Column:
    return lookup(risk, grades.RISK_RANK, default)


def is_quantum_safe(status: Column) -> Column:
    return F.coalesce(status.isin("SAFE", "MONITOR"), F.lit(False))


def priority(status: Column) -> Column:
    return lookup(status, grades.PRIORITY, grades.PRIORITY_DEFAULT)


def risk_score(status: Column) -> Column:
    return lookup(status, grades.RISK_SCORE, grades.RISK_SCORE_DEFAULT)


def scan_priority(status: Column) -> Column:
    return lookup(status, grades.SCAN_PRIORITY, grades.SCAN_PRIORITY_DEFAULT)


def scan_risk_score(status: Column) -> Column:
    return lookup(status, grades.SCAN_RISK_SCORE, grades.SCAN_RISK_SCORE_DEFAULT)


def nist_level(status: Column) -> Column:
    return lookup(status, grades.NIST_LEVEL, 0)


def registry_field(algorithm: Column, field: str) -> Column:
    """A registry attribute of an algorithm name; null when it is not registered."""
    return lookup(algorithm, {a.name: getattr(a, field) for a in REGISTRY})


def worst_status(status: Column) -> Column:
    """Aggregate: the status with the lowest rank."""
    return F.min_by(status, F.struct(status_rank(status), status))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to even; 0 of nothing is 0."""
    return F.when(whole > 0, F.bround(part / whole * 100, 0)).otherwise(0).cast("long")
