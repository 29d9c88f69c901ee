"""Named queries over the given tables, each next to the SQL it must agree with."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    from keyfathom.checks import activity, artifacts, base, detection, inventory, scans, streams, supply  # noqa: F401
    return base.QUERIES, base.ORACLES
