"""Grading observed TLS endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions import grades as g
from keyfathom.functions.paths import endpoint_parts


def _field(table: dict, key: Column, i: int, default: object) -> Column:
    return g.lookup(key, {k: v[i] for k, v in table.items()}, default)


def _key_grade(i: int) -> Column:
    kind = F.col("key_type")
    return (F.when(kind == "RSA", _field(grades.TLS_RSA, F.col("key_size"), i, grades.TLS_RSA_DEFAULT[i]))
            .when(kind == "EC", _field(grades.TLS_CURVES, F.col("key_curve"), i, grades.TLS_CURVE_DEFAULT[i]))
            .when(kind.isNotNull(), F.coalesce(_field(grades.TLS_OTHER_KEYS, kind, i, None),
                                               F.lit(grades.TLS_UNKNOWN_KEY[i]))))


def _algorithm() -> Column:
    kind, size = F.col("key_type"), F.col("key_size").cast("string")
    return (F.when(kind == "RSA", F.concat(F.lit("RSA-"), size))
            .when(kind == "EC", F.concat(F.lit("EC-"), F.col("key_curve")))
            .when(kind == "DSA", F.concat(F.lit("DSA-"), size)).otherwise(kind))


def _issues(as_of: Column) -> Column:
    kind, size, expiry = F.col("key_type"), F.col("key_size").cast("string"), F.col("cert_not_after")
    key = (F.when(kind == "RSA", F.concat(F.lit("RSA-"), size, F.lit(" is quantum-vulnerable (Shor's algorithm)")))
           .when(kind == "EC", F.concat(F.lit("Elliptic curve "), F.col("key_curve"),
                                        F.lit(" is quantum-vulnerable (Shor's algorithm)")))
           .when(kind.isin("Ed25519", "Ed448"), F.concat(kind, F.lit(" is quantum-vulnerable")))
           .when(kind == "DSA", "DSA is broken and quantum-vulnerable"))
    old = F.when(F.col("tls_version").isin(grades.TLS_DEPRECATED),
                 F.concat(F.lit("Deprecated TLS version: "), F.col("tls_version")))
    days = F.floor((F.unix_timestamp(expiry) - F.unix_timestamp(as_of)) / 86400)
    due = (F.when(expiry < as_of, "Certificate is expired")
           .when(days < 30, F.concat(F.lit("Certificate expires in "), days.cast("string"), F.lit(" days"))))
    return F.array_compact(F.array(key, old, due))


def grade(observations: DataFrame, as_of: Column) -> DataFrame:
    """Algorithm, worst status, risk and issues of every endpoint.

    The status is the worse of key and protocol; the key's risk counts when the
    key is no better than the protocol.  Failed scans get no grade.
    """
    done = F.col("scan_status") == "complete"
    rows = observations.withColumns({
        "_key": _key_grade(0), "_key_risk": _key_grade(1),
        "_tls": _field(grades.TLS_VERSIONS, F.col("tls_version"), 0, grades.TLS_VERSION_DEFAULT[0]),
        "_tls_risk": _field(grades.TLS_VERSIONS, F.col("tls_version"), 1, grades.TLS_VERSION_DEFAULT[1])})
    key_decides = F.col("_key").isNotNull() & (g.status_rank(F.col("_key")) <= g.status_rank(F.col("_tls")))
    no_issues = F.array().cast("array<string>")
    return rows.withColumns({
        "algorithm": F.when(done, _algorithm()),
        "quantum_status": F.when(done, F.when(key_decides, F.col("_key")).otherwise(F.col("_tls"))),
        "risk_level": F.when(done, F.when(key_decides, F.col("_key_risk")).otherwise(F.col("_tls_risk"))),
        "nist_replacement": F.when(done, _key_grade(2)),
        "issues": F.when(done, _issues(as_of)).otherwise(no_issues),
    }).drop("_key", "_key_risk", "_tls", "_tls_risk")


def with_endpoint(rows: DataFrame, raw: str = "endpoint_raw") -> DataFrame:
    parts = rows.withColumn("_e", endpoint_parts(F.col(raw)))
    endpoint = F.concat(F.col("_e.host"), F.lit(":"), F.col("_e.port").cast("string"))
    return parts.select(*rows.columns, F.col("_e.host").alias("host"), F.col("_e.port").alias("port"),
                        endpoint.alias("endpoint"))
