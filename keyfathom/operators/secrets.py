"""Keys, certificates and SSH settings committed to repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import paths, text

# ---- FIXED VALUES ----------------------------------------------------------

# PEM header -> (finding_type, algorithm)
PEM_HEADERS = [
    (r"-----BEGIN RSA PRIVATE KEY-----", "SSH_PRIVATE_KEY", "RSA-2048"),
    (r"-----BEGIN EC PRIVATE KEY-----", "SSH_PRIVATE_KEY", "ECDSA"),
    (r"-----BEGIN DSA PRIVATE KEY-----", "SSH_PRIVATE_KEY", "DSA"),
    (r"-----BEGIN OPENSSH PRIVATE KEY-----", "SSH_PRIVATE_KEY", "Ed25519"),
    (r"-----BEGIN (?:ENCRYPTED )?PRIVATE KEY-----", "SSH_PRIVATE_KEY", "RSA-2048"),
    (r"-----BEGIN CERTIFICATE-----", "TLS_CERT", "RSA-2048"),
    (r"-----BEGIN PGP (?:PUBLIC|PRIVATE) KEY BLOCK-----", "GPG_KEY", "RSA-2048"),
]
PUBLIC_KEY = (r"(?:^|\s)(ssh-rsa|ssh-dss|ssh-ed25519|ecdsa-sha2-(nistp256|nistp384|nistp521))"
              r"\s+([A-Za-z0-9+/]{20,}={0,3})")
SSH_DIRECTIVE = r"(?i)^\s*(KexAlgorithms|Ciphers|MACs)\s+(\S.*?)\s*$"

# (quantum_status, risk_level, nist_replacement) by kind of key
GRADES = {
    "RSA_WEAK": ("BROKEN", "CRITICAL", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)"),
    "RSA": ("VULNERABLE", "CRITICAL", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)"),
    "ECDSA": ("VULNERABLE", "HIGH", "ML-DSA-65 (FIPS 204)"),
    "ED25519": ("VULNERABLE", "MEDIUM", "ML-DSA-65 (FIPS 204)"),
    "DSA": ("BROKEN", "CRITICAL", "ML-DSA-65 (FIPS 204)"),
    "SSH_BROKEN": ("BROKEN", "CRITICAL", "AES-256-GCM"),
    "SSH_CONFIG": ("VULNERABLE", "HIGH", "sntrup761x25519-sha512@openssh.com"),
}

# ---- END OF FIXED VALUES ---------------------------------------------------


def _hit(kind: str | Column, algorithm: Column, size: Column, curve: Column,
         key: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("finding_type"), algorithm.alias("algorithm"), size.cast("int").alias("key_size"),
        curve.cast("string").alias("curve"), (none if key is None else key).alias("config_key"),
        (none if value is None else value).alias("config_value"))


def _pem(line: Column) -> Column:
    none = F.lit(None)
    return F.coalesce(*[F.when(line.rlike(p), _hit(kind, F.lit(a), none, none))
                        for p, kind, a in PEM_HEADERS])


def _public_key(line: Column, name: Column) -> Column:
    """Key type, and for RSA the modulus bits worked out from the key's length."""
    kind = F.regexp_extract(line, PUBLIC_KEY, 1)
    curve = F.regexp_extract(line, PUBLIC_KEY, 2)
    size = rsa_bits(F.regexp_extract(line, PUBLIC_KEY, 3))
    none = F.lit(None)
    where = F.when(name == "authorized_keys", "AUTHORIZED_KEY").otherwise("SSH_PUBLIC_KEY")
    return (F.when(kind == "ssh-rsa", _hit(where, F.concat(F.lit("RSA-"), size.cast("string")), size, none))
            .when(kind == "ssh-dss", _hit(where, F.lit("DSA"), none, none))
            .when(kind == "ssh-ed25519", _hit(where, F.lit("Ed25519"), F.lit(256), none))
            .when(kind != "", _hit(where, F.concat(F.lit("ECDSA-"), curve), none, curve)))


def rsa_bits(base64_text: Column) -> Column:
    """Modulus bits of an OpenSSH RSA key: its bytes less some 23 of framing, in steps of 256."""
    payload = F.floor(F.length(F.regexp_replace(base64_text, "=+$", "")) * 3 / 4)
    return (F.round((payload - 23) * 8 / 256.0, 0) * 256).cast("int")


def _directive(line: Column) -> Column:
    none = F.lit(None)
    key = F.regexp_extract(line, SSH_DIRECTIVE, 1)
    return F.when(line.rlike(SSH_DIRECTIVE), _hit(
        "SSH_CONFIG", key, none, none, key, F.regexp_extract(line, SSH_DIRECTIVE, 2)))


def grade(kind: Column, algorithm: Column, key_size: Column, config_value: Column) -> Column:
    """Name of the grade a secret gets."""
    broken_cipher = F.coalesce(config_value, F.lit("")).rlike("(?i)arcfour|rc4|3des|(^|[,-])des")
    return (F.when((kind == "SSH_CONFIG") & broken_cipher, "SSH_BROKEN")
            .when(kind == "SSH_CONFIG", "SSH_CONFIG")
            .when(F.startswith(algorithm, F.lit("RSA")) & (F.coalesce(key_size, F.lit(2048)) <= 1024), "RSA_WEAK")
            .when(F.startswith(algorithm, F.lit("RSA")), "RSA")
            .when(F.startswith(algorithm, F.lit("ECDSA")), "ECDSA")
            .when(F.startswith(algorithm, F.lit("DSA")), "DSA")
            .when(algorithm.isin("Ed25519", "Ed448"), "ED25519"))


def _graded(field: int) -> Column:
    from keyfathom.functions.grades import lookup
    return lookup(F.col("grade"), {k: v[field] for k, v in GRADES.items()})


def secret_array() -> Column:
    """Secrets of the file in this row (file_path, content), null or empty for none."""
    name = paths.basename(F.col("file_path"))
    is_ssh_config = name.isin("sshd_config", "ssh_config")
    lines = text.split_lines(text.unify_newlines(F.col("content")))
    has_key = F.contains("content", F.lit("-----BEGIN ")) | F.contains("content", F.lit("ssh-")) | F.contains(
        "content", F.lit("ecdsa-sha2-"))

    def hit(line: Column) -> Column:
        return F.coalesce(_pem(line), _public_key(line, name), F.when(is_ssh_config, _directive(line)))

    numbered = F.filter(F.transform(lines, lambda line, i: F.struct(
        (i + 1).alias("line_number"), hit(line).alias("hit"), F.left(F.trim(line), F.lit(200)).alias("context"))),
        lambda h: h["hit"].isNotNull())
    return F.when(has_key | is_ssh_config, numbered)


def find(files: DataFrame, keys: list[str] = ["repo_id", "file_path"]) -> DataFrame:
    """Graded secrets, one per line that shows one."""
    return graded(files.select(*keys, secret_array().alias("hits")), keys)


def graded(found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and grades of the secrets in a ``hits`` column."""
    opened = found.select(*keys, F.inline_outer("hits")).where(F.col("line_number").isNotNull())
    opened = opened.select(*keys, "line_number", "hit.*", "context")
    opened = opened.withColumn("grade", grade(F.col("finding_type"), F.col("algorithm"),
                                              F.col("key_size"), F.col("config_value")))
    return opened.select(
        *keys, "line_number", "finding_type", "algorithm", "key_size", "curve", "config_key", "config_value",
        _graded(0).alias("quantum_status"), _graded(1).alias("risk_level"),
        _graded(2).alias("nist_replacement"), "context")


def expiry_status(not_after: Column, as_of: Column) -> Column:
    """EXPIRED, EXPIRES_SOON (30 days), EXPIRES_90D or VALID; null without a date."""
    days = F.floor((F.unix_timestamp(not_after) - F.unix_timestamp(as_of)) / 86400)
    return (F.when(not_after.isNull(), None).when(not_after < as_of, "EXPIRED")
            .when(days < 30, "EXPIRES_SOON").when(days < 90, "EXPIRES_90D").otherwise("VALID"))


def grade_certificates(certificates: DataFrame, as_of: Column) -> DataFrame:
    """Grade observed certificates (repo_id, file_path, key_type, key_size, curve, sig_hash, not_after).

    The key decides, a SHA-1 signature on a key that is not broken means WEAK,
    and an expired certificate is always critical.
    """
    algorithm = (F.when(F.col("key_type") == "RSA", F.concat(F.lit("RSA-"), F.col("key_size").cast("string")))
                 .when(F.col("key_type") == "EC", F.concat(F.lit("ECDSA-"), F.col("curve")))
                 .otherwise(F.col("key_type")))
    rows = certificates.withColumn("algorithm", algorithm).withColumn("finding_type", F.lit("TLS_CERT"))
    rows = rows.withColumn("grade", grade(F.col("finding_type"), F.col("algorithm"), F.col("key_size"), F.lit(None)))
    rows = rows.withColumn("expiry_status", expiry_status(F.col("not_after"), as_of))
    sha1 = F.lower(F.coalesce("sig_hash", F.lit(""))).isin("sha1", "sha-1") & (_graded(0) != "BROKEN")
    return rows.withColumns({
        "quantum_status": F.when(sha1, "WEAK").otherwise(_graded(0)),
        "risk_level": F.when(F.col("expiry_status") == "EXPIRED", "CRITICAL")
        .when(sha1, "HIGH").otherwise(_graded(1)),
        "nist_replacement": _graded(2)}).drop("grade")
