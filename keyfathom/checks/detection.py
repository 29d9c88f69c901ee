"""Checks of code detection, agility, secrets and native symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.checks.base import check, quoted
from keyfathom.checks.views import Inputs
from keyfathom.dims import grades, signals
from keyfathom.dims.registry import REGISTRY
from keyfathom.functions import text
from keyfathom.functions.patterns import spans_lines
from keyfathom.functions.sqltext import literal
from keyfathom.operators import agility, bom, detect, native, reports, secrets, tls

# RE2 has no lookahead; within one line this is the same condition.
_RE2 = {r"TLSv1\b(?!\.)": r"TLSv1(?:[^\w.]|$)"}


def _line_sql() -> str:
    """Hits of patterns that stay within a line, by matching every line."""
    tests = []
    for a in REGISTRY:
        flat = [_RE2.get(p, p) for p in a.patterns if not spans_lines(p)]
        if flat:
            tests.append(f"CASE WHEN regexp_matches(line, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in flat))}) "
                         f"THEN {quoted(a.name)} END")
    return f"SELECT doc_id, ln AS line_number, unnest([{', '.join(tests)}]) AS algorithm FROM doc_lines"


def _text_sql() -> str:
    """Hits of patterns that may span lines, by match offsets in the whole text."""
    rows = ",\n".join(f"({quoted(a.name)}, {quoted('(?im)' + p)})"
                      for a in REGISTRY for p in a.patterns if spans_lines(p))
    return f"""
SELECT doc_id, 1 + length(before) - length(replace(before, chr(10), '')) AS line_number, algorithm FROM (
  SELECT doc_id, algorithm, array_to_string(list_slice(pieces, 1, i), '') || array_to_string(list_slice(matches, 1, i - 1), '') AS before
  FROM (SELECT doc_id, algorithm, pieces, matches, unnest(range(1, len(matches) + 1)) AS i FROM (
    SELECT doc_id, algorithm, string_split_regex(content, pattern) AS pieces, regexp_extract_all(content, pattern) AS matches
    FROM files_v, (VALUES {rows}) AS p(algorithm, pattern))))"""


_LINES = """doc_lines AS (
  SELECT doc_id, repo_id, file_path, unnest(string_split(content, chr(10))) AS line,
         unnest(range(1, len(string_split(content, chr(10))) + 1)) AS ln FROM files_v)"""
_HITS = f"""WITH {_LINES},
hits AS (SELECT DISTINCT doc_id, CAST(line_number AS INT) AS line_number, algorithm FROM (
  {_line_sql()} UNION ALL {_text_sql()}) WHERE algorithm IS NOT NULL)
"""
_TEST = f"regexp_matches(file_path, {quoted('(?i)' + signals.TEST_PATH)})"
_VENDOR = f"regexp_matches(file_path, {quoted('(?i)' + signals.VENDOR_PATH)})"

KEYS = ["doc_id", "repo_id", "file_path"]


@check("code_findings", _HITS + """
SELECT h.doc_id, h.line_number, h.algorithm, a.algo_type, a.quantum_status, a.risk_level,
       a.quantum_status IN ('SAFE', 'MONITOR') AS quantum_safe
FROM hits h JOIN algo_v a ON a.algorithm = h.algorithm""")
def code_findings(i: Inputs) -> DataFrame:
    return detect.code_findings(i.files(), KEYS, context=False).select(
        "doc_id", "line_number", "algorithm", "algo_type", "quantum_status", "risk_level", "quantum_safe")


@check("code_findings_multiline", f"""
SELECT DISTINCT doc_id, algorithm, CAST(line_number AS INT) AS line_number FROM ({_text_sql()})""")
def code_findings_multiline(i: Inputs) -> DataFrame:
    parts = [f"transform({text.multi_line_hits(p)}, n -> named_struct('algorithm', {literal(a.name)}, 'line_number', n))"
             for a in REGISTRY for p in a.patterns if spans_lines(p)]
    ready = detect.prepare_text(i.files())
    rows = ready.select("doc_id", F.expr(f"array_distinct(concat({', '.join(parts)}))").alias("hits"))
    return detect.unnest(rows, ["doc_id"], "hits").select("doc_id", "algorithm", "line_number")


@check("finding_context", _HITS + """
SELECT h.doc_id, h.algorithm, h.line_number, greatest(h.line_number - 9, 1) AS context_start_line,
  array_to_string(list_slice(string_split(regexp_replace(f.content, '\\n$', ''), chr(10)),
                             greatest(h.line_number - 9, 1), h.line_number + 11), chr(10)) AS context
FROM hits h JOIN files_v f ON f.doc_id = h.doc_id""")
def finding_context(i: Inputs) -> DataFrame:
    return detect.code_findings(i.files(), KEYS).select(
        "doc_id", "algorithm", "line_number", "context_start_line", "context")


@check("path_class", f"""
SELECT doc_id, file_path, {_TEST} AS is_test, {_VENDOR} AS is_vendor, {_TEST} OR {_VENDOR} AS in_test_path FROM files_v""")
def path_class(i: Inputs) -> DataFrame:
    return detect.path_classes(i.view("files_v").select("doc_id", "file_path"))


_EXT = "lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1))"
_EXTENSIONS = ", ".join(quoted(e) for e in signals.SOURCE_EXTENSIONS)
_SKIP = ", ".join(quoted(d) for d in signals.SOURCE_SKIP_DIRS)


@check("source_files", f"""
SELECT doc_id, file_path FROM files_v
WHERE {_EXT} IN ({_EXTENSIONS})
  AND len(list_intersect(string_split(file_path, '/')[:-2], [{_SKIP}])) = 0""")
def source_files(i: Inputs) -> DataFrame:
    return detect.source_files(i.view("files_v")).select("doc_id", "file_path")


@check("language_counts", f"""
SELECT repo_id, {_EXT} AS extension, count(*) AS files FROM files_v GROUP BY ALL""")
def language_counts(i: Inputs) -> DataFrame:
    return detect.language_counts(i.view("files_v"))


@check("repository_scan", _HITS + f"""
SELECT f.repo_id, f.file_path, h.algorithm, h.line_number, {_TEST} OR {_VENDOR} AS in_test_path,
  CASE WHEN {_TEST} OR {_VENDOR} THEN 'false_positive' END AS ai_label
FROM hits h JOIN files_v f ON f.doc_id = h.doc_id
WHERE {_EXT} IN ({_EXTENSIONS}) AND len(list_intersect(string_split(file_path, '/')[:-2], [{_SKIP}])) = 0""")
def repository_scan(i: Inputs) -> DataFrame:
    from keyfathom.plans.scans import scan_repositories
    return scan_repositories(i.files()).code.select(
        "repo_id", "file_path", "algorithm", "line_number", "in_test_path", "ai_label")


def _first_lines(rows: list[tuple[str, str]], exclude: bool) -> str:
    parts = []
    for pattern, value in rows:
        test = f"regexp_matches(line, {quoted('(?i)' + pattern)})"
        if exclude:
            test += f" AND NOT regexp_matches(line, {quoted('(?i)' + signals.NON_CRYPTO_LINE)})"
        parts.append(f"SELECT doc_id, repo_id, file_path, {value}, CAST(min(ln) AS INT) AS line_number "
                     f"FROM doc_lines WHERE {test} GROUP BY ALL")
    return " UNION ALL ".join(parts)


_SIGNALS = _first_lines([(p, f"{quoted(d)} AS description, {w} AS weight") for p, w, d in signals.AGILITY_SIGNALS], True)
_HYBRID = _first_lines([(p, f"{quoted(d)} AS description") for p, d in signals.HYBRID_SIGNALS], False)
_SHOWN = """array_to_string(list_slice(string_split(regexp_replace(f.content, '\\n$', ''), chr(10)),
  greatest(s.line_number - 1, 1), s.line_number + 2), chr(10))"""


def _signal_sql(rows: str, extra: str) -> str:
    return f"""WITH {_LINES}, found AS ({rows})
SELECT s.repo_id, s.file_path, s.description, {extra} s.line_number, left({_SHOWN}, 300) AS context
FROM found s JOIN files_v f ON f.doc_id = s.doc_id
WHERE NOT {_TEST.replace('file_path', 's.file_path')} AND NOT {_VENDOR.replace('file_path', 's.file_path')}"""


@check("agility_signals", _signal_sql(_SIGNALS, "s.weight,"))
def agility_signals(i: Inputs) -> DataFrame:
    return agility.agility_signals(i.files())


@check("hybrid_signals", _signal_sql(_HYBRID, ""))
def hybrid_signals(i: Inputs) -> DataFrame:
    return agility.hybrid_signals(i.files())


_LEVELS = _HITS + f""", sig AS (SELECT * FROM ({_SIGNALS}) WHERE NOT {_TEST} AND NOT {_VENDOR}),
hyb AS (SELECT DISTINCT repo_id FROM ({_HYBRID}) WHERE NOT {_TEST} AND NOT {_VENDOR}),
crit AS (SELECT f.repo_id, count(*) AS n FROM hits h JOIN files_v f ON f.doc_id = h.doc_id
  JOIN algo_v a ON a.algorithm = h.algorithm
  WHERE a.risk_level = 'CRITICAL' AND NOT {_TEST} AND NOT {_VENDOR} GROUP BY f.repo_id),
raw AS (SELECT r.repo_id, coalesce(sum(s.weight), 0) AS score,
  coalesce(bool_or(s.description = {quoted(signals.KEY_ANCHOR)}), false) AS k,
  coalesce(bool_or(s.description = {quoted(signals.WEAK_RSA_ANCHOR)}), false) AS w
  FROM (SELECT DISTINCT repo_id FROM files_v) r LEFT JOIN sig s ON s.repo_id = r.repo_id GROUP BY r.repo_id),
fin AS (SELECT raw.repo_id, hyb.repo_id IS NOT NULL AS has_hybrid, coalesce(crit.n, 0) AS critical_count,
  CASE WHEN k THEN least(score, 0) WHEN w THEN least(score, 2) ELSE score END AS s
  FROM raw LEFT JOIN hyb ON hyb.repo_id = raw.repo_id LEFT JOIN crit ON crit.repo_id = raw.repo_id),
sc AS (SELECT *, CASE WHEN has_hybrid AND s < 3 THEN 3 ELSE s END AS score FROM fin)
SELECT repo_id, CAST(least(CASE WHEN score <= 0 THEN 1 WHEN score <= 2 THEN 2 WHEN score <= 4 THEN 3 WHEN score <= 7 THEN 4 ELSE 5 END,
  CASE WHEN critical_count >= 10 THEN 2 WHEN critical_count >= 1 THEN 3 ELSE 5 END) AS INT) AS agility_level,
  CAST(score AS BIGINT) AS agility_score, has_hybrid, critical_count FROM sc"""


@check("agility_level", _LEVELS)
def agility_level(i: Inputs) -> DataFrame:
    files = i.files()
    found = detect.code_findings(files, context=False)
    return agility.agility_levels(files.select("repo_id"), agility.signal_rows(files), found).select(
        "repo_id", "agility_level", "agility_score", "has_hybrid", "critical_count")


@check("scan_cbom", _HITS + """
SELECT h.algorithm, a.algo_type, a.quantum_status,
  CASE a.quantum_status WHEN 'BROKEN' THEN 1 WHEN 'VULNERABLE' THEN 1 WHEN 'WEAK' THEN 2 WHEN 'MONITOR' THEN 3 WHEN 'SAFE' THEN 5 ELSE 3 END AS priority,
  CAST(CASE a.quantum_status WHEN 'BROKEN' THEN 10.0 WHEN 'VULNERABLE' THEN 8.5 WHEN 'WEAK' THEN 6.0 WHEN 'MONITOR' THEN 4.0 WHEN 'SAFE' THEN 1.0 ELSE 5.0 END AS DOUBLE) AS risk_score,
  count(*) AS total_usages, count(DISTINCT split_part(f.file_path, '/', 1)) AS affected_repos
FROM hits h JOIN files_v f ON f.doc_id = h.doc_id JOIN algo_v a ON a.algorithm = h.algorithm
GROUP BY ALL ORDER BY priority, h.algorithm""")
def scan_cbom(i: Inputs) -> DataFrame:
    found = detect.code_findings(i.files(), context=False)
    return bom.by_priority(bom.scan_inventory(found).select(
        "algorithm", "algo_type", "quantum_status", "priority", "risk_score", "total_usages", "affected_repos"))


@check("scan_run_stats", _HITS + """
SELECT f.repo_id, count(DISTINCT f.doc_id) AS total_files, count(DISTINCT f.doc_id) AS scanned_files,
       count(h.doc_id) AS total_findings
FROM files_v f LEFT JOIN hits h ON h.doc_id = f.doc_id GROUP BY f.repo_id""")
def scan_run_stats(i: Inputs) -> DataFrame:
    files = i.files()
    return reports.scan_run_stats(files, detect.code_hits(files))


_PEM_CASES = " ".join(
    f"WHEN regexp_matches(line, {quoted(p)}) THEN [{quoted(k)}, {quoted(a)}]" for p, k, a in secrets.PEM_HEADERS)
_GRADE = """CASE WHEN algorithm LIKE 'RSA%' THEN ['VULNERABLE', 'CRITICAL'] WHEN algorithm LIKE 'ECDSA%' THEN ['VULNERABLE', 'HIGH']
  WHEN algorithm LIKE 'DSA%' THEN ['BROKEN', 'CRITICAL'] ELSE ['VULNERABLE', 'MEDIUM'] END"""
_SECRETS = f"""WITH {_LINES},
pem AS (SELECT doc_id, CAST(ln AS INT) AS line_number, CASE {_PEM_CASES} END AS hit FROM doc_lines),
named AS (SELECT doc_id, line_number, hit[1] AS finding_type, hit[2] AS algorithm FROM pem WHERE hit IS NOT NULL),
graded AS (SELECT *, ({_GRADE})[1] AS quantum_status, ({_GRADE})[2] AS risk_level FROM named)
"""


@check("secret_hits", _SECRETS + "SELECT doc_id, line_number, finding_type, algorithm, quantum_status, risk_level FROM graded")
def secret_hits(i: Inputs) -> DataFrame:
    return secrets.find(i.files(), KEYS).select(
        "doc_id", "line_number", "finding_type", "algorithm", "quantum_status", "risk_level")


@check("secret_summary", _SECRETS + """
SELECT 'by_risk' AS metric, risk_level AS key, count(*) AS n FROM graded GROUP BY risk_level
UNION ALL SELECT 'total', NULL, count(*) FROM graded UNION ALL SELECT 'expiring', NULL, 0 FROM (SELECT 1)""")
def secret_summary(i: Inputs) -> DataFrame:
    found = secrets.find(i.files(), KEYS).withColumn("expiry_status", F.lit(None).cast("string"))
    return reports.secrets_summary(found)


_CERT_AS_OF = "1998-06-01 00:00:00"


@check("certificate_grades", f"""
SELECT finding_id, key_type, key_size,
  CASE WHEN cert_not_after < TIMESTAMP '{_CERT_AS_OF}' THEN 'EXPIRED'
    WHEN floor((epoch(cert_not_after) - epoch(TIMESTAMP '{_CERT_AS_OF}')) / 86400) < 30 THEN 'EXPIRES_SOON'
    WHEN floor((epoch(cert_not_after) - epoch(TIMESTAMP '{_CERT_AS_OF}')) / 86400) < 90 THEN 'EXPIRES_90D' ELSE 'VALID' END AS expiry_status,
  CASE WHEN (key_type = 'RSA' AND key_size <= 1024) OR key_type = 'DSA' THEN 'BROKEN' WHEN finding_id % 3 = 0 THEN 'WEAK' ELSE 'VULNERABLE' END AS quantum_status,
  CASE WHEN cert_not_after < TIMESTAMP '{_CERT_AS_OF}' OR (key_type = 'RSA' AND key_size <= 1024) OR key_type = 'DSA' THEN 'CRITICAL'
    WHEN finding_id % 3 = 0 THEN 'HIGH' WHEN key_type = 'RSA' THEN 'CRITICAL' WHEN key_type = 'EC' THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
FROM tls_v""")
def certificate_grades(i: Inputs) -> DataFrame:
    rows = i.view("tls_v").select(
        "finding_id", "key_type", "key_size", F.col("key_curve").alias("curve"),
        F.when(F.col("finding_id") % 3 == 0, "SHA1").otherwise("sha256").alias("sig_hash"),
        F.col("cert_not_after").cast("timestamp").alias("not_after"))
    return secrets.grade_certificates(rows, F.lit(_CERT_AS_OF).cast("timestamp")).select(
        "finding_id", "key_type", "key_size", "expiry_status", "quantum_status", "risk_level")


# ssh public keys and config lines written from the part table
_SSH_FILES = """
SELECT p_partkey % 10 AS repo_id,
  concat('k', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/id.pub' WHEN 1 THEN '/authorized_keys' ELSE '/sshd_config' END) AS file_path,
  CASE WHEN p_partkey % 3 = 2 THEN concat('Port 22', chr(10), 'Ciphers ', CASE WHEN p_size % 2 = 0 THEN 'aes256-ctr,arcfour' ELSE 'aes256-ctr' END, chr(10), '  KexAlgorithms curve25519-sha256')
    ELSE concat(CASE p_size % 4 WHEN 0 THEN 'ssh-rsa ' WHEN 1 THEN 'ssh-ed25519 ' WHEN 2 THEN 'ecdsa-sha2-nistp384 ' ELSE 'ssh-dss ' END,
      repeat('A', CASE WHEN p_size % 4 > 0 THEN 68 WHEN p_partkey % 2 = 0 THEN 372 ELSE 204 END), ' user@host') END AS content
FROM part"""


@check("ssh_material", f"""
WITH src AS ({_SSH_FILES.replace(' AS content', ' AS content, p_size, p_partkey')}),
hits AS (
 SELECT repo_id, file_path, 2 AS line_number, 'SSH_CONFIG' AS finding_type, 'Ciphers' AS algorithm, CASE WHEN p_size % 2 = 0 THEN 'BROKEN' ELSE 'VULNERABLE' END AS quantum_status, CASE WHEN p_size % 2 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level FROM src WHERE p_partkey % 3 = 2
 UNION ALL SELECT repo_id, file_path, 3, 'SSH_CONFIG', 'KexAlgorithms', 'VULNERABLE', 'HIGH' FROM src WHERE p_partkey % 3 = 2
 UNION ALL SELECT repo_id, file_path, 1, CASE p_partkey % 3 WHEN 0 THEN 'SSH_PUBLIC_KEY' ELSE 'AUTHORIZED_KEY' END,
   CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'RSA-2048' ELSE 'RSA-1024' END WHEN 1 THEN 'Ed25519' WHEN 2 THEN 'ECDSA-nistp384' ELSE 'DSA' END,
   CASE WHEN (p_size % 4 = 0 AND p_partkey % 2 = 1) OR p_size % 4 = 3 THEN 'BROKEN' ELSE 'VULNERABLE' END,
   CASE p_size % 4 WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END FROM src WHERE p_partkey % 3 <> 2)
SELECT * FROM hits""")
def ssh_material(i: Inputs) -> DataFrame:
    return secrets.find(i.sql(_SSH_FILES)).select(
        "repo_id", "file_path", "line_number", "finding_type", "algorithm", "quantum_status", "risk_level")


@check("printable_strings", """
SELECT doc_id, array_to_string(regexp_extract_all(content, '[\\x20-\\x7e]{6,}'), chr(10)) AS printable FROM files_v""")
def printable_strings(i: Inputs) -> DataFrame:
    return i.files().select("doc_id", native.printable_text(F.encode("content", "UTF-8")).alias("printable"))


def _native_sql() -> str:
    parts = []
    for n, (pattern, algorithm, *_rest) in enumerate(grades.NATIVE_SYMBOLS):
        parts.append(f"SELECT doc_id, {n} AS ord, {quoted(algorithm)} AS algorithm, "
                     f"regexp_extract(content, {quoted(pattern)}) AS symbol FROM binaries")
    return " UNION ALL ".join(parts)


_BINARIES = """
SELECT doc_id, concat(content, chr(10), CASE doc_id % 6 WHEN 0 THEN 'MD5_Init and EVP_des' WHEN 1 THEN 'x RSA_sign y wc_RsaPublicEncrypt'
  WHEN 2 THEN 'ECDSA_verify RC4_set_key' WHEN 3 THEN 'javax/crypto/Cipher java/security/Signature' WHEN 4 THEN 'DH_compute_key' ELSE 'none' END) AS content
FROM files_v"""


@check("native_symbols", f"""
WITH binaries AS ({_BINARIES}),
found AS (SELECT * FROM ({_native_sql()}) WHERE symbol <> '')
SELECT doc_id, algorithm, symbol FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, algorithm ORDER BY ord) = 1""")
def native_symbols(i: Inputs) -> DataFrame:
    rows = i.spread(_BINARIES)
    rows = rows.select("doc_id", native.printable_text(F.encode("content", "UTF-8")).alias("text"))
    return native.symbol_hits(rows).select("doc_id", "algorithm", "symbol")


@check("endpoint_parse", """
SELECT finding_id, regexp_extract(endpoint_raw, '//([^:/]+)', 1) AS host,
  CASE WHEN endpoint_raw LIKE '%:8443/%' THEN 8443 ELSE 443 END AS port,
  regexp_extract(endpoint_raw, '//([^:/]+)', 1) || CASE WHEN endpoint_raw LIKE '%:8443/%' THEN ':8443' ELSE ':443' END AS endpoint FROM tls_v""")
def endpoint_parse(i: Inputs) -> DataFrame:
    return tls.with_endpoint(i.view("tls_v")).select("finding_id", "host", "port", "endpoint")
