"""The engine's inputs derived from the given tables.

The same SQL text runs in Spark and in DuckDB, so a query and its check start
from the same rows.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from keyfathom.dims.registry import REGISTRY
from keyfathom.session import use_utc

_ALGORITHMS = ",".join(
    f"({i},'{a.name}','{a.algo_type}','{a.quantum_status}','{a.risk_level}')" for i, a in enumerate(REGISTRY))

VIEWS: dict[str, str] = {
    "algo_v": f"""
SELECT * FROM (VALUES {_ALGORITHMS}) AS t(idx, algorithm, algo_type, quantum_status, risk_level)""",
    "projects_v": "SELECT n_nationkey AS project_id, n_name AS name FROM nation",
    "repos_v": """
SELECT s_suppkey AS repo_id, s_name AS name, s_nationkey AS project_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'develop' ELSE 'main' END AS branch,
  concat('https://git.example.com/org/r', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '.git' ELSE '' END) AS url,
  CASE s_suppkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'UNKNOWN' END AS risk_level,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1 + s_suppkey % 5 END AS agility_level,
  s_suppkey % 11 = 0 AS has_hybrid
FROM supplier""",
    "scan_runs_v": """
SELECT o_orderkey AS scan_run_id, o_custkey % 10 AS repo_id,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN 'artifact' ELSE 'code' END AS scan_type,
  o_orderdate AS started_at
FROM orders""",
    "findings_v": """
SELECT l_suppkey AS repo_id, l_orderkey AS scan_run_id,
  concat('src/m', l_partkey % 20, CASE WHEN l_partkey % 6 = 0 THEN '/tests/' ELSE '/' END, 'f', l_linenumber, '.py') AS file_path,
  CAST(l_quantity AS INT) AS line_number,
  a.algorithm, a.algo_type, a.quantum_status, a.risk_level,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'open' WHEN 'AO' THEN 're_opened'
    WHEN 'NF' THEN 'auto_resolved' WHEN 'NO' THEN 'manually_resolved' WHEN 'RF' THEN 'false_positive' ELSE 'open' END AS migration_status,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'ML-KEM-768' END AS migrated_to,
  l_discount > 0.08 AS archived,
  CASE l_partkey % 5 WHEN 0 THEN 'dependency' WHEN 1 THEN 'artifact' ELSE 'source_code' END AS source_type,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS reachable,
  CASE WHEN l_partkey % 4 > 1 THEN l_linenumber END AS call_depth,
  l_shipdate AS created_at
FROM lineitem JOIN algo_v a ON a.idx = l_partkey % 29""",
    "findings_id_v": """
SELECT o_orderkey AS finding_id, o_custkey % 10 AS repo_id, o_orderkey % 50 AS scan_run_id,
  concat('src/f', o_custkey % 40, '.py') AS file_path, a.algorithm, a.risk_level, a.quantum_status,
  CASE o_orderkey % 6 WHEN 0 THEN 're_opened' WHEN 1 THEN 'auto_resolved' WHEN 2 THEN 'manually_resolved'
    WHEN 3 THEN 'false_positive' ELSE 'open' END AS migration_status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Missed scan: 00000001' END AS resolution_note,
  CASE WHEN o_orderkey % 3 = 0 THEN 'dependency' ELSE 'source_code' END AS source_type,
  o_orderkey % 9 = 0 AS archived, o_orderdate AS created_at
FROM orders JOIN algo_v a ON a.idx = o_orderkey % 29""",
    "new_pairs_v": """
SELECT DISTINCT o_custkey % 10 AS repo_id, concat('src/f', o_custkey % 40, '.py') AS file_path, a.algorithm
FROM orders JOIN algo_v a ON a.idx = (o_orderkey * 7) % 29
WHERE o_orderkey % 8 = 0""",
    "cves_v": """
SELECT o_orderkey AS finding_id, concat('CVE-2024-', 1000 + o_custkey % 40) AS cve_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS cvss_severity
FROM orders WHERE o_orderkey % 5 < 2""",
    "raw_events_v": """
SELECT event_id, ts, concat('host-', user_id % 7) AS host_id, user_id AS pid,
  event_id % 20 AS probe_id, event_type AS comm
FROM events""",
    "files_v": """
SELECT doc_id, doc_id % 10 AS repo_id,
  concat(CASE WHEN doc_id % 8 = 0 THEN 'pkg/tests/' WHEN doc_id % 8 = 1 THEN 'vendor/' ELSE 'src/' END, lang, '/d', doc_id,
    CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.go' WHEN 3 THEN '.c' ELSE '.md' END) AS file_path,
  concat(text, chr(10), replace(s.snippet, '~', chr(10)), chr(10), 'end') AS content
FROM documents JOIN (SELECT * FROM (VALUES
 (0,'h = hashlib.md5(data)'),(1,'SHA1_Init(&ctx);'),(2,'key = RSA.generate(2048)'),
 (3,'RSA_generate_key(r,~    1024, e);'),(4,'ssh-keygen -b 2048 -t rsa'),(5,'m = TLSv1_2_method();'),
 (6,'ECDH_compute_key(a, b);'),(7,'use ML-KEM-768 and ML-DSA-65'),(8,'-----BEGIN RSA PRIVATE KEY-----'),
 (9,'r = CryptoRegistry.registry.get(alg)'),(10,'algorithm config loader'),(11,'HybridKEM X25519 + ML-KEM-768'),
 (12,'LoadSchedulingAlgorithm config algorithm'),(13,'nothing to see'),(14,'cipher = AES_128_CBC'),
 (15,'KexAlgorithms ecdh-sha2-nistp256'),(16,'RSA.generate(1024)~RSA.generate(1024)')
) AS t(k, snippet)) s ON s.k = doc_id % 17""",
    "packages_v": """
SELECT p_partkey AS ord, p_partkey % 10 AS repo_id,
  concat('svc', p_partkey % 30, CASE n.ecosystem WHEN 'npm' THEN '/package.json' ELSE '/requirements.txt' END) AS manifest,
  n.ecosystem, n.name,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(p_size % 5, '.', p_partkey % 12, CASE WHEN p_size % 3 = 0 THEN '' ELSE '.0' END) END AS version
FROM part JOIN (SELECT * FROM (VALUES
 (0,'pypi','pyjwt'),(1,'pypi','cryptography'),(2,'pypi','requests'),(3,'pypi','paramiko'),(4,'pypi','django'),
 (5,'npm','jsonwebtoken'),(6,'npm','md5'),(7,'npm','left-pad'),(8,'npm','crypto-js'),(9,'npm','passport'),(10,'pypi','passlib')
) AS t(k, ecosystem, name)) n ON n.k = p_partkey % 11""",
    "functions_v": """
SELECT p_partkey AS func_id, concat('src/f', p_partkey % 40, '.py') AS file_path,
  concat('fn', p_partkey % 700) AS name,
  CAST(floor(p_partkey / 40) * 10 + 1 AS INT) AS start_line,
  CAST(floor(p_partkey / 40) * 10 + CASE WHEN p_partkey % 3 = 0 THEN 25 ELSE 9 END AS INT) AS end_line,
  p_partkey % 1000 = 0 AS is_entry
FROM part""",
    "calls_v": """
SELECT p_partkey AS caller_id, concat('fn', (p_partkey * 2 + 1) % 700) AS callee_name
FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 7 <> 3
UNION ALL SELECT p_partkey AS caller_id, concat('fn', (p_partkey * 2 + 2) % 700) AS callee_name
FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 7 <> 3""",
    "tls_v": """
SELECT o_orderkey AS finding_id, concat('https://h', o_custkey, '.example.com', CASE WHEN o_custkey % 3 = 0 THEN ':8443/x' ELSE '/' END) AS endpoint_raw,
  CASE o_orderkey % 5 WHEN 0 THEN 'TLSv1' WHEN 1 THEN 'TLSv1.1' WHEN 2 THEN 'TLSv1.2' WHEN 3 THEN 'TLSv1.3' ELSE 'SSLv3' END AS tls_version,
  CASE o_custkey % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' WHEN 2 THEN 'Ed25519' ELSE 'DSA' END AS key_type,
  CASE o_custkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 4096 END AS key_size,
  CASE o_custkey % 2 WHEN 0 THEN 'secp256r1' ELSE 'secp384r1' END AS key_curve,
  CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'complete' END AS scan_status,
  o_orderdate AS cert_not_after
FROM orders""",
}

TABLES = ["nation", "supplier", "part", "orders", "lineitem", "events", "documents"]


@cache
def _needs(view: str) -> tuple[str, ...]:
    """Views a view is built on, in the order they have to be created."""
    words = set(re.findall(r"\w+", VIEWS[view]))
    found: list[str] = []
    for other in VIEWS:
        if other != view and other in words:
            found += [v for v in (*_needs(other), other) if v not in found]
    return tuple(found)


def with_views(sql: str) -> str:
    """The SQL preceded by definitions of the views it names."""
    words = set(re.findall(r"\w+", sql))
    needed: list[str] = []
    for view in VIEWS:
        if view in words:
            needed += [v for v in (*_needs(view), view) if v not in needed]
    if not needed:
        return sql.strip()
    defined = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else ""
    body = re.sub(r"^\s*WITH (RECURSIVE )?", ",\n", sql) if re.match(r"\s*WITH\b", sql) else "\n" + sql.strip()
    return f"WITH {recursive}{defined}{body}"


class Inputs:
    """Views over one data folder; nothing is registered in the session's catalog under fixed names."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        use_utc(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, deal: bool = False) -> DataFrame:
        """Run SQL over the views and the tables of this folder, dealt out first if told so."""
        full = with_views(text)
        words = set(re.findall(r"\w+", full))
        read = self._dealt if deal else self.table
        return self.spark.sql(_bind(full, words), **{t: read(t) for t in TABLES if t in words})

    def _dealt(self, name: str) -> DataFrame:
        """A table by its first column on all cores, where it lies in fewer file splits than there are cores.

        Tables of short rows lie in one split when they already make heavy work.
        """
        cores, rows = self.spark.sparkContext.defaultParallelism, self.table(name)
        return rows.repartition(cores, rows.columns[0]) if rows.rdd.getNumPartitions() < cores else rows

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def files(self) -> DataFrame:
        return self.spread("SELECT * FROM files_v")

    def spread(self, text: str) -> DataFrame:
        """SQL over the documents, for work that is heavy per row.

        Data in fewer file splits than there are cores, as a small test set is,
        is dealt out to all cores; a large one is read as it lies.
        """
        cores = self.spark.sparkContext.defaultParallelism
        rows = self.sql(text)
        return rows.repartition(cores) if self.table("documents").rdd.getNumPartitions() < cores else rows


def _bind(sql: str, words: set[str]) -> str:
    """Mark table names as the DataFrame arguments of ``spark.sql``."""
    bound = sql.replace("{", "{{").replace("}", "}}")
    for table in TABLES:
        if table in words:
            bound = re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}} {table}", bound)
    return bound
