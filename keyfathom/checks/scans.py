"""Checks of a whole repository scan: what it finds besides code, and the tables after two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom import schemas
from keyfathom.checks.base import check
from keyfathom.checks.detection import _EXT, _EXTENSIONS, _HITS, _LEVELS, _LINES, _SECRETS, _SKIP, _TEST, _VENDOR
from keyfathom.checks.supply import _CUR, _EXPECTED, _MANIFESTS, _key
from keyfathom.checks.views import Inputs
from keyfathom.operators import dependencies, manifests
from keyfathom.plans import scans

_SOURCE = f"({_EXT} IN ({_EXTENSIONS}) AND len(list_intersect(string_split(file_path, '/')[:-2], [{_SKIP}])) = 0)"


def _files(i: Inputs, *parts: str) -> DataFrame:
    """Source files and further ones, as (repo_id, file_path, content)."""
    rows = i.files().select("repo_id", "file_path", "content")
    for part in parts:
        rows = rows.unionByName(i.sql(part, deal=True).select("repo_id", "file_path", "content"))
    return rows


_DECLARED = f"""{_CUR}, m AS ({_MANIFESTS}), p AS ({_EXPECTED}),
declared AS (SELECT p.repo_id, p.manifest, p.name AS dependency_name, c.algorithm, c.risk_level FROM p JOIN cur c ON c.ecosystem = p.ecosystem AND c.name = p.name
  WHERE c.vulnerable_below IS NULL OR p.version = '' OR {_key('p.version')} < {_key('c.vulnerable_below')})"""


@check("repository_scan_dependencies", f"WITH {_DECLARED} SELECT repo_id, manifest, dependency_name, algorithm FROM declared")
def repository_scan_dependencies(i: Inputs) -> DataFrame:
    found = scans.scan_repositories(_files(i, _MANIFESTS), reachability=False)
    return found.dependencies.select("repo_id", "manifest", "dependency_name", "algorithm")


@check("repository_scan_secrets", _SECRETS + """
SELECT f.repo_id, f.file_path, g.line_number, g.finding_type, g.algorithm, g.quantum_status, g.risk_level
FROM graded g JOIN files_v f ON f.doc_id = g.doc_id""")
def repository_scan_secrets(i: Inputs) -> DataFrame:
    found = scans.scan_repositories(_files(i, _MANIFESTS), reachability=False)
    return found.secrets.select("repo_id", "file_path", "line_number", "finding_type", "algorithm", "quantum_status", "risk_level")


@check("repository_scan_agility", _LEVELS.replace(f"NOT {_TEST} AND NOT {_VENDOR}", f"NOT {_TEST} AND NOT {_VENDOR} AND {_SOURCE}"))
def repository_scan_agility(i: Inputs) -> DataFrame:
    return scans.scan_repositories(_files(i), reachability=False).agility.select(
        "repo_id", "agility_level", "agility_score", "has_hybrid", "critical_count")


@check("repository_scan_risk", _SECRETS + f""", {_HITS.replace(_LINES, '').replace('WITH ,', '').strip()}, {_DECLARED},
levels AS (
  SELECT f.repo_id, a.risk_level FROM hits h JOIN files_v f ON f.doc_id = h.doc_id JOIN algo_v a ON a.algorithm = h.algorithm WHERE {_SOURCE}
  UNION ALL SELECT repo_id, risk_level FROM declared
  UNION ALL SELECT f.repo_id, g.risk_level FROM graded g JOIN files_v f ON f.doc_id = g.doc_id)
SELECT repo_id, arg_min(risk_level, CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS risk_level
FROM levels GROUP BY repo_id""")
def repository_scan_risk(i: Inputs) -> DataFrame:
    return scans.scan_repositories(_files(i, _MANIFESTS), reachability=False).risk.select("repo_id", "risk_level")


# one program per part: a function that its entry reaches and one that nothing calls (~ marks a newline)
_PROGRAMS = """SELECT p_partkey % 10 AS repo_id, concat('prog/p', p_partkey, '.py') AS file_path,
  replace(concat('import hashlib~~def first', p_partkey, '():~    go', p_partkey, '()~~def go', p_partkey, '():~    return hashlib.md5(b"x")~~def dead',
    p_partkey, '():~    return hashlib.sha1(b"x")~~if __name__ == "__main__":~    first', p_partkey, '()~'), '~', chr(10)) AS content FROM part"""


@check("repository_scan_reachability", """
SELECT p_partkey % 10 AS repo_id, 'prog/p' || p_partkey || '.py' AS file_path, unnest(['MD5', 'SHA-1']) AS algorithm, unnest([7, 10]) AS line_number,
  unnest([true, false]) AS reachable, unnest([2, NULL]) AS call_depth,
  unnest(['__main__ > first' || p_partkey || '@3 > go' || p_partkey || '@6', '']) AS chain FROM part""")
def repository_scan_reachability(i: Inputs) -> DataFrame:
    found = scans.scan_repositories(_files(i, _PROGRAMS)).code.where("file_path LIKE 'prog/%'")
    return found.select("repo_id", "file_path", "algorithm", "line_number", "reachable", "call_depth",
                        F.array_join("call_chain", " > ").alias("chain"))


# two scans: the second one of even repositories only, whose manifests say less and whose secrets have other lines
_KEYS = """SELECT p_partkey % 10 AS repo_id, concat('keys/id', p_partkey) AS file_path, p_size AS line_number FROM part WHERE p_partkey % 3 = 0"""


def _scan(i: Inputs, second: bool) -> tuple[scans.RepositoryScan, DataFrame]:
    packages = manifests.parse(i.sql(_MANIFESTS, deal=True))
    keys = i.sql(_KEYS)
    if second:
        packages = packages.where("repo_id % 2 = 0 AND ecosystem <> 'pypi'")
        keys = keys.where("repo_id % 2 = 0").withColumn("line_number", F.col("line_number") + 100)
    deps = dependencies.dependency_findings(packages)
    hidden = keys.withColumns({"finding_type": F.lit("SSH_PRIVATE_KEY"), "algorithm": F.lit("RSA"), "config_key": F.lit(None).cast("string"),
                               "config_value": F.lit(None).cast("string")})
    code = i.view("new_pairs_v").where("repo_id % 2 = 0" if second else "true").select(
        "repo_id", "file_path", "algorithm", F.lit(1).alias("line_number"), F.lit("source_code").alias("source_type"))
    scan = scans.RepositoryScan(code=code, dependencies=deps, cves=dependencies.curated_cves(deps), secrets=hidden, agility=None,
                                risk=None, stats=None)
    runs = i.sql("SELECT DISTINCT s_suppkey % 10 AS repo_id FROM supplier").where("repo_id % 2 = 0" if second else "true")
    return scan, runs.withColumn("scan_run_id", F.lit("2" if second else "1"))


@check("next_tables", f"""
WITH {_DECLARED},
repos AS (SELECT DISTINCT s_suppkey % 10 AS repo_id FROM supplier),
kinds AS (SELECT p.repo_id, p.ecosystem, p.manifest, p.name, c.algorithm, c.reason FROM p JOIN cur c ON c.ecosystem = p.ecosystem AND c.name = p.name
  WHERE c.vulnerable_below IS NULL OR p.version = '' OR {_key('p.version')} < {_key('c.vulnerable_below')}),
k AS ({_KEYS})
SELECT 'dependency' AS kind, kinds.repo_id, CASE WHEN kinds.repo_id % 2 = 0 THEN '2' ELSE '1' END AS scan_run_id, count(*) AS n FROM kinds JOIN repos ON repos.repo_id = kinds.repo_id
  WHERE kinds.repo_id % 2 = 1 OR ecosystem <> 'pypi' GROUP BY ALL
UNION ALL SELECT 'cve', kinds.repo_id, CASE WHEN kinds.repo_id % 2 = 0 THEN '2' ELSE '1' END, CAST(sum(len(regexp_extract_all(reason, 'CVE-\\d{{4}}-\\d+'))) AS BIGINT) FROM kinds JOIN repos ON repos.repo_id = kinds.repo_id
  WHERE (kinds.repo_id % 2 = 1 OR ecosystem <> 'pypi') AND regexp_matches(reason, 'CVE-\\d{{4}}-\\d+') GROUP BY ALL
UNION ALL SELECT 'secret', k.repo_id, CASE WHEN k.repo_id % 2 = 0 THEN '2' ELSE '1' END, count(*) FROM k JOIN repos ON repos.repo_id = k.repo_id GROUP BY ALL
UNION ALL SELECT 'source_code', n.repo_id, CASE WHEN n.repo_id % 2 = 0 THEN '2' ELSE '1' END, count(*) FROM new_pairs_v n JOIN repos ON repos.repo_id = n.repo_id GROUP BY ALL""")
def next_tables(i: Inputs) -> DataFrame:
    """Rows per kind, repository and scan after two scans that began with empty tables."""
    findings, hidden, cves = (i.spark.createDataFrame([], s).withColumn("repo_id", F.col("repo_id").cast("long")) if "repo_id" in s
                              else i.spark.createDataFrame([], s) for s in (schemas.FINDINGS, schemas.SECRETS, schemas.CVES))
    scans.checkpoint_dir(i.spark)
    for second in (False, True):
        scan, runs = _scan(i, second)
        after = (scans.next_findings(findings, scan, runs, F.lit("2024-01-01").cast("timestamp")), scans.next_secrets(hidden, scan, runs),
                 scans.next_cves(cves, findings, scan, runs))
        findings, hidden, cves = (t.checkpoint() for t in after)
    rows = findings.select(F.col("source_type").alias("kind"), "repo_id", "scan_run_id").unionByName(
        hidden.select(F.lit("secret").alias("kind"), "repo_id", "scan_run_id")).unionByName(
        cves.join(findings.select("finding_id", "repo_id", "scan_run_id"), "finding_id").select(F.lit("cve").alias("kind"), "repo_id", "scan_run_id"))
    return rows.groupBy("kind", "repo_id", "scan_run_id").agg(F.count("*").alias("n"))
