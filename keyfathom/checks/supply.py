"""Checks of manifests, dependencies, advisories and package archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.checks.base import check, quoted
from keyfathom.checks.views import Inputs
from keyfathom.dims import packages as dim
from keyfathom.operators import dependencies, manifests
from keyfathom.sources import archives

_CURATED = ", ".join("(" + ", ".join("NULL" if v is None else quoted(v) for v in row) + ")" for row in dim.CURATED_PACKAGES)
_CUR = f"cur AS (SELECT * FROM (VALUES {_CURATED}) AS t({', '.join(dim.COLUMNS)}))"


def _key(version: str) -> str:
    return (f"list_transform(list_filter(string_split(regexp_replace(split_part(split_part({version}, '+', 1), '-', 1), "
            f"'[^0-9.]', '', 'g'), '.'), lambda x: x <> ''), lambda x: CAST(x AS BIGINT))")


_HITS = f"""WITH {_CUR}, hits AS (
  SELECT p.*, c.algorithm, c.risk_level, c.quantum_status, c.reason FROM packages_v p JOIN cur c ON c.ecosystem = p.ecosystem AND c.name = lower(p.name)
  WHERE c.vulnerable_below IS NULL OR p.version = '' OR {_key('p.version')} < {_key('c.vulnerable_below')})
"""


@check("version_keys", f"""SELECT ord, array_to_string({_key('version')}, '.') AS version_key,
  {_key('version')} < [2, 4, 0] AS older FROM packages_v WHERE version <> ''""")
def version_keys(i: Inputs) -> DataFrame:
    rows = i.view("packages_v").where("version <> ''")
    key = dependencies.version_key(F.col("version"))
    return rows.select("ord", F.array_join(key.cast("array<string>"), ".").alias("version_key"),
                       (key < dependencies.version_key(F.lit("2.4.0"))).alias("older"))


@check("curated_packages", _HITS + """
SELECT repo_id, manifest, name AS dependency_name, version AS dependency_version, algorithm, risk_level, quantum_status FROM hits
QUALIFY row_number() OVER (PARTITION BY repo_id, manifest, lower(name) ORDER BY ord) = 1""")
def curated_packages(i: Inputs) -> DataFrame:
    return dependencies.dependency_findings(i.view("packages_v")).select(
        "repo_id", "manifest", "dependency_name", "dependency_version", "algorithm", "risk_level", "quantum_status")


@check("artifact_packages", _HITS + """
SELECT repo_id, manifest, algorithm, name AS dependency_name, name || CASE WHEN version <> '' THEN ' ' || version ELSE '' END || ' — ' || reason AS context FROM hits
QUALIFY row_number() OVER (PARTITION BY repo_id, manifest, algorithm ORDER BY ord) = 1""")
def artifact_packages(i: Inputs) -> DataFrame:
    return dependencies.artifact_findings(i.view("packages_v")).select(
        "repo_id", "manifest", "algorithm", "dependency_name", "context")


@check("curated_cves", _HITS + """, once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY repo_id, manifest, lower(name) ORDER BY ord) = 1)
SELECT repo_id, manifest, name AS dependency_name, unnest(regexp_extract_all(reason, 'CVE-\\d{4}-\\d+')) AS cve_id, risk_level AS cvss_severity FROM once""")
def curated_cves(i: Inputs) -> DataFrame:
    found = dependencies.dependency_findings(i.view("packages_v"))
    return dependencies.curated_cves(found).select("repo_id", "manifest", "dependency_name", "cve_id", "cvss_severity")


@check("lookup_packages", """
SELECT ecosystem, name, arg_max(version, ord) AS version FROM packages_v GROUP BY ecosystem, name""")
def lookup_packages(i: Inputs) -> DataFrame:
    return dependencies.lookup_packages(i.view("packages_v"))


@check("layer_packages", """
SELECT repo_id, ecosystem, name, version FROM (SELECT *, ord % 5 AS layer FROM packages_v)
QUALIFY row_number() OVER (PARTITION BY repo_id, ecosystem, name ORDER BY layer, manifest, ord) = 1""")
def layer_packages(i: Inputs) -> DataFrame:
    rows = i.view("packages_v").withColumn("layer", F.col("ord") % 5)
    return dependencies.layer_packages(rows, ["repo_id"]).select("repo_id", "ecosystem", "name", "version")


@check("dependency_tree", _HITS + """, once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY repo_id, manifest, lower(name) ORDER BY ord) = 1)
SELECT repo_id, manifest, name AS dependency_name, version AS dependency_version, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS algorithms,
  CASE min(CASE quantum_status WHEN 'BROKEN' THEN 0 WHEN 'VULNERABLE' THEN 1 WHEN 'WEAK' THEN 2 WHEN 'MONITOR' THEN 3 ELSE 4 END)
    WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'VULNERABLE' WHEN 2 THEN 'WEAK' WHEN 3 THEN 'MONITOR' ELSE 'SAFE' END AS worst_status
FROM once GROUP BY ALL""")
def dependency_tree(i: Inputs) -> DataFrame:
    found = dependencies.dependency_findings(i.view("packages_v"))
    return dependencies.dependency_tree(found).withColumn("algorithms", F.array_join("algorithms", ","))


# advisories written over the documents: their whole texts are the details
_ADVISORIES = """SELECT concat('ADV-', doc_id) AS id, CASE doc_id % 3 WHEN 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
  CASE doc_id % 7 WHEN 0 THEN 'passport' WHEN 1 THEN 'pyjwt' WHEN 2 THEN 'django' WHEN 3 THEN 'left-pad' WHEN 4 THEN 'requests' WHEN 5 THEN 'paramiko' ELSE 'passlib' END AS package,
  concat('flaw in ', CASE doc_id % 6 WHEN 0 THEN 'rsa padding' WHEN 1 THEN 'ecdsa nonce' WHEN 2 THEN 'jwt check' WHEN 3 THEN 'parser' WHEN 4 THEN 'md5 use' ELSE 'tls' END) AS summary,
  text AS details, CASE doc_id % 5 WHEN 0 THEN 'CVSS:3.1/AV:N' WHEN 1 THEN '9.8' WHEN 2 THEN '7.5' WHEN 3 THEN '4.0' ELSE 'score 2.1' END AS score FROM documents"""


def _advisories(i: Inputs) -> DataFrame:
    rows = i.spread(_ADVISORIES)
    return rows.select("id", "ecosystem", "package", "summary", "details", F.array().cast("array<string>").alias("aliases"),
                       F.array("score").alias("severity"))


_KEYWORDS = " OR ".join(f"contains(said, {quoted(k)})" for k in dim.ADVISORY_KEYWORDS)
_INFER = " ".join(f"WHEN contains(said, {quoted(k)}) THEN {quoted(a)}" for k, a in dim.ADVISORY_ALGORITHMS)
_GRADED = f"""adv AS ({_ADVISORIES}),
graded AS (SELECT id, lower(ecosystem) AS ecosystem, package AS name, summary, CASE {_INFER} ELSE 'RSA-2048' END AS algorithm,
  CASE WHEN score LIKE '%.1' OR score IN ('9.8', '7.5', '4.0') THEN CASE WHEN score = '9.8' THEN 9.8 WHEN score = '7.5' THEN 7.5 WHEN score = '4.0' THEN 4.0 WHEN score LIKE 'CVSS%' THEN NULL ELSE 2.1 END END AS s
  FROM (SELECT *, lower(summary || ' ' || details) AS said FROM adv) WHERE {_KEYWORDS}),
risked AS (SELECT id, ecosystem, name, summary, algorithm, CAST(s AS DOUBLE) AS cvss_score,
  CASE WHEN s IS NULL THEN 'HIGH' WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM graded)"""


@check("advisory_grades", f"WITH {_GRADED} SELECT id, ecosystem, name, algorithm, cvss_score, risk_level FROM risked")
def advisory_grades(i: Inputs) -> DataFrame:
    # the feed ends a plain CVSS vector with its version number only inside the prefix
    return dependencies.grade_advisories(_advisories(i)).select("id", "ecosystem", "name", "algorithm", "cvss_score", "risk_level")


@check("advisory_findings", f"""WITH {_GRADED}
SELECT p.repo_id, p.manifest, p.name AS dependency_name, r.algorithm, r.id AS cve_id, r.risk_level, p.version AS dependency_version
FROM packages_v p JOIN risked r ON r.ecosystem = p.ecosystem AND r.name = lower(p.name)
QUALIFY row_number() OVER (PARTITION BY p.repo_id, p.manifest, lower(p.name), r.algorithm ORDER BY p.ord, r.id) = 1""")
def advisory_findings(i: Inputs) -> DataFrame:
    return dependencies.advisory_findings(i.view("packages_v"), _advisories(i)).select(
        "repo_id", "manifest", "dependency_name", "algorithm", "cve_id", "risk_level", "dependency_version")


_DEPS = """SELECT f.*, CASE f.finding_id % 4 WHEN 0 THEN 'PyJWT' WHEN 1 THEN 'django' WHEN 2 THEN '' ELSE 'requests' END AS dependency_name, 'pypi' AS ecosystem FROM findings_id_v f"""


@check("cve_backfill", f"""WITH {_GRADED}, deps AS ({_DEPS})
SELECT d.finding_id, r.id AS cve_id, r.risk_level AS cvss_severity FROM deps d JOIN risked r ON r.ecosystem = d.ecosystem AND r.name = lower(d.dependency_name)
WHERE d.source_type = 'dependency' AND NOT d.archived AND d.dependency_name <> '' AND d.finding_id NOT IN (SELECT finding_id FROM cves_v)""")
def cve_backfill(i: Inputs) -> DataFrame:
    return dependencies.backfill_cves(i.sql(_DEPS), i.view("cves_v"), _advisories(i)).select("finding_id", "cve_id", "cvss_severity")


# one manifest per part, of one of seven kinds (~ marks a newline)
_V = "concat(p_size % 5, '.', p_partkey % 12, '.0')"
_MANIFESTS = f"""SELECT p_partkey % 10 AS repo_id, p_partkey, p_size, {_V} AS v,
  concat('svc', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '/requirements-dev.txt' WHEN 1 THEN '/pyproject.toml' WHEN 2 THEN '/package.json'
    WHEN 3 THEN '/go.mod' WHEN 4 THEN '/Cargo.toml' WHEN 5 THEN '/pom.xml' ELSE '/Gemfile.lock' END) AS file_path,
  replace(CASE p_partkey % 7
    WHEN 0 THEN concat('# pinned~PyJWT==', {_V}, '~-r base.txt~Flask[async]>=', p_size, '.1; python_version~git+https://x/y~~plain-', p_size, ' # c~')
    WHEN 1 THEN concat('[tool.poetry]~name = "svc"~paramiko = "^', {_V}, ',<9"~')
    WHEN 2 THEN concat('{{"dependencies":{{"passport":"^', {_V}, '"}},"devDependencies":{{"Left-Pad":"1.', p_size, '.x beta"}}}}')
    WHEN 3 THEN concat('module m~~require (~ github.com/golang-jwt/jwt v', {_V}, '~  example.com/x v0.', p_size, '.0 // indirect~)~')
    WHEN 4 THEN concat('[package]~version = "1.0.0"~[dependencies]~rsa = "', {_V}, '"~serde = {{ version = "1.', p_size, '", features = ["a"] }}~[features]~foo = "bar"~')
    WHEN 5 THEN concat('<project><dependencies><dependency><groupId>g</groupId><artifactId>jose4j</artifactId><version>', {_V}, '-x</version></dependency><!-- <dependency><artifactId>no</artifactId></dependency> --><dependency><artifactId>Lib', p_size, '</artifactId></dependency></dependencies></project>')
    ELSE concat('GEM~  specs:~    jwt (', {_V}, ')~      nested (>= 1)~    rake (13.', p_size, ')~') END, '~', chr(10)) AS content
FROM part"""
_EXPECTED = """
SELECT repo_id, file_path AS manifest, 'pypi' AS ecosystem, unnest(['pyjwt', 'flask', 'plain-' || p_size]) AS name, unnest([v, p_size || '.1', '']) AS version FROM m WHERE p_partkey % 7 = 0
UNION ALL SELECT repo_id, file_path, 'pypi', unnest(['name', 'paramiko']), unnest(['', v]) FROM m WHERE p_partkey % 7 = 1
UNION ALL SELECT repo_id, file_path, 'npm', unnest(['passport', 'left-pad']), unnest([v, '1.' || p_size || '.']) FROM m WHERE p_partkey % 7 = 2
UNION ALL SELECT repo_id, file_path, 'go', unnest(['github.com/golang-jwt/jwt', 'example.com/x']), unnest([v, '0.' || p_size || '.0']) FROM m WHERE p_partkey % 7 = 3
UNION ALL SELECT repo_id, file_path, 'crates.io', unnest(['rsa', 'serde']), unnest([v, '1.' || p_size]) FROM m WHERE p_partkey % 7 = 4
UNION ALL SELECT repo_id, file_path, 'maven', unnest(['jose4j', 'lib' || p_size]), unnest([v, '']) FROM m WHERE p_partkey % 7 = 5
UNION ALL SELECT repo_id, file_path, 'rubygems', unnest(['jwt', 'rake']), unnest([v, '13.' || p_size]) FROM m WHERE p_partkey % 7 = 6"""


@check("manifest_packages", f"WITH m AS ({_MANIFESTS}) {_EXPECTED}")
def manifest_packages(i: Inputs) -> DataFrame:
    return manifests.parse(i.sql(_MANIFESTS)).select("repo_id", "manifest", "ecosystem", "name", "version")


@check("manifest_findings", f"""WITH {_CUR}, m AS ({_MANIFESTS}), p AS ({_EXPECTED})
SELECT p.repo_id, p.manifest, p.name AS dependency_name, c.algorithm FROM p JOIN cur c ON c.ecosystem = p.ecosystem AND c.name = p.name
WHERE c.vulnerable_below IS NULL OR p.version = '' OR {_key('p.version')} < {_key('c.vulnerable_below')}""")
def manifest_findings(i: Inputs) -> DataFrame:
    found = dependencies.dependency_findings(manifests.parse(i.sql(_MANIFESTS)))
    return found.select("repo_id", "manifest", "dependency_name", "algorithm")


# manifests as they lie inside packages and images
_PACKED = f"""SELECT p_partkey AS artifact_id, p_partkey, p_size, {_V} AS v,
  CASE p_partkey % 5 WHEN 0 THEN 'a-1.dist-info/METADATA' WHEN 1 THEN 'var/lib/dpkg/status' WHEN 2 THEN 'control' WHEN 3 THEN 'x.nuspec' ELSE 'metadata.gz' END AS file_path,
  replace(CASE p_partkey % 5
    WHEN 0 THEN concat('Name: a~Requires-Dist: PyJWT (>=', {_V}, ',<3)~Requires-Dist: requests; extra~Summary: x~')
    WHEN 1 THEN concat('Package: OpenSSL~Status: ok~Version: ', {_V}, '~~Package: lib', p_size, '~')
    WHEN 2 THEN concat('Package: p~Depends: libssl3 (>= ', {_V}, '),~ zlib1g~Recommends: ca', p_size, '~Description: d~')
    WHEN 3 THEN concat('<package><dependency targetFramework="x" id="Bouncy', p_size, '" version="', {_V}, '" /></package>')
    ELSE concat('name: g~dependencies:~  - x~  name: jwt~  name: "rake', p_size, '"~other: 1~  name: no~') END, '~', chr(10)) AS content
FROM part"""


@check("packed_manifests", f"""WITH m AS ({_PACKED})
SELECT artifact_id, file_path AS manifest, 'pypi' AS ecosystem, unnest(['pyjwt', 'requests']) AS name, unnest([v, '']) AS version FROM m WHERE p_partkey % 5 = 0
UNION ALL SELECT artifact_id, file_path, 'deb', unnest(['openssl', 'lib' || p_size]), unnest([v, '']) FROM m WHERE p_partkey % 5 = 1
UNION ALL SELECT artifact_id, file_path, 'deb', unnest(['libssl3', 'zlib1g', 'ca' || p_size]), unnest([v, '', '']) FROM m WHERE p_partkey % 5 = 2
UNION ALL SELECT artifact_id, file_path, 'nuget', 'bouncy' || p_size, '' FROM m WHERE p_partkey % 5 = 3
UNION ALL SELECT artifact_id, file_path, 'gem', unnest(['jwt', 'rake' || p_size]), unnest(['', '']) FROM m WHERE p_partkey % 5 = 4""")
def packed_manifests(i: Inputs) -> DataFrame:
    return manifests.parse_packed(i.sql(_PACKED), ["artifact_id"]).select("artifact_id", "manifest", "ecosystem", "name", "version")


def zipped(files: DataFrame) -> DataFrame:
    """Every file packed into a wheel that also holds metadata and a nested jar."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr("A.class", b"\x00" + f"javax/crypto/Cipher {r.doc_id}".encode() + b"\x00")
                with zipfile.ZipFile(outer, "w") as z:
                    z.writestr("a-1.dist-info/METADATA", "Requires-Dist: pyjwt (1.0)\n")
                    z.writestr("src/text.txt", r.content)
                    z.writestr("lib/in.jar", inner.getvalue())
                yield pd.DataFrame({"artifact_id": [str(r.doc_id)], "artifact_name": [f"d{r.doc_id}.whl"], "content": [outer.getvalue()]})

    return files.select("doc_id", "content").mapInPandas(pack, "artifact_id string, artifact_name string, content binary")


@check("archive_members", """
SELECT CAST(doc_id AS VARCHAR) AS artifact_id, '' AS jar, 'src/text.txt' AS file_path, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS digest FROM files_v
UNION ALL SELECT CAST(doc_id AS VARCHAR), '', 'a-1.dist-info/METADATA', 27, md5('Requires-Dist: pyjwt (1.0)' || chr(10)) FROM files_v
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lib/in.jar', 'lib/in.jar/A.class', 22 + length(CAST(doc_id AS VARCHAR)), md5('\\x00'::BLOB || encode('javax/crypto/Cipher ' || doc_id) || '\\x00'::BLOB) FROM files_v""")
def archive_members(i: Inputs) -> DataFrame:
    return archives.unpack(zipped(i.files())).select("artifact_id", "jar", "file_path", "size", F.md5("content").alias("digest"))


_NAMED = """SELECT CAST(p_partkey AS VARCHAR(20)) AS artifact_id,
  concat('f', p_partkey, CASE p_size % 12 WHEN 0 THEN '.whl' WHEN 1 THEN '.JAR' WHEN 2 THEN '.so.1.2' WHEN 3 THEN '.deb' WHEN 4 THEN '.ko.gz' WHEN 5 THEN '.nupkg' WHEN 6 THEN '.gem' WHEN 7 THEN '.src.rpm' ELSE '.bin' END) AS artifact_name,
  CASE p_partkey % 4 WHEN 0 THEN '7F454C4602' WHEN 1 THEN 'CAFEBABE00' WHEN 2 THEN '4D5A900003' ELSE '0011223344' END AS magic FROM part"""


@check("artifact_types", f"""SELECT artifact_id, CASE WHEN artifact_name LIKE '%.whl' THEN 'python_wheel' WHEN artifact_name LIKE '%.JAR' THEN 'java_jar'
  WHEN artifact_name LIKE '%.so.1.2' OR artifact_name LIKE '%.ko.gz' THEN 'native_elf' WHEN artifact_name LIKE '%.deb' THEN 'deb' WHEN artifact_name LIKE '%.nupkg' THEN 'nuget'
  WHEN artifact_name LIKE '%.gem' THEN 'ruby_gem' WHEN artifact_name LIKE '%.rpm' THEN 'rpm'
  WHEN magic LIKE '7F454C46%' THEN 'native_elf' WHEN magic LIKE 'CAFEBABE%' THEN 'native_macho' WHEN magic LIKE '4D5A%' THEN 'native_pe' ELSE 'unknown' END AS artifact_type
FROM ({_NAMED})""")
def artifact_types(i: Inputs) -> DataFrame:
    rows = i.sql(_NAMED, deal=True).withColumn("content", F.unhex("magic"))
    return archives.artifact_types(rows, archives.unpack(rows)).select("artifact_id", "artifact_type")
