"""Reading declared packages out of manifest text.

Every reader maps one text column to an array of (name, version) structs, in the
order of the file, so a manifest is parsed inside its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import paths
from keyfathom.functions.text import split_lines, unify_newlines

# ---- FIXED VALUES: line and block formats of the manifests -------------------

PY_NAME = r"^([A-Za-z0-9_.\-]+)"
PY_PINNED = r"^([A-Za-z0-9_.\-]+)\s*[=><~!]+\s*([^\s,;#]+)"
PY_EXTRAS = r"\[[^\]]*\]"
PY_SKIPPED = r"^(#|-r|-c|git\+|http)"
PYPROJECT_ENTRY = r"""(?md)^([A-Za-z0-9_.\-]+)\s*=\s*["']([^"']*)["']"""
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]
GO_REQUIRE = r"(?md)^\s+([a-zA-Z0-9./_\-]+)\s+v([^\s]+)"
CARGO_SECTIONS = ["[dependencies]", "[dev-dependencies]", "[build-dependencies]"]
CARGO_PLAIN = r"""^([A-Za-z0-9_\-]+)\s*=\s*["']([^"']+)["']"""
CARGO_TABLE = r"""^([A-Za-z0-9_\-]+)\s*=\s*\{.*version\s*=\s*["']([^"']+)["']"""
GEM_SPEC = r"(?md)^\s{4}([a-zA-Z0-9_\-]+)\s+\(([^)]+)\)"
WHEEL_REQUIRES = r"(?i)^Requires-Dist:\s*([A-Za-z0-9_.\-]+)\s*(?:\(([^)]+)\))?"
DPKG_NAME = r"(?md)^Package:\s*(.+)$"
DPKG_VERSION = r"(?md)^Version:\s*(.+)$"
DEB_FIELDS = ["Depends", "Pre-Depends", "Recommends"]
DEB_DEPENDENCY = r"^([a-z0-9][a-z0-9.+\-]+)\s*(?:\(([>=<! ]+)\s*([\d.~:+\-]+)\))?"
NUSPEC_DEPENDENCY = r"""(?i)<dependency[^>]+id="([^"]+)"[^>]*(?:version="([^"]*)")?"""
GEM_SECTION = r"^(runtime_)?dependencies\s*:"
GEM_NAME = r"^\s+name\s*:\s*(.+)"

# ---- END OF FIXED VALUES ------------------------------------------------------

_EMPTY = "array<struct<name:string,version:string>>"


def _package(name: Column, version: Column) -> Column:
    return F.struct(F.lower(name).alias("name"), version.alias("version"))


def _digits(version: Column) -> Column:
    return F.regexp_replace(version, "[^0-9.]", "")


def _pairs(text: Column, pattern: str, clean=lambda v: v) -> Column:
    """Packages from every match of a pattern with groups (name, version)."""
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    versions = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(names, versions, lambda n, v: _package(n, clean(v)))


def _from_lines(lines: Column, package) -> Column:
    """One optional package per line; ``package`` gives null for other lines."""
    return F.array_compact(F.transform(lines, package))


def requirements(text: Column) -> Column:
    def package(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        spec = F.regexp_replace(bare, PY_EXTRAS, "")
        name = F.regexp_extract(spec, PY_NAME, 1)
        used = (name != "") & ~bare.rlike(PY_SKIPPED)
        pinned_name = F.regexp_extract(spec, PY_PINNED, 1)
        return F.when(used & (pinned_name != ""), _package(pinned_name, F.regexp_extract(spec, PY_PINNED, 2))
                      ).when(used, _package(name, F.lit("")))

    return _from_lines(split_lines(text), package)


def pyproject(text: Column) -> Column:
    """Every ``key = "value"`` line; keys that are no packages join nothing later."""
    return _pairs(text, PYPROJECT_ENTRY, lambda v: _digits(F.substring_index(v, ",", 1)))


def package_json(text: Column) -> Column:
    schema = ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS)
    parsed = F.from_json(text, schema)

    def of(section: str) -> Column:
        entries = F.coalesce(F.map_entries(parsed[section]), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(entries, lambda e: _package(
            e["key"], F.coalesce(_digits(F.substring_index(e["value"], " ", 1)), F.lit(""))))

    return F.concat(*[of(s) for s in NPM_SECTIONS])


def go_mod(text: Column) -> Column:
    return _pairs(text, GO_REQUIRE)


def cargo(text: Column) -> Column:
    """Dependency sections only; a line opening with ``[`` starts a section."""
    sections = F.split(text, r"\n(?=[^\S\n]*\[)", -1)
    wanted = F.filter(sections, lambda s: F.trim(F.substring_index(s, "\n", 1)).isin(CARGO_SECTIONS))
    lines = F.flatten(F.transform(wanted, split_lines))

    def package(line: Column) -> Column:
        bare = F.trim(line)
        choices = [F.when(bare.rlike(p), _package(F.regexp_extract(bare, p, 1), F.regexp_extract(bare, p, 2)))
                   for p in (CARGO_PLAIN, CARGO_TABLE)]
        return F.coalesce(*choices)

    return _from_lines(lines, package)


def pom(text: Column) -> Column:
    """Every dependency element, known by its artifactId alone."""
    clean = F.regexp_replace(text, "(?s)<!--.*?-->|<exclusions>.*?</exclusions>", "")
    blocks = F.regexp_extract_all(clean, F.lit(r"(?s)<(?:\w+:)?dependency(?:\s[^>]*)?>.*?</(?:\w+:)?dependency>"), F.lit(0))

    def package(block: Column) -> Column:
        name = F.regexp_extract(block, r"<(?:\w+:)?artifactId>([^<]*)<", 1)
        version = _digits(F.regexp_extract(block, r"<(?:\w+:)?version>([^<]*)<", 1))
        return F.when(name != "", _package(name, version))

    return F.array_compact(F.transform(blocks, package))


def gemfile_lock(text: Column) -> Column:
    return _pairs(text, GEM_SPEC)


def wheel_metadata(text: Column) -> Column:
    def package(line: Column) -> Column:
        spec = F.coalesce(F.regexp_extract(line, WHEEL_REQUIRES, 2), F.lit(""))
        return F.when(line.rlike(WHEEL_REQUIRES), _package(
            F.regexp_extract(line, WHEEL_REQUIRES, 1), F.regexp_extract(spec, r"([\d.]+)", 1)))

    return _from_lines(split_lines(text), package)


def dpkg_status(text: Column) -> Column:
    def package(block: Column) -> Column:
        return F.when(block.rlike(DPKG_NAME), _package(
            F.trim(F.regexp_extract(block, DPKG_NAME, 1)),
            F.trim(F.regexp_extract(block, DPKG_VERSION, 1))))

    return F.array_compact(F.transform(F.split(text, "\n\n", -1), package))


def deb_control(text: Column) -> Column:
    def of(field: str) -> Column:
        body = F.regexp_extract(text, rf"(?msd)^{field}:\s*(.+?)(?=\n\S|\z)", 1)
        entries = F.split(F.regexp_replace(body, r"\s+", " "), ",", -1)
        return F.array_compact(F.transform(entries, lambda e: F.when(F.trim(e).rlike(DEB_DEPENDENCY), _package(
            F.regexp_extract(F.trim(e), DEB_DEPENDENCY, 1),
            F.coalesce(F.regexp_extract(F.trim(e), DEB_DEPENDENCY, 3), F.lit(""))))))

    return F.concat(*[of(f) for f in DEB_FIELDS])


def nuspec(text: Column) -> Column:
    return F.transform(_pairs(text, NUSPEC_DEPENDENCY), lambda p: _package(F.trim(p["name"]), p["version"]))


def gem_metadata(text: Column) -> Column:
    """Names under a top-level dependencies key; they carry no version."""
    blocks = F.split(text, r"\n(?=[^ \n])", -1)
    wanted = F.filter(blocks, lambda b: b.rlike(GEM_SECTION))
    lines = F.flatten(F.transform(wanted, split_lines))

    def package(line: Column) -> Column:
        name = F.regexp_replace(F.trim(F.regexp_extract(line, GEM_NAME, 1)), "^['\"]+|['\"]+$", "")
        return F.when(line.rlike(GEM_NAME), _package(name, F.lit("")))

    return _from_lines(lines, package)


# file name test -> (ecosystem, reader); the first that holds is used
_READERS = [
    (lambda n: (n == "Pipfile") | n.rlike(r"(?i)^requirements.*\.txt$"), "pypi", requirements),
    (lambda n: n == "pyproject.toml", "pypi", pyproject),
    (lambda n: n == "package.json", "npm", package_json),
    (lambda n: n == "go.mod", "go", go_mod),
    (lambda n: n == "Cargo.toml", "crates.io", cargo),
    (lambda n: n == "pom.xml", "maven", pom),
    (lambda n: n == "Gemfile.lock", "rubygems", gemfile_lock),
]

# manifests found inside packages and images, matched on lower-cased names
_PACKED_READERS = [
    (lambda n, p: n.rlike(r"^requirements([._-].+)?\.txt$"), "pypi", requirements),
    (lambda n, p: n == "pyproject.toml", "pypi", pyproject),
    (lambda n, p: n == "pom.xml", "maven", pom),
    (lambda n, p: (n == "package.json") & ~F.contains(p, F.lit("node_modules")), "npm", package_json),
    (lambda n, p: n.isin("metadata", "pkg-info")
     & (F.contains(p, F.lit(".dist-info")) | F.contains(p, F.lit(".egg-info"))), "pypi", wheel_metadata),
    (lambda n, p: F.endswith(p, F.lit("var/lib/dpkg/status")), "deb", dpkg_status),
    (lambda n, p: n == "control", "deb", deb_control),
    (lambda n, p: F.endswith(n, F.lit(".nuspec")), "nuget", nuspec),
    (lambda n, p: n.isin("metadata.gz", "metadata.yaml"), "gem", gem_metadata),
]


def _choose(tests: list[tuple[Column, object]], otherwise: Column) -> Column:
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), otherwise)


def _packages(files: DataFrame, keys: list[str], found: Column, ecosystem: Column) -> DataFrame:
    rows = files.select(*keys, F.col("file_path").alias("manifest"), ecosystem.alias("ecosystem"),
                        found.alias("_found"))
    opened = rows.select(*keys, "manifest", "ecosystem", F.posexplode_outer("_found").alias("ord", "_p"))
    return opened.where(F.col("_p").isNotNull()).select(
        *keys, "manifest", "ord", "ecosystem", F.col("_p.name").alias("name"),
        F.col("_p.version").alias("version"))


def package_array(text: Column) -> Column:
    """Packages of the manifest in this row (file_path); null for other files."""
    name = paths.basename(F.col("file_path"))
    found = _choose([(test(name), read(text)) for test, _, read in _READERS], F.lit(None).cast(_EMPTY))
    return F.when(paths.is_manifest(F.col("file_path")), found)


def ecosystem_of_file() -> Column:
    name = paths.basename(F.col("file_path"))
    return _choose([(test(name), F.lit(e)) for test, e, _ in _READERS], F.lit(None).cast("string"))


def opened(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, manifest, ord, ecosystem, name, version) from a column of package arrays."""
    return _packages(rows, keys, F.col(column), ecosystem_of_file())


def parse(files: DataFrame, keys: list[str] = ["repo_id"]) -> DataFrame:
    """(keys, manifest, ord, ecosystem, name, version) of all manifests of a repository."""
    found = package_array(unify_newlines(F.col("content")))
    chosen = files.where(paths.is_manifest(F.col("file_path")))
    return _packages(chosen, keys, found, ecosystem_of_file())


def packed_array(text: Column) -> Column:
    """Packages of the manifest inside an archive in this row (file_path); null for other members."""
    name = F.lower(paths.basename(F.col("file_path")))
    return _choose([(test(name, F.col("file_path")), read(text)) for test, _, read in _PACKED_READERS],
                   F.lit(None).cast(_EMPTY))


def packed_opened(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, manifest, ord, ecosystem, name, version) from a column of package arrays of members."""
    name = F.lower(paths.basename(F.col("file_path")))
    ecosystem = _choose([(test(name, F.col("file_path")), F.lit(e)) for test, e, _ in _PACKED_READERS],
                        F.lit(None).cast("string"))
    return _packages(rows, keys, F.col(column), ecosystem)


def parse_packed(members: DataFrame, keys: list[str]) -> DataFrame:
    """The same for manifests inside archives, given ``members(keys, file_path, content)``."""
    found = members.withColumn("_packed", packed_array(unify_newlines(F.col("content"))))
    return packed_opened(found, keys, "_packed")
