"""Column expressions over repository paths, URLs and endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfathom.dims import signals


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1))


def outside_dirs(path: Column, dirs: list[str]) -> Column:
    """No directory of the path has one of the given names."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dirs]))


def is_test_path(path: Column) -> Column:
    return path.rlike("(?i)" + signals.TEST_PATH)


def is_vendor_path(path: Column) -> Column:
    return path.rlike("(?i)" + signals.VENDOR_PATH)


def is_source_file(path: Column) -> Column:
    wanted = extension(path).isin(signals.SOURCE_EXTENSIONS) | basename(path).isin(
        signals.SOURCE_FILE_NAMES)
    return wanted & outside_dirs(path, signals.SOURCE_SKIP_DIRS)


def is_manifest(path: Column) -> Column:
    name = basename(path)
    wanted = name.isin(signals.MANIFEST_NAMES) | name.rlike(r"(?i)^requirements.*\.txt$")
    return wanted & outside_dirs(path, signals.MANIFEST_SKIP_DIRS)


def blob_url(repo_url: Column, branch: Column, path: Column, line: Column | None = None) -> Column:
    """Link to a file (and line) in the repository's web view."""
    base = F.regexp_replace(F.regexp_replace(repo_url, "/+$", ""), r"\.git$", "")
    shown = F.when(F.coalesce(branch, F.lit("")) == "", F.lit("main")).otherwise(branch)
    url = F.concat(base, F.lit("/blob/"), shown, F.lit("/"), F.regexp_replace(path, "^/+", ""))
    if line is None:
        return url
    anchor = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit("#L"), line.cast("string")))
    return F.concat(url, F.coalesce(anchor, F.lit("")))


def endpoint_parts(raw: Column) -> Column:
    """struct(host, port) of a user-written endpoint; 443 when no port is given."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "/+$", ""), "^https?://", "")
    bare = F.substring_index(bare, "/", 1)
    port = F.regexp_extract(bare, r":\s*([+-]?[0-9]+)\s*$", 1)
    host = F.regexp_extract(bare, r"^(.*):[^:]*$", 1)
    has_port = port != ""
    return F.struct(
        F.when(has_port, host).otherwise(bare).alias("host"),
        F.when(has_port, port.cast("int")).otherwise(F.lit(443)).alias("port"),
    )
