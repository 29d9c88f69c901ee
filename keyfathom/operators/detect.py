"""Finding cryptography in source files.

Input is ``files(repo_id, file_path, content)``.  Each file is matched inside
its own row, so a scan is one map stage over the corpus with no shuffle; only
the hits leave it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import signals
from keyfathom.dims.registry import REGISTRY
from keyfathom.functions import paths, text
from keyfathom.functions.grades import registry_field
from keyfathom.functions.patterns import spans_lines
from keyfathom.functions.sqltext import literal

LINES_BEFORE = 9
LINES_AFTER = 11
FILE_KEYS = ["repo_id", "file_path"]


@cache
def registry_tokens() -> tuple[str, ...]:
    """Tokens that guard the registry's pattern lists, in whole and newline-free part."""
    flat = [[p for p in a.patterns if not spans_lines(p)] for a in REGISTRY]
    return tuple(text.all_tokens([a.patterns for a in REGISTRY] + [f for f in flat if f]))


def prepare_text(files: DataFrame, guarded: bool = True) -> DataFrame:
    """Add what matching the registry needs, see :mod:`keyfathom.functions.text`."""
    return text.with_lines(files, registry_tokens() if guarded else ("",))


def unnest(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per element of an array of structs.

    ``inline_outer`` plus a null test, because for a plain ``inline`` the
    optimizer adds a size filter that evaluates the matching expression twice.
    """
    opened = rows.select(*keys, F.inline_outer(column))
    first = opened.columns[len(keys)]
    return opened.where(F.col(first).isNotNull())


@cache
def _hits_sql(guarded: bool) -> str:
    parts = [f"transform({text.hit_lines(a.patterns, guarded)}, "
             f"n -> named_struct('algorithm', {literal(a.name)}, 'line_number', n))" for a in REGISTRY]
    return f"concat({', '.join(parts)})"


def hit_array(guarded: bool = True) -> Column:
    """All (algorithm, line_number) hits of the file in this row."""
    return F.expr(_hits_sql(guarded))


def _context(shown: Column, line_number: Column) -> Column:
    return text.window_of_lines(shown, line_number - LINES_BEFORE, line_number + LINES_AFTER)


def with_context(hits: Column, shown: Column) -> Column:
    """Hits with the surrounding source lines, still one array per file."""
    return F.transform(hits, lambda h: F.struct(
        h["algorithm"].alias("algorithm"),
        h["line_number"].alias("line_number"),
        _context(shown, h["line_number"]).alias("context"),
        F.greatest(h["line_number"] - LINES_BEFORE, F.lit(1)).alias("context_start_line")))


def describe(hits: DataFrame) -> DataFrame:
    """Add the registry grades and the path class to (file_path, algorithm) rows."""
    in_test = paths.is_test_path(F.col("file_path")) | paths.is_vendor_path(F.col("file_path"))
    return hits.select(
        "*",
        registry_field(F.col("algorithm"), "algo_type").alias("algo_type"),
        registry_field(F.col("algorithm"), "risk_level").alias("risk_level"),
        registry_field(F.col("algorithm"), "quantum_status").alias("quantum_status"),
        registry_field(F.col("algorithm"), "quantum_safe").alias("quantum_safe"),
        registry_field(F.col("algorithm"), "nist_replacement").alias("nist_replacement"),
        in_test.alias("in_test_path"),
    )


def code_hits(files: DataFrame, keys: list[str] = FILE_KEYS, guarded: bool = True) -> DataFrame:
    """(keys, algorithm, line_number), one row per file, algorithm and line."""
    return unnest(prepare_text(files, guarded).select(*keys, hit_array(guarded).alias("hits")), keys, "hits")


def code_findings(files: DataFrame, keys: list[str] = FILE_KEYS, context: bool = True,
                  guarded: bool = True) -> DataFrame:
    """Graded code findings; with the source context unless told otherwise."""
    if not context:
        return describe(code_hits(files, keys, guarded))
    shown = text.split_lines(text.without_last_newline(F.col("content")))
    ready = prepare_text(files, guarded).select(*keys, shown.alias("shown"), hit_array(guarded).alias("hits"))
    ready = ready.select(*keys, with_context(F.col("hits"), F.col("shown")).alias("hits"))
    return describe(unnest(ready, keys, "hits"))


def path_classes(files: DataFrame) -> DataFrame:
    """Whether each file is test or vendor code."""
    test = paths.is_test_path(F.col("file_path"))
    vendor = paths.is_vendor_path(F.col("file_path"))
    return files.select(*[c for c in files.columns if c != "content"],
                        test.alias("is_test"), vendor.alias("is_vendor"),
                        (test | vendor).alias("in_test_path"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per repository and extension."""
    return (files.select("repo_id", paths.extension(F.col("file_path")).alias("extension"))
            .groupBy("repo_id", "extension").agg(F.count("*").alias("files")))


def source_files(files: DataFrame) -> DataFrame:
    """Files whose language is scanned, outside dependency and build folders."""
    return files.where(paths.is_source_file(F.col("file_path")))


LANGUAGES = signals.LANGUAGE_EXTENSIONS
