"""Cryptographic symbols in binaries and bytecode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions.groups import first_per
from keyfathom.functions.patterns import guard_tokens
from keyfathom.functions.sqltext import literal

_PRINTABLE = r"[\x20-\x7e]{6,}"
#: In programs and libraries also shorter runs count, and tabs.
_PROGRAM_PRINTABLE = r"[\t\x20-\x7e]{4,}"


def printable_text(data: Column, runs: str = _PRINTABLE) -> Column:
    """Runs of at least six printable characters, one per line."""
    latin = F.decode(data, "ISO-8859-1")
    return F.array_join(F.regexp_extract_all(latin, F.lit(f"({runs})"), F.lit(1)), "\n")


def symbol_array(text_column: str) -> Column:
    """An array of (algorithm, symbol, ord, grades): the first match of every pattern in a text."""
    found = []
    for i, (pattern, algorithm, kind, risk, status, replacement) in enumerate(grades.NATIVE_SYMBOLS):
        needed = " OR ".join(f"contains({text_column}, {literal(t)})" for t in guard_tokens([pattern], fold=False))
        symbol = f"regexp_extract({text_column}, {literal(f'({pattern})')}, 1)"
        hit = (f"named_struct('algorithm', {literal(algorithm)}, 'symbol', {symbol}, 'ord', {i}, 'algo_type', {literal(kind)}, "
               f"'risk_level', {literal(risk)}, 'quantum_status', {literal(status)}, 'nist_replacement', {literal(replacement)})")
        found.append(f"CASE WHEN {needed} THEN {hit} END")
    return F.filter(F.array_compact(F.expr(f"array({', '.join(found)})")), lambda h: h["symbol"] != "")


def symbol_hits(members: DataFrame, text_column: str = "text") -> DataFrame:
    """(all columns but the text, algorithm, symbol, grades): first match per row and algorithm."""
    keys = [c for c in members.columns if c != text_column]
    hits = symbol_array(text_column)
    # an earlier pattern of the same algorithm in the same row wins
    firsts = F.filter("_hits", lambda h, i: ~F.exists(
        F.slice("_hits", F.lit(1), i), lambda e: e["algorithm"] == h["algorithm"]))
    rows = members.select(*keys, hits.alias("_hits"))
    opened = rows.select(*keys, F.inline_outer(firsts)).where(F.col("algorithm").isNotNull())
    return opened.withColumn("quantum_safe", F.lit(False))


def is_native_binary(data: Column) -> Column:
    magic = F.hex(F.substring(data, 1, 4))
    return magic.isin([grades.ELF_MAGIC, *grades.MACHO_MAGICS])


def binary_findings(members: DataFrame) -> DataFrame:
    """Symbols in ELF and Mach-O members of unpacked archives.

    ``members(artifact_id, artifact_name, file_path, content)`` with bytes.
    """
    # Class files begin like fat Mach-O files; they are bytecode_findings' part.
    native = members.where(is_native_binary(F.col("content")) & ~F.endswith("file_path", F.lit(".class")))
    rows = native.select("artifact_id", "artifact_name", "file_path", printable_text(F.col("content")).alias("text"))
    hits = symbol_hits(rows)
    return hits.withColumn("context", F.concat(F.lit("Crypto symbol/string found in binary: '"), F.col("symbol"), F.lit("'")))


def bytecode_findings(members: DataFrame) -> DataFrame:
    """Symbols in class files: one finding per jar and algorithm, first file in path order."""
    classes = members.where(F.endswith("file_path", F.lit(".class")))
    rows = classes.select("artifact_id", "artifact_name", "jar", "file_path",
                          printable_text(F.col("content")).alias("text"))
    hits = first_per(symbol_hits(rows), ["artifact_id", "jar", "algorithm"], "file_path", "ord")
    return hits.withColumn("context", F.concat(
        F.lit("Crypto API reference found in bytecode: "), F.col("file_path")))


def once_per_path(findings: DataFrame) -> DataFrame:
    """One finding per (path, algorithm)."""
    return first_per(findings, ["artifact_id", "file_path", "algorithm"], "ord")


def piece_symbols(pieces: DataFrame) -> DataFrame:
    """(all columns but the content, hits): symbols in pieces of kind class, native and macho."""
    text = F.when(F.col("kind") == "class", printable_text(F.col("content"))).when(
        F.col("kind").isin("native", "macho"), printable_text(F.col("content"), _PROGRAM_PRINTABLE))
    keys = [c for c in pieces.columns if c != "content"]
    return pieces.withColumn("_text", text).select(*keys, symbol_array("_text").alias("hits"))


def artifact_symbols(found: DataFrame) -> DataFrame:
    """Findings from pieces with hits: one per algorithm and file, jar or artifact, whatever the pieces it was met in.

    Class files count per jar; static libraries and Android packages (dex files before others) as a
    whole; other files each.  The first pattern of an algorithm names the symbol.
    """
    whole = F.col("artifact_type").isin("static_archive", "android_apk")
    group = F.when(F.col("kind") == "class", F.concat(F.lit("jar "), "jar")).when(whole, "").otherwise(
        F.concat(F.lit("file "), "file_path"))
    keys = ["artifact_id", "artifact_name", "artifact_type", "kind", "jar", "file_path", "offset"]
    rows = found.select(*keys, group.alias("_group"), F.inline("hits"))
    late = whole & ~F.endswith("file_path", F.lit(".dex"))
    once = first_per(rows.withColumn("_late", late), ["artifact_id", "_group", "algorithm"], "_late", "file_path", "ord",
                     "offset")
    shown = F.concat(F.lit("'"), "symbol", F.lit("'"))
    context = (F.when(F.col("kind") == "class", F.concat(F.lit("Crypto API reference found in bytecode: "), "file_path"))
               .when(F.col("kind") == "macho", F.concat(F.lit("Crypto symbol found in Mach-O binary: "), shown))
               .otherwise(F.concat(F.lit("Crypto symbol/string found in binary: "), shown)))
    return once.drop("_group", "_late").withColumns({"context": context, "quantum_safe": F.lit(False)})
