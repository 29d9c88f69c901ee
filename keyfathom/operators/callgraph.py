"""Which findings can be reached from an entry point?

Tables: ``functions(repo_id, file_path, name, label, start_line, end_line,
is_entry)`` and ``calls(repo_id, caller, callee_name)``, where ``caller`` is a
function's ``func_id``.
"""

from __future__ import annotations

import ast
import uuid
import warnings
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions import text
from keyfathom.functions.groups import partitions as _partitions
from keyfathom.functions.groups import spread
from keyfathom.functions.sqltext import literal
from keyfathom.operators.detect import unnest
from keyfathom.session import checkpoint_dir

MAX_CHAIN = 50
MODULE_LEVEL = "<module-level>"

# ---- FIXED VALUES ----------------------------------------------------------

# A Python function whose decorator contains one of these is an entry point.
PYTHON_ENTRY_DECORATORS = [
    "route", "get", "post", "put", "delete", "patch", "head", "options",
    "task", "on_event", "command", "handle", "handler", "on",
    "scheduled", "periodic", "cron",
]
GO_FUNCTION = r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("
GO_HANDLER_WORDS = (r"HandleFunc|Handle\b|GET|POST|PUT|DELETE|PATCH|HandlerFunc|ServeHTTP"
                    r"|Register|Route\b|Run\b|Serve\b")
JAVA_METHOD = r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("
JAVA_ENTRY_ANNOTATIONS = (r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping"
                          r"|@Test\b|@Before\b|@After\b|@Scheduled\b|@EventListener\b")
JAVA_ENTRY_NAMES = ["main", "doGet", "doPost", "service", "init", "destroy"]
CALL = r"\b(\w+)\s*\("

# ---- END OF FIXED VALUES ---------------------------------------------------

EXTRACTED = ("repo_id string, file_path string, func_id string, name string, label string, "
             "start_line int, end_line int, is_entry boolean, callees array<string>, "
             "wires array<string>")


def _called_names(node: ast.AST) -> list[str]:
    names = set()
    for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
        name = getattr(call.func, "id", None) or getattr(call.func, "attr", None)
        if name:
            names.add(name)
    return sorted(names)


def _decorator_name(node: ast.AST) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    return (getattr(node, "id", None) or getattr(node, "attr", None) or "").lower()


def _is_main_guard(node: ast.AST) -> bool:
    test = getattr(node, "test", None)
    return (isinstance(node, ast.If) and isinstance(test, ast.Compare)
            and getattr(test.left, "id", None) == "__name__"
            and any(getattr(c, "value", None) == "__main__" for c in test.comparators))


def _python_rows(repo_id: str, path: str, source: str | None) -> Iterator[tuple]:
    if source is None:
        return
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            label = f"{node.name}@{node.lineno}"
            entry = node.name == "main" or node.name.startswith(("test_", "Test")) or any(
                word in _decorator_name(d) for d in node.decorator_list for word in PYTHON_ENTRY_DECORATORS)
            name = node.name
        elif _is_main_guard(node):
            label = name = "__main__"
            entry = True
        else:
            continue
        yield (repo_id, path, f"{path}::{label}", name, label, node.lineno, node.end_lineno, entry,
               _called_names(node), [])


def python_functions(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Functions of Python files, read with the standard parser inside the tasks."""
    columns = [part.split()[0] for part in EXTRACTED.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for r in batch.itertuples(index=False)
                    for row in _python_rows(r.repo_id, r.file_path, r.content)]
            yield pd.DataFrame(rows, columns=columns)

    chosen = files.where(F.endswith("file_path", F.lit(".py"))).select(
        F.col("repo_id").cast("string").alias("repo_id"), "file_path", "content")
    if max_bytes is not None:
        chosen = chosen.where(F.octet_length("content") <= max_bytes)
    return chosen.mapInPandas(read, EXTRACTED)


def span_array() -> Column:
    """(name, start_line) of the functions in the Go or Java file of this row.

    Needs ``file_path`` and a ``content`` without match marks.
    """
    def found(pattern: str) -> str:
        regex = "(?md)" + pattern
        return (f"zip_with(regexp_extract_all(content, {literal(regex)}, 1), {text.match_lines(regex)}, "
                "(n, s) -> named_struct('name', n, 'start_line', s))")

    return F.expr(f"CASE WHEN endswith(file_path, '.go') THEN {found(GO_FUNCTION)} "
                  f"WHEN endswith(file_path, '.java') THEN {found(JAVA_METHOD)} END")


def body_array(spans: str, shown: str) -> Column:
    """What the bodies of a row's functions say; a function ends before the next one."""
    def cut(span: Column, i: Column) -> Column:
        start = span["start_line"]
        end = F.coalesce(F.get(F.col(spans), i + 1)["start_line"] - 1, F.size(shown))
        return F.struct(span["name"].alias("name"), start.alias("start_line"), end.alias("end_line"),
                        text.window_of_lines(F.col(shown), start + 1, end).alias("body"),
                        text.window_of_lines(F.col(shown), start - 3, start).alias("above"))

    return F.transform(F.transform(spans, cut), lambda f: F.struct(
        f["name"].alias("name"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"),
        F.array_distinct(F.regexp_extract_all(f["body"], F.lit(CALL), F.lit(1))).alias("called"),
        f["body"].rlike(GO_HANDLER_WORDS).alias("handles"),
        f["above"].rlike(JAVA_ENTRY_ANNOTATIONS).alias("annotated")))


def declared(rows: DataFrame, column: str = "functions") -> DataFrame:
    """Functions with entry flags and callees from an array of :func:`body_array`."""
    found = unnest(rows, ["repo_id", "file_path"], column)
    name, is_go = F.col("name"), F.endswith("file_path", F.lit(".go"))
    exported = F.filter("called", lambda c: c.rlike(r"^\p{Lu}"))
    go_calls = F.filter("called", lambda c: c.rlike(r"^\p{Lu}") | (c == "main"))
    java_calls = F.filter("called", lambda c: ~c.rlike("^[0-9]"))
    go_entry = (name == "main") | F.startswith(name, F.lit("Test"))
    java_entry = name.isin(JAVA_ENTRY_NAMES) | F.col("annotated")
    label = F.concat(name, F.lit("@"), F.col("start_line").cast("string"))
    return found.select(
        F.col("repo_id").cast("string").alias("repo_id"), "file_path",
        F.concat(F.col("file_path"), F.lit("::"), label).alias("func_id"), "name", label.alias("label"),
        "start_line", "end_line", F.when(is_go, go_entry).otherwise(java_entry).alias("is_entry"),
        F.when(is_go, go_calls).otherwise(java_calls).alias("callees"),
        F.when(is_go & F.col("handles"), exported).otherwise(F.array().cast("array<string>")).alias("wires"))


def go_java_functions(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Functions of Go and Java files, worked out in the file's row."""
    chosen = files.where(F.col("file_path").rlike(r"\.(go|java)$"))
    if max_bytes is not None:
        chosen = chosen.where(F.octet_length("content") <= max_bytes)
    content = text.markable(text.unify_newlines(F.col("content")))
    rows = chosen.select("repo_id", "file_path", content.alias("content"))
    shown = text.split_lines(text.without_last_newline(F.col("content")))
    rows = rows.select("repo_id", "file_path", shown.alias("shown"), span_array().alias("spans"))
    return declared(rows.select("repo_id", "file_path", body_array("spans", "shown").alias("functions")))


def extract(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Functions of all supported languages with the names they call."""
    return python_functions(files, max_bytes).unionByName(go_java_functions(files, max_bytes))


def functions_of(extracted: DataFrame) -> DataFrame:
    """The functions table; names wired to a handler make their functions entries."""
    wired = extracted.select("repo_id", F.explode("wires").alias("name")).distinct().withColumn(
        "_wired", F.lit(True))
    return (extracted.join(wired, ["repo_id", "name"], "left")
            .withColumn("is_entry", F.col("is_entry") | F.col("_wired").isNotNull())
            .select("repo_id", "file_path", "func_id", "name", "label", "start_line", "end_line", "is_entry"))


def calls_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("repo_id", F.col("func_id").alias("caller"), F.explode("callees").alias("callee_name"))


def _placed(rows: DataFrame, partitions: int, dealt: bool = True) -> DataFrame:
    """The rows written in buckets of (repo_id, name) to the checkpoint folder: joins on these two find them in place.

    Rows that do not lie so already are dealt first.  The table's name goes at once, its files go with the folder.
    """
    spark = rows.sparkSession
    name = f"placed_{uuid.uuid4().hex}"
    if not dealt:
        rows = rows.repartition(partitions, "repo_id", "name")
    (rows.write.bucketBy(partitions, "repo_id", "name").option("path", f"{checkpoint_dir(spark)}/{name}")
     .format("parquet").saveAsTable(name))
    placed = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return placed


def next_frontier(frontier: DataFrame, edges: DataFrame, unsettled: DataFrame, depth: int) -> DataFrame:
    """(repo_id, name, chain, depth) of the unsettled names that the frontier's functions call.

    All three tables lie dealt by (repo_id, name), and so does the result.  Edges and unsettled names
    stay where they are; the one exchange is that of the names called, cut to one row per name
    and task before it.
    """
    chain = _last(F.concat(F.col("chain"), F.array("label")))
    called = (frontier.join(edges, ["repo_id", "name"]).select("repo_id", F.col("callee").alias("name"), chain.alias("chain"))
              .groupBy("repo_id", "name").agg(F.min("chain").alias("chain")))
    return unsettled.join(called, ["repo_id", "name"]).select("repo_id", "name", "chain", F.lit(depth).alias("depth"))


def reach(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo_id, func_id, depth, chain) of every function an entry point leads to.

    A call names its callee, and a name stands for all functions that bear it.
    So the search runs over distinct names, not over functions: each name is
    settled once, and a name borne or called by very many functions never
    multiplies rows.  Of equally short chains the smallest is kept.

    Edges and names are dealt by (repo_id, name) once.  A round moves only what
    its frontier calls; settled names leave the unsettled ones in place, and every
    few rounds so do the edges of names that are settled.  Each round is
    written, so lost executors do not replay the search.
    """
    spark = functions.sparkSession
    checkpoint_dir(spark)
    partitions = _partitions(spark)
    label = F.col("label") if "label" in functions.columns else F.col("name")
    known = functions.select("repo_id", "func_id", "name", label.alias("label"), "is_entry")
    names = known.select("repo_id", "name").distinct()
    entry = F.col("is_entry")
    # calls are cut to one per pair of names before unknown callees are dropped,
    # so a callee everybody calls is down to one row per calling name by then
    called = (calls.select("repo_id", F.col("caller").alias("func_id"), F.col("callee_name").alias("callee"))
              .join(known, ["repo_id", "func_id"])
              .groupBy("repo_id", "is_entry", "name", "callee").agg(F.min("label").alias("label"))
              .join(names.withColumnRenamed("name", "callee"), ["repo_id", "callee"], "left_semi")
              .checkpoint())
    edges = _placed(called.where(~entry).select("repo_id", "name", "callee", "label"), partitions, dealt=False)
    unsettled = _placed(names, partitions, dealt=False)
    first = (called.where(entry).groupBy("repo_id", F.col("callee").alias("name"))
             .agg(F.min(F.array("label")).alias("chain")))
    frontier = _placed(unsettled.join(first, ["repo_id", "name"]).select(
        "repo_id", "name", "chain", F.lit(1).alias("depth")), partitions)
    settled = frontier
    for depth in count(2):
        # names settled a round ago leave in place; the shorter tables are written every few rounds
        unsettled = unsettled.join(frontier, ["repo_id", "name"], "left_anti")
        if depth % 4 == 0:
            unsettled = _placed(unsettled, partitions)
        frontier = _placed(next_frontier(frontier, edges, unsettled, depth), partitions)
        if frontier.isEmpty():
            break
        settled = settled.unionByName(frontier)
        if depth % 4 == 0:  # edges of settled names have done their part, but for those of the frontier
            left = unsettled.select("repo_id", "name")
            edges = _placed(edges.join(left, ["repo_id", "name"], "left_semi"), partitions)
        if depth % 10 == 0:  # the parts are written; this only keeps the plan short
            settled = settled.checkpoint()
    roots = known.where(entry).select("repo_id", "func_id", F.lit(0).alias("depth"), F.array("label").alias("chain"))
    others = known.where(~entry).join(settled, ["repo_id", "name"]).select(
        "repo_id", "func_id", "depth", _last(F.concat(F.col("chain"), F.array("label"))).alias("chain"))
    return roots.unionByName(others)


def _last(chain: Column) -> Column:
    return F.slice(chain, F.greatest(F.size(chain) - MAX_CHAIN + 1, F.lit(1)), F.lit(MAX_CHAIN))


# ---- functions around a line ----------------------------------------------

_RADIX = 16
_LEVELS = 6  # blocks of 1, 16, 256, ... lines; the largest hold a million


def _blocks_of_span(start: Column, end: Column) -> Column:
    """The few aligned blocks of lines that make up start..end exactly.

    At each size all whole blocks inside the span are taken, apart from those
    a block of the next size already covers; that leaves a few at either edge.
    """
    def inside(level: int) -> tuple[Column, Column]:
        size = F.lit(_RADIX ** level).cast("long")
        return F.ceil(start / size).cast("long"), F.floor((end + 1) / size).cast("long") - 1

    def run(lo: Column, hi: Column) -> Column:
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    parts = []
    for level in range(_LEVELS):
        lo, hi = inside(level)
        up_lo, up_hi = inside(level + 1)
        covered = (up_lo <= up_hi) if level + 1 < _LEVELS else F.lit(False)
        blocks = F.when(covered, F.concat(run(lo, up_lo * _RADIX - 1), run((up_hi + 1) * _RADIX, hi))
                        ).otherwise(run(lo, hi))
        parts.append(_at_level(level, blocks))
    return F.concat(*parts)


def _at_level(level: int, blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def _blocks_of_line(line: Column) -> Column:
    return F.array(*[F.struct(F.lit(level).alias("level"),
                              F.floor(line / F.lit(_RADIX ** level)).cast("long").alias("block"))
                     for level in range(_LEVELS)])


def enclosing_functions(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, file_path, line_number, func_id): the tightest function around a line.

    A range join made into an equi-join.  Every span is cut into aligned blocks
    and only the tightest span of a block is kept, so a line meets at most one
    row per block size, however many functions or findings a file has.  Of
    equally tight spans the smallest id wins.

    Functions are dealt by their place before they are cut: a task sorts the blocks
    of its share, not those of a whole file split.
    """
    keys = ["repo_id", "file_path", "level", "block"]
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    spans = (spread(functions.where(start <= end).select("repo_id", "file_path", "func_id", "start_line", "end_line"),
                    "repo_id", "file_path", "start_line")
             .select("repo_id", "file_path", "func_id", (end - start).alias("width"),
                     F.inline(_blocks_of_span(start, end)))
             .groupBy(*keys).agg(F.min(F.struct("width", "func_id")).alias("best")))
    points = lines.select("repo_id", "file_path", "line_number").distinct().select(
        "*", F.inline(_blocks_of_line(F.col("line_number"))))
    return (points.join(spans, keys).groupBy("repo_id", "file_path", "line_number")
            .agg(F.min("best").alias("best"))
            .select("repo_id", "file_path", "line_number", F.col("best.func_id").alias("func_id")))


def verdicts(findings: DataFrame, functions: DataFrame, reached: DataFrame) -> DataFrame:
    """Reachability of source findings, in repositories that have an entry point.

    Code outside any function runs on import and counts as reached at depth 0.
    """
    with_entries = functions.where(F.col("is_entry")).select("repo_id").distinct()
    source = findings.where(F.coalesce(F.col("source_type"), F.lit("source_code")) == "source_code").join(
        with_entries, "repo_id", "left_semi")
    at = enclosing_functions(source, functions)
    placed = source.join(at, ["repo_id", "file_path", "line_number"], "left")
    # rows outside any function have no key for the join with the functions reached, and need none
    inside = placed.where(F.col("func_id").isNotNull()).join(reached, ["repo_id", "func_id"], "left").select(
        *findings.columns, "func_id", F.col("depth").isNotNull().alias("reachable"), F.col("depth").alias("call_depth"),
        F.coalesce("chain", F.array().cast("array<string>")).alias("call_chain"))
    outside = placed.where(F.col("func_id").isNull()).select(
        *findings.columns, "func_id", F.lit(True).alias("reachable"), F.lit(0).alias("call_depth"),
        F.array(F.lit(MODULE_LEVEL)).alias("call_chain"))
    return inside.unionByName(outside)
