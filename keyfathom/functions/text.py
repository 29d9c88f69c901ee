"""Expressions over source text.

Everything here works inside one row (one file), so a corpus is scanned by a
single map stage: no line explosion before matching and no shuffle.  Matching
expressions are SQL text over these columns, which :func:`with_lines` adds:

``content``  the text, free of the match mark
``lower``    the same in lower case
``present``  those guard tokens that occur in it
``lines``    structs (t = line, l = line in lower case); null without any token
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.functions.patterns import FLAGS, any_of, guard_tokens, required_runs, spans_lines
from keyfathom.functions.sqltext import literal

_MARK = "\u0001"  # put in front of matches; swapped for \u0002 where text has it
_MARK_STAND_IN = "\u0002"
_NO_LINES = "CAST(array() AS array<int>)"


def decode_text(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 dropped, line ends unified."""
    text = F.make_valid_utf8(content.cast("string"))
    return unify_newlines(F.replace(text, F.lit("�"), F.lit("")))


def unify_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def without_last_newline(text: Column) -> Column:
    """A newline at the very end closes the last line, it does not open another."""
    return F.regexp_replace(text, "\n\\z", "")


def markable(text: Column) -> Column:
    """Text free of the match mark; both characters look the same to every pattern."""
    marked = F.contains(text, F.lit(_MARK))
    return F.when(marked, F.translate(text, _MARK, _MARK_STAND_IN)).otherwise(text)


def with_lines(files: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Add the columns matching works on; each token is looked for once per file."""
    ready = files.withColumn("content", markable(unify_newlines(F.col("content"))))
    ready = ready.withColumn("lower", F.lower("content"))
    found = ", ".join(f"CASE WHEN contains(lower, {literal(t)}) THEN {literal(t)} END" for t in tokens)
    ready = ready.withColumn("present", F.expr(f"array_compact(array({found}))"))
    return ready.withColumn("lines", F.expr(
        "CASE WHEN size(present) > 0 THEN "
        "transform(split(content, '\\n', -1), x -> named_struct('t', x, 'l', lower(x))) END"))


def _has_any(column: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(t)})" for t in tokens) + ")"


def _guard(found: str, condition: str, guarded: bool) -> str:
    return f"(CASE WHEN {condition} THEN {found} ELSE {_NO_LINES} END)" if guarded else found


def _any_present(tokens: list[str]) -> str:
    return f"arrays_overlap(present, {literal(tokens)})"


def single_line_hits(patterns: list[str], exclude: str | None = None, guarded: bool = True) -> str:
    """Numbers (from 1) of the lines any of the newline-free patterns matches."""
    tokens = guard_tokens(patterns)
    test = f"x.t RLIKE {literal(any_of(patterns))}"
    if guarded:
        test = f"{_has_any('x.l', tokens)} AND {test}"
    if exclude:
        test += f" AND NOT x.t RLIKE {literal(FLAGS + exclude)}"
    found = f"array_compact(transform(lines, (x, i) -> CASE WHEN {test} THEN i + 1 END))"
    return _guard(found, _any_present(tokens), guarded)


def match_lines(regex: str, column: str = "content") -> str:
    """Numbers of the lines on which a match starts.

    Matches may run over several lines, so the whole text is searched.  A mark
    is put in front of every match; the lines holding a mark are the answer.
    """
    marked = f"regexp_replace({column}, {literal(regex)}, '{_MARK}$0')"
    return (f"array_compact(transform(split({marked}, '\\n', -1), "
            f"(x, i) -> CASE WHEN contains(x, '{_MARK}') THEN i + 1 END))")


def multi_line_hits(pattern: str, guarded: bool = True) -> str:
    """:func:`match_lines` of one pattern, for files that have all it needs."""
    rarest_first = sorted(required_runs(pattern), key=len, reverse=True)
    needed = " AND ".join(f"contains(lower, {literal(t)})" for t in rarest_first)
    return _guard(match_lines(FLAGS + pattern), needed, guarded)


def hit_lines(patterns: list[str], guarded: bool = True) -> str:
    """Distinct line numbers on which a match of any pattern starts."""
    flat = [p for p in patterns if not spans_lines(p)]
    parts = [single_line_hits(flat, guarded=guarded)] if flat else []
    parts += [multi_line_hits(p, guarded) for p in patterns if spans_lines(p)]
    found = parts[0] if len(parts) == 1 else f"array_distinct(concat({', '.join(parts)}))"
    return _guard(found, _any_present(guard_tokens(patterns)), guarded)


def all_tokens(pattern_lists: list[list[str]]) -> list[str]:
    """Tokens that guard any of several pattern lists, each once."""
    return sorted({t for patterns in pattern_lists for t in guard_tokens(patterns)})


def window_of_lines(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, both included) joined again; cut at the text's ends."""
    start = F.greatest(first, F.lit(1))
    length = F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))
    return F.array_join(F.slice(lines, start, length), "\n")
