"""What can be told about a detection pattern before it runs.

A regular expression is costly on every line of a corpus while a substring test
is cheap, so each pattern is guarded by text it cannot match without.
"""

from __future__ import annotations

import re

FLAGS = "(?imd)"  # ignore case, ^/$ at line ends, only \n ends a line


def spans_lines(pattern: str) -> bool:
    """True when a match may contain a newline."""
    if r"\s" in pattern:
        return True
    return any(r"\n" not in cls for cls in re.findall(r"\[\^[^\]]*\]", pattern))


def alternatives(pattern: str) -> list[str]:
    """Split at top-level ``|``."""
    parts, depth, start, i = [], 0, 0, 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    parts.append(pattern[start:])
    return parts


def required_runs(pattern: str, fold: bool = True) -> list[str]:
    """Literal runs every match of an alternation-free pattern contains.

    Lower-cased unless the pattern is to be matched case-sensitively.
    """
    runs: list[str] = []
    run = ""
    i = 0

    def close() -> None:
        nonlocal run
        if run:
            runs.append(run.lower() if fold else run)
        run = ""

    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            i += 2
            if nxt in "bB":
                continue
            if nxt.isalnum():
                close()
                continue
            run += nxt
        elif ch == "[":
            close()
            i = pattern.index("]", i + 2) + 1
        elif ch == "(":
            close()
            depth = 0
            while True:
                if pattern[i] == "\\":
                    i += 2
                    continue
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 1
                if depth == 0:
                    break
        elif ch in "?*{":
            run = run[:-1]
            close()
            if ch == "{":
                i = pattern.index("}", i)
            i += 1
        elif ch in "+.":
            close()
            i += 1
        elif ch in "^$":
            i += 1
        else:
            run += ch
            i += 1
    close()
    return [r for r in runs if r.strip()]


def _separators(pattern: str) -> list[str]:
    """Spell out a lone optional separator, which makes for longer literal runs."""
    if pattern.count("[-_]?") != 1:
        return [pattern]
    return [pattern.replace("[-_]?", sep) for sep in ("", "-", "_")]


def _expanded(pattern: str, fold: bool) -> list[list[str]]:
    """Required runs of each way to match; a group that is all there is gets opened."""
    found = []
    for alternative in alternatives(pattern):
        for spelled in _separators(alternative):
            runs = required_runs(spelled, fold)
            group = re.fullmatch(r"((?:\\b)?)\((?:\?:)?(.*)\)((?:\\b)?)", spelled)
            if not runs and group:
                found += [required_runs(inner, fold) for inner in alternatives(group[2])]
            else:
                found.append(runs)
    return found


def _common_part(a: str, b: str) -> str:
    """Longest substring of both."""
    return max((a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b),
               key=len, default="")


def guard_tokens(patterns: list[str], fold: bool = True, min_length: int = 4, share: int = 5) -> list[str]:
    """A short list of substrings; a match of any pattern contains at least one.

    Greedy cover: a token serves every pattern one of whose required runs
    contains it.  Tokens shorter than ``min_length`` are used only for patterns
    that offer nothing longer, since short ones are found in ordinary prose.
    Tokens with ``share`` or more characters in common become that common part.
    """
    needs = [runs for p in patterns for runs in _expanded(p, fold)]
    if any(not runs for runs in needs):
        raise ValueError("a pattern without required text cannot be guarded")
    tokens = {max(runs, key=len) for runs in needs if max(map(len, runs)) < min_length}

    def uncovered(runs: list[str]) -> bool:
        return not any(t in r for t in tokens for r in runs)

    while open_needs := [runs for runs in needs if uncovered(runs)]:
        candidates = sorted({r for runs in open_needs for r in runs if len(r) >= min_length})
        tokens.add(max(candidates, key=lambda c: (
            sum(any(c in r for r in runs) for runs in open_needs), len(c))))
    return shared_tokens(tokens, share)


def shared_tokens(tokens: set[str], share: int = 5) -> list[str]:
    """Tokens with pairs replaced by their common part, if that is long and most of both."""
    merged = set(tokens)
    while True:
        pairs = [(a, b, _common_part(a, b)) for a in sorted(merged) for b in sorted(merged) if a < b]
        pairs = [p for p in pairs if p[2] in p[:2] or (
            len(p[2]) >= share and 2 * len(p[2]) >= max(len(p[0]), len(p[1])))]
        if not pairs:
            return sorted(merged)
        a, b, part = max(pairs, key=lambda p: (len(p[2]), p))
        merged = (merged - {a, b}) | {part}


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of the given ones does."""
    return FLAGS + "|".join(f"(?:{p})" for p in patterns)
