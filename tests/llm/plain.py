"""Plain versions of the operators, one loop each, to compare with."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import public_tokenizers

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library_ids(name, texts, end):
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return [[*e.ids, end] for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def roots(items, links):
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def near_documents(docs):
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def near_vectors(rows):
    good = {i: np.array(v, "f8") for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2)
             if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    found = roots([i for i, _ in rows], links)
    count = dict.fromkeys(found, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], found[i], found[i] == i) for i in found}


def lines(docs):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for d, t in sorted(docs):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if len(key(x)) < 10 or first[key(x)] == d]
        out[d] = (len(all_lines), len(all_lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen, copied = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            copied += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copied, len(covered))
