"""Chat formatting, word runs and spelling groups against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfathom.llm import chat_format, spellings, word_runs
from keyfathom.llm.common import ship, stage

TURNS = "conv_id long, turn long, role string, text string, formatted string, block int"
DOCS = "doc_id long, text string, word string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(turns):
    written = stage(chat_format.format_turns(turns), "chat-test")
    return written, chat_format.conversation_digests(chat_format.read_turns(written))


def expected_digests(rows):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        learned = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for *_, role, text in turns)), len(learned), sha(learned))
    return out


def test_chat_round_trip(spark, table):
    ship(spark)
    marks = ["<|", "|>", "<\\|", "\\", "<", "|", "<|.|>", "<|:user|>", "é", "\n", "", ":", "x"]
    chance = random.Random(3)
    text = lambda: "".join(chance.choices(marks, k=chance.randrange(6))) if chance.random() < 0.9 else None
    roles = ["user", "assistant", "assi<|:|>\\1", None, "", "system"]
    rows = [(conv, chance.choice([None, *range(-300, 900)]), chance.choice(roles), text(), "f", 1)
            for conv in [*range(20), None] for _ in range(chance.randrange(1, 40))]
    rows += [(100, i, "user" if i < 600 else "assistant", f"t{i}", None, None) for i in range(700)]
    rows += [(101, 0, "assistant", str(i % 2000), None, None) for i in range(3000)] + rows[:5]
    rows += [(102, 0, "assistant", "long <| text " * 100_000, None, None)]
    written, found = digests(table(TURNS, *rows))
    assert {r.conv_id: tuple(r)[1:5] for r in found.collect()} == expected_digests(rows)
    parts = {r.conv_id: (r["count"], r.rows) for r in written.groupBy("conv_id").agg(
        F.count("*").alias("count"), F.max(F.size("loss")).alias("rows")).where("conv_id >= 100").collect()}
    assert parts[100][0] == 3 and parts[101][0] >= 3 and parts[101][1] <= 1024 and parts[102] == (1, 1)


def test_chat_text(spark, table):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a<|"), (1, 1, "user", "b"), (2, 0, "assistant", None)]
    written, found = digests(table(TURNS, *[(*r, None, None) for r in rows]))
    assert {r.conv_id: (r.formatted, [tuple(s) for s in r.loss]) for r in written.collect()} == {
        1: ("<|:user|>a<\\|<|.|>b<|.|><|:assistant|>c<|.|>", [(38, 1)]), 2: ("<|:assistant|><|.|>", [(14, 0)])}
    assert {r.conv_id: r.formatted_chars for r in found.collect()} == {1: 44, 2: 19}
    assert digests(table(TURNS, rows[0] + (None, None)).where("false"))[1].count() == 0


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - start
            if n >= max(6, 4 * q) and not any(words[start:start + n - p] == words[start + p:start + n] for p in range(1, q)):
                out.append([start, n, q])
            i += 1
    return sorted(out)


def test_word_runs():
    chance = random.Random(5)
    for _ in range(400):
        words = []
        for _ in range(chance.randrange(6)):
            letters = chance.randint(1, 4)
            root = [chance.randrange(letters) for _ in range(chance.randint(1, 40))] * chance.choice([1, 1, 2, 3, 6])
            loop = root * chance.randint(1, 9)
            words += loop[:max(1, len(loop) - chance.randrange(len(root)))]
            words += [chance.randrange(letters) for _ in range(chance.randrange(5))]
        assert word_runs.word_runs(np.array(words, np.int64)).tolist() == plain_runs(words)


def test_word_runs_of_documents(spark, table):
    ship(spark)
    looped = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0 and zlib.crc32(str(i).encode()) // 10 % 8 > 2)
    plain = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10)
    words = " ".join(map(str, range(500)))
    rows = [(plain, None), (plain, ""), (plain, "a a\ta\x0ba a  a b\x85b b"), (None, "x y " * 5), (None, "x y " * 5),
            (plain, "q " * 1_000_000), (looped, words), (plain, words)]
    found = word_runs.document_runs(table(DOCS, *[(*r, "w", 1) for r in rows]), word_runs.planted).collect()
    short = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed_sha256) for r in found]
    none = (0, None, None, None, None)
    assert short[:6] == [
        (plain, *none, sha("")), (plain, *none, sha("")), (plain, 1, 0, 6, 1, 6000, sha("a b\x85b b")),
        (None, 1, 0, 10, 2, 5000, sha("x y")), (None, 1, 0, 10, 2, 5000, sha("x y")),
        (plain, 1, 0, 1_000_000, 1, 1_000_000_000, sha("q"))]
    h = zlib.crc32(str(looped).encode()) // 10
    a = h % 500
    period = 1 + (500 - a) // (3 + h % 8)
    assert short[6][1:5] == (1, a, 500 - a, period)
    assert short[7] == (plain, *none, sha(words))
    assert found[0].runs_sha256 == sha("") and found[2].runs_sha256 == sha("0,6,1\n")
    assert word_runs.document_runs(table(DOCS, (1, "a", "w", 1)).where("false")).count() == 0


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in spellings.LETTERS.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    links = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(links[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 5 * words[w] else None for w, v in best.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(links[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("rows", [1, 7, 1024])
def test_spelling_groups(spark, table, monkeypatch, rows):
    ship(spark)
    monkeypatch.setattr(spellings, "SLICE_ROWS", rows)
    chance = random.Random(rows)
    stems = ["planets", "Großmutter", "élevées", "aaaaaa", "abcdefghij" * 30]
    def word():
        letters = list(chance.choice(stems))
        for _ in range(chance.choice([0, 0, 0, 0, 1, 1, 2])):
            at = chance.randrange(len(letters))
            letters[at:at + chance.choice([0, 1])] = chance.choice(["", "a", "é", "ÿ", "À", "×"])
        return "".join(letters)
    docs = [(i, chance.choice([" ", "_", "1\n"]).join(word() for _ in range(400))) for i in range(12)]
    docs += [(50, "planetz " * 100 + "planetzz " * 8), (None, "planets " * 300), (3, None), (3, ""), (3, "planets " * 50), (3, "planets " * 50)]
    found = spellings.spelling_groups(table(DOCS, *[(*d, "w", 1) for d in docs]), spellings.shortened).collect()
    expected = plain_groups(docs)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected
    assert len(found) == len(expected) and any(v[0] and v[1] != v[0] for v in expected.values())


def test_spellings_of_nothing(spark, table):
    assert spellings.spelling_groups(table(DOCS, (1, "planets", "w", 1)), spellings.shortened).count() == 0
    assert spellings.spelling_groups(table(DOCS, (1, "planets", "w", 1)).where("false")).count() == 0
