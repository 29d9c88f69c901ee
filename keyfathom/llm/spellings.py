"""Words grouped with their misspellings: pairs one edit apart, found by products of letter counts.

A word is a vector of letter counts.  One replaced letter gives vectors of squared distance 2, one
inserted or deleted letter of 1, so only pairs at most 2 apart can be one edit apart.  Words are dealt
into blocks by length and by how many of their letters fall into each of five groups of letters; one
edit changes each of these numbers by at most one, so a block meets few others, of its own and the next
length.  Blocks are cut into slices of bounded size, and a task compares two slices: all squared
distances by one matrix product, then the edits of the close pairs, letter by letter.

The distinct words of a corpus grow far slower than its text.  Comparing grows with the square
of a block's words, shared out evenly over tasks whatever the block's size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import stage

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)])
#: Of five letters that follow each other in the alphabet, one each is in every group.
GROUPS = 5
#: Most rows of a slice, and most letters of its rows together.
SLICE_ROWS, SLICE_LETTERS = 1024, 1 << 20
SPLIT = 199


def shortened(doc_id: int | None, runs: set[str]) -> dict[str, str]:
    """What the runs of a document become that lose a letter: those whose checksum with the id is divisible by 199.

    Without an id none does.
    """
    if doc_id is None:
        return {}
    start = zlib.crc32(f"{doc_id}:".encode())
    out = {}
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        if not h % SPLIT:
            at = h % len(run)
            out[run] = run[:at] + run[at + 1:]
    return out


def word_counts(docs: DataFrame, change: Callable[[int | None, set[str]], dict[str, str]] | None, least_letters: int,
                least_count: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words with enough letters that occur often enough; counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for doc_id, text in zip(*batch.columns, strict=True):
                if not text.is_valid:
                    continue
                runs = LETTERS.findall(text.as_buffer().to_pybytes().lower().decode())  # bytes: A-Z only
                total.update(runs)
                for word, other in (change(doc_id.as_py(), set(runs)) if change else {}).items():
                    n = runs.count(word)
                    total[word] -= n
                    total[other] += n
            long = [(w, n) for w, n in total.items() if n and len(w) >= least_letters]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()),
                                              pa.array([n for _, n in long], pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def _block() -> Column:
    """Length and letters of each group but the last, as one array."""
    members = ["".join(map(chr, ALPHABET[g::GROUPS])) for g in range(GROUPS - 1)]
    kept = [F.length(F.regexp_replace("word", f"[^{m}]", "")).cast("int") for m in members]
    return F.array(F.length("word").cast("int"), *kept)


def _neighbours(block: Column) -> Column:
    """The block itself and those that one edit leads to and that come later, by length and then by counts.

    Every pair of blocks is met once, from its first.
    """
    steps = [[0] * GROUPS]
    for g in range(GROUPS):  # one letter more, of group g; the last group has no count of its own
        steps.append([1] + [int(k == g) for k in range(GROUPS - 1)])
    for g in range(GROUPS):
        for h in range(GROUPS):
            step = [0] + [int(k == h) - int(k == g) for k in range(GROUPS - 1)]
            if step > [0] * GROUPS:
                steps.append(step)
    return F.array(*[F.array(*[block[k] + F.lit(s) for k, s in enumerate(step)]) for step in steps])


def _letters(words: list[str], width: int) -> np.ndarray:
    """One row of code points per word, zeros after its end."""
    return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """One row of letter counts per word."""
    place = np.zeros(0x100, np.int64)
    place[ALPHABET] = np.arange(len(ALPHABET)) + 1
    at = place[codes] + np.arange(len(codes))[:, None] * (len(ALPHABET) + 1)
    counts = np.bincount(at.ravel(), minlength=len(codes) * (len(ALPHABET) + 1))
    return counts.reshape(len(codes), -1)[:, 1:]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows, words of equal length or the second one longer by one, are exactly one edit apart."""
    lengths = (short > 0).sum(axis=1), (long > 0).sum(axis=1)
    differ = short != long
    replaced = (lengths[0] == lengths[1]) & (differ.sum(axis=1) == 1)
    first = differ.argmax(axis=1)[:, None]
    after = np.arange(short.shape[1] - 1)[None, :] >= first
    inserted = (lengths[0] + 1 == lengths[1]) & ~((short[:, :-1] != long[:, 1:]) & after).any(axis=1)
    return replaced | inserted


def near_pairs(left: list[str], right: list[str], lone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart, in the left side and in both sides one after the other.

    Words of the right side are as long as those of the left or one letter longer.  Pairs of two
    words of the left side are looked for if lone, once each.
    """
    width = max(map(len, [*left, *right])) + 1
    codes = _letters([*left, *right], width)
    counts = _letter_counts(codes).astype("f4" if width < 1 << 10 else "f8")  # whole numbers, exact in either
    squares, n = (counts * counts).sum(axis=1, keepdims=True), len(left)
    ones = np.ones_like(squares)
    # |x|^2 + |y|^2 - 2xy in one product
    distance = np.hstack([counts[:n], squares[:n], ones[:n]]) @ np.hstack([-2 * counts, ones, squares]).T
    i, j = np.divmod(np.flatnonzero(distance <= 2), len(counts))
    keep = (distance[i, j] > 0) & ((j > i) & lone | (j >= n))
    i, j = i[keep], j[keep]
    good = np.zeros(len(i), bool)
    step = max(1, (1 << 24) // width)
    for k in range(0, len(i), step):
        good[k:k + step] = one_edit(codes[i[k:k + step]], codes[j[k:k + step]])
    return i[good], j[good]


def variant_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways round, of all words (word, n) that are one edit apart."""
    blocked = words.withColumn("block", _block())
    # a block's slices: as many as its rows and letters need
    room = F.greatest(F.lit(1), F.least(F.lit(SLICE_ROWS), F.floor(SLICE_LETTERS / F.col("block")[0])))
    sizes = stage(blocked.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).select(
        "block", F.ceil(F.col("rows") / room).cast("int").alias("slices")), "spelling-blocks")
    rows = stage(blocked.join(sizes, "block").select(
        "word", "n", "block", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int").alias("slice")), "spelling-words")
    # blocks that both have words, met from the first; task (block, first, second) compares the block's
    # slice `first` with slice `second` of all it meets, and with itself where these are the same
    pairs = stage(sizes.withColumn("other", F.explode(_neighbours(F.col("block")))).join(
        sizes.select(F.col("block").alias("other"), F.col("slices").alias("other_slices")), "other"), "spelling-meetings")
    most = pairs.groupBy("block").agg(F.max("other_slices").alias("most"))
    column = ["word", "n", "block", "first", "second", "side"]
    lefts = rows.join(most, "block").withColumn("second", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).select(
        "word", "n", "block", F.col("slice").alias("first"), "second", F.lit(0).alias("side"))
    rights = rows.withColumnRenamed("block", "other").join(pairs, "other").withColumn("last", F.when(
        F.col("block") == F.col("other"), F.col("slice")).otherwise(F.col("slices")) - 1).where("last >= 0").withColumn(
        "first", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "word", "n", "block", "first", F.col("slice").alias("second"), F.lit(1).alias("side"))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("side")
        words, n = rows["word"].to_pylist(), pc.sum(pc.equal(rows["side"], 0)).as_py()
        i = j = np.zeros(0, np.int64)
        if n:
            i, j = near_pairs(words[:n], words[n:], rows["first"][0] == rows["second"][0])
        return pa.table([rows[c].take(k) for k in (i, j) for c in ("word", "n")], names=["word", "n", "other", "other_n"])

    found = stage(lefts.select(column).unionByName(rights.select(column)).groupBy("block", "first", "second")
                  .applyInArrow(compare, "word string, n long, other string, other_n long"), "spelling-pairs")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def spelling_groups(docs: DataFrame, change: Callable[[int | None, set[str]], dict[str, str]] | None = None,
                    least_letters: int = 6, least_count: int = 5, ratio: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word.

    Words are the runs of Latin letters of the texts, A-Z in lower case, other letters as they are; `change` names
    those of a document that count as others.  Near words are one inserted, deleted or replaced letter apart.  The
    form is the most frequent near word (ties: smallest in code-point order) if it is `ratio` times as
    frequent as the word, else null; the root is where the forms lead, the word itself without one.
    Null and empty texts have no words, null ids change none, repeated rows count again, other columns
    go, and an empty table gives no rows.
    """
    words = stage(word_counts(docs, change, least_letters, least_count, id_col, text_col), "spelling-counts")
    best = variant_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(
            F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("best")), "spelling-forms")
    # a form is `ratio` times as frequent as its word, so no path is longer than the logarithm of the counts;
    # each round doubles what a word has followed
    ends = formed.where("best IS NOT NULL").select("word", F.col("best.form").alias("root"))
    while True:
        ends = stage(ends, "spelling-roots")
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ends.join(onward, "root", "left_semi").isEmpty():
            break
        ends = ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return formed.join(ends, "word", "left").select(
        "word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("best.form_n").alias("form_n"))
