"""Periodic runs of words: stretches that repeat one block of words four times or more.

Positions of a text are selected at scales of 4, 8, 16 ... words.  A position of scale t is selected
where the smallest hash of the t-word stretches that begin in a window of t + 1 places stands at an
end of the window; whether it is depends on the next 2t words only, so equal contexts are selected
alike, and any t places hold a selected one unless they lie in a region of a period of t / 4 or less.
Inside a run of period q, t <= q < 2t, the same context comes again q words later and not before: so
neighbours among the selected positions of equal context propose the period, and comparing words
to both sides of such a pair gives the run.  Highly periodic regions, whose places are never
selected, are the runs that smaller scales have found; periods below 4 are found apart, by
comparing each word with the one q places on.

A text costs a few passes of numpy for each scale, so n log n for n words.  Contexts are compared by
64-bit hashes of their words; what they propose is compared word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_POWER = 6, 4
SMALL = 4
RUNS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def planted(doc_id: int | None, words: list) -> list:
    """The words with the loop that a tenth of the documents get from the digits of their id; none without an id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a:a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[:n - a]


def _spread(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: of blocks of that width, ends and beginnings."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    begins = np.minimum.accumulate(blocks, axis=1).ravel()
    ends = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(ends[:n - width + 1], begins[width - 1:n])


def _same_from(words: np.ndarray, a: int, b: int) -> int:
    """How many words are equal from a and from b > a on."""
    step, n, found = 16, len(words), 0
    while b + found < n:
        left, right = words[a + found:a + found + step], words[b + found:b + found + step]
        differ = left[:len(right)] != right
        if differ.any():
            return found + int(differ.argmax())
        found += len(right)
        step *= 2
    return found


def small_runs(words: np.ndarray, period: int) -> np.ndarray:
    """(start, end) of the stretches of one small period: each word equal to the one a period later."""
    same = np.zeros(len(words) - period + 2, bool)
    same[1:-1] = words[period:] == words[:-period]
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= (LEAST_POWER - 1) * period]
    return edges + [0, period]


def word_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start and period."""
    n = len(words)
    found: list[tuple[int, int, int]] = []  # (start, end, period)
    inner = [np.zeros((0, 2), np.int64)]
    for period in range(1, min(SMALL, n // LEAST_POWER + 1)):
        rows = small_runs(words, period)
        if period > 1 and len(rows):  # a stretch of a smaller period is its run, not this one's
            shorter = np.concatenate([inner[p] for p in range(1, period) if period % p == 0])
            rows = np.array([r for r in rows if not ((shorter[:, 0] <= r[0]) & (shorter[:, 1] >= r[1])).any()],
                            np.int64).reshape(-1, 2)
        inner.append(rows)
        found += [(int(s), int(e), period) for s, e in rows]

    hashes, scale = _spread(words.astype(np.uint64) + _MIX[1]), 1
    while LEAST_POWER * max(scale, SMALL) <= n:
        if scale >= SMALL:
            in_order = np.sort(hashes)
            if (in_order[1:] != in_order[:-1]).all():
                break  # no stretch of so many words comes twice: no longer period either
            found += _scale_runs(words, hashes, scale, found)
        # hashes of stretches of twice as many words
        hashes = _spread(hashes[:-scale] * _MIX[0] + hashes[scale:] * _MIX[1])
        scale *= 2
    rows = sorted((s, e - s, p) for s, e, p in found if e - s >= LEAST_LENGTH)
    return np.array(rows, np.int64).reshape(-1, 3)


def _scale_runs(words: np.ndarray, hashes: np.ndarray, scale: int, found: list) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of period scale to 2 * scale - 1; found: all of smaller periods."""
    masked = hashes
    regions = [(s, e) for s, e, p in found if p * LEAST_POWER <= scale <= e - s]
    if regions:
        masked = hashes.copy()
        for s, e in regions:
            masked[s:e - scale + 1] = np.iinfo(np.uint64).max
    least = _window_least(masked, scale + 1)
    n = len(least)  # positions whose 2 * scale words are inside the text
    selected = np.flatnonzero(((masked[:n] == least) | (masked[scale:scale + n] == least))
                              & (least != np.iinfo(np.uint64).max))
    if len(selected) < 2:
        return []
    contexts = _spread(hashes[selected] * _MIX[0] + hashes[selected + scale] * _MIX[1])
    order = np.argsort(contexts, kind="stable")
    contexts, places = contexts[order], selected[order]
    gaps = np.diff(places)
    close = (contexts[1:] == contexts[:-1]) & (gaps >= scale) & (gaps < 2 * scale)
    if not close.any():
        return []
    rows, reach = [], {}
    backwards = words[::-1]
    for period, place in sorted(zip(gaps[close].tolist(), places[:-1][close].tolist(), strict=True)):
        if place < reach.get(period, 0):  # inside the stretch that the pair before has given
            continue
        right = _same_from(words, place, place + period)
        left = _same_from(backwards, len(words) - place - period, len(words) - place)
        reach[period] = place + right
        if left + right >= (LEAST_POWER - 1) * period:
            rows.append((place - left, place + right + period, period))
    return rows


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that any run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _summary(doc_id: int | None, text: str | None, change: Callable[[int | None, list], list] | None) -> tuple:
    words = (text or "").encode().split()  # at the six ASCII blanks
    if change is not None:
        words = change(doc_id, words)
    numbers: dict[bytes, int] = {}
    runs = word_runs(np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words)))
    best: tuple = (None,) * 4
    if len(runs):
        start, length, period = runs.T
        # exact below 2 ** 26 words: unequal fractions of such numbers are unequal doubles
        i = np.lexsort((period, start, -(length / period)))[0]
        best = (int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i]))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def document_runs(docs: DataFrame, change: Callable[[int | None, list], list] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: its number of runs, the one of greatest exponent, digests of all runs and of the rest.

    A run has a smallest period q and at least max(6, 4 * q) words, all that the period reaches.
    Words are what ASCII blanks separate.  `change` may alter the words of a document first.  Null and
    empty texts have no runs; a null id is kept and passed on; repeated rows give repeated rows; an
    empty table none; other columns go.  One map over rows, no shuffle: a text is read whole and
    takes memory and time in proportion to its words.
    """
    names = [c.split()[0] for c in RUNS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_summary(i.as_py(), t.as_py(), change) for i, t in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(run, RUNS)
