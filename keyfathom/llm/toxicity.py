"""Toxicity: texts are restored from obfuscation first, then scored.

Leetspeak, spacing and repetition are a noisy channel.  A suspicious stretch of text is a
lattice: each symbol may stand for itself, for letters or for nothing, a repeated letter for one
or two.  The Viterbi path under a character language model, counted over all documents, is the
restored text.  Word weights and the curve from evidence to score are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import per_worker, release, stage

#: Letters of the model: word border, a to z, and one for all other characters.
SIZE = 28
ORDER = 4
#: Labelled rows that weights are learned from, at most, chosen by hash.
LABELLED = 20_000
#: Words with a weight: this much more often in toxic rows than in clean ones, and in so many that at most this many words
#: of the whole vocabulary would be there by chance.
LEAST_ODDS, BY_CHANCE = 2.0, 5.0

# What a symbol may stand for, with the cost of the substitution.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
SUBSTITUTED, SQUEEZED, DROPPED, KEPT = 1.0, 0.2, 1.5, 0.3
#: Cost of taking a letter that stands twice for one: many words have such letters.
UNDOUBLED = 3.0

_SIGNS = re.escape("".join(LEET))
_WORD = re.compile(r"[^\W\d_]+")
_GAP = r"[\s._*/\\,~-]+"
#: A letter or sign between gaps; a star is a gap there.
_ONE = rf"(?:[^\W_]|[{re.escape(''.join(c for c in LEET if c != '*'))}])"
#: Three single letters or signs or more with gaps of any length; letters with signs among or before them; a letter
#: twice or more in a word.
SUSPICIOUS = re.compile(  # every branch begins where a run begins, so that no run is tried from each of its places
    rf"(?<![^\W_])(?:{_ONE}(?:{_GAP}{_ONE}(?![^\W_])){{2,}}+"
    rf"|(?<![{_SIGNS}])[{_SIGNS}]*+[^\W\d_]++(?:[{_SIGNS}]++[^\W\d_]++)++[{_SIGNS}]*+"
    r"|[^\W_]*?([^\W\d_])\1[^\W_]*+)"
    rf"|[{_SIGNS}](?<![{_SIGNS}].)[{_SIGNS}]*+[^\W\d_]++", re.S)
_SPACED = re.compile(rf"{_ONE}(?:{_GAP}{_ONE}){{2,}}")
_GAPS, _RUN = re.compile(_GAP), re.compile(r"(.)\1*", re.S)


def folded(text: str) -> str:
    """Lower case without accents, character for character where that is possible."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_CODES = np.full(128, 27, "i8")
for _c in range(26):
    _CODES[97 + _c] = 1 + _c
for _c in " \t\n\r\x0b\x0c.,;:?!\"'()-":
    _CODES[ord(_c)] = 0


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 27)


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each run of ORDER letters occurs in all texts: SIZE ** ORDER numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(SIZE ** ORDER, "int64")
        for batch in batches:
            for text in batch.column(0):
                if not (text := text.as_py()):
                    continue
                c = np.concatenate([np.zeros(ORDER - 1, "i8"), codes(folded(text)), np.zeros(1, "i8")])
                gram = c[:len(c) - ORDER + 1]
                for k in range(1, ORDER):
                    gram = gram * SIZE + c[k:len(c) - ORDER + 1 + k]
                found, n = np.unique(gram, return_counts=True) if len(gram) < 20_000 else (None, None)
                if found is None:
                    total += np.bincount(gram, minlength=len(total))
                else:
                    total[found] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).toPandas()
    total = np.zeros(SIZE ** ORDER, "int64")
    total[found["gram"].to_numpy("int64")] = found["n"].to_numpy("int64")
    return total


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Costs -ln P(letter | three before), each order backing off to the one below."""
    table = counts.reshape((SIZE,) * ORDER).astype("f8")
    lower = np.full(SIZE, 1 / SIZE)
    for k in range(1, ORDER + 1):
        n = table.sum(axis=tuple(range(ORDER - k)))
        strength = 2.0
        lower = (n + strength * lower) / (n.sum(axis=-1, keepdims=True) + strength)
    return -np.log(lower).astype("f4")


class Decoder:
    """Viterbi decoding of suspicious stretches; equal ones are decoded once."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.reshape(-1, SIZE).tolist()
        self.known: dict[str, str] = {}

    def restore(self, text: str) -> str:
        """The folded text with its suspicious stretches decoded; the whole text, whatever its length."""
        text = folded(text)
        return SUSPICIOUS.sub(lambda m: self.stretch(m.group()), text)

    def stretch(self, noisy: str) -> str:
        if (found := self.known.get(noisy)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[noisy] = self._decode(noisy)
        return found

    def _decode(self, noisy: str) -> str:
        """Best path: states are the last three letters, each with the cheapest text that led there."""
        spaced = bool(_SPACED.fullmatch(noisy))
        if spaced:
            noisy = _GAPS.sub(" ", noisy)
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # cost, (last letter, path before it)
        runs = [len(m.group()) for m in _RUN.finditer(noisy) for _ in m.group()]
        before = ""
        for symbol, run in zip(noisy, runs, strict=True):
            choices: list[tuple[str, float]] = []
            if symbol.isalpha():
                choices.append((symbol, 0.0))
                if symbol == before:
                    choices.append(("", SQUEEZED if run > 2 else UNDOUBLED))
            else:
                choices += [(c, SUBSTITUTED) for c in LEET.get(symbol, "")]
                if spaced and symbol == " ":
                    choices.append(("", SQUEEZED))
                elif symbol not in "0123456789":
                    choices.append(("", DROPPED))
                choices.append((" " if symbol in " ._-" else symbol, KEPT + (1.0 if symbol.isdigit() else 0.5)))
            before = symbol
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, path) in states.items():
                for letter, price in choices:
                    if letter:
                        code = _CODES[ord(letter)] if letter < "\x80" else 27
                        total = cost + price + self.costs[state][code]
                        to = int((state * SIZE + code) % SIZE ** (ORDER - 1))
                    else:
                        total, to = cost + price, state
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (letter, path) if letter else path)
            states = new
        _, _, path = min((cost + self.costs[state][0], state, path) for state, (cost, path) in states.items())
        letters = []
        while path is not None:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def cost(self, text: str) -> float:
        state, total = 0, 0.0
        for code in [*codes(text).tolist(), 0]:
            total += self.costs[state][code]
            state = (state * SIZE + code) % SIZE ** (ORDER - 1)
        return total

    def weight(self, words: list[str], weights: dict[str, float]) -> float:
        """Summed weights of the words, and of those that one gap splits where the letters speak for one word."""
        total = sum(map(weights.get, filter(weights.__contains__, words)))
        for a, b in zip(words, words[1:], strict=False):
            if a + b in weights and self.cost(a + b) + DROPPED < self.cost(f"{a} {b}"):
                total += weights[a + b]
        return total


class Scorer:
    """Weights of words and the curve that turns the evidence of a text into a probability."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], curve: np.ndarray):
        self.decoder, self.weights, self.curve = Decoder(costs), weights, curve

    def evidence(self, text: str) -> tuple[float, float]:
        """(ln of 1 + summed weights, the same per word of the restored text)."""
        words = _WORD.findall(self.decoder.restore(text))
        total = self.decoder.weight(words, self.weights)
        return math.log1p(total), math.log1p(100 * total / (len(words) + 20))

    def score(self, text: str) -> float:
        x = float(np.dot(self.curve, (1.0, *self.evidence(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most LABELLED labelled rows that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("labelled_id").cast("string")) % 5 != 0)
    # Bounded by LABELLED rows of two numbers, so it may be broadcast.
    chosen = F.broadcast(known.orderBy(F.xxhash64("labelled_id"), "labelled_id", "toxic").limit(LABELLED))
    return docs.join(chosen, F.col("doc_id").cast("long") == F.col("labelled_id")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """(letter costs, word weights, curve).  Letters are counted over all documents, weights are
    learned from a bounded sample of labelled rows, whose words come back as counts.

    Near copies count once, as rows with the same least hash of three-word runs: a large group
    with one label must not decide about its words.
    """
    costs = letter_model(letter_counts(docs))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        decoder = Decoder(costs)
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = _WORD.findall(decoder.restore(text.as_py() or ""))
                runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
                out.append((min(xxhash.xxh3_64_intdigest(r) >> 1 for r in runs), sorted(set(words)), words))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.string())),
                 pa.array(columns[2], pa.list_(pa.string()))], names=["toxic", "family", "kinds", "words"])

    sample = stage(_sample(docs, labels).mapInArrow(
        words_of, "toxic int, family long, kinds array<string>, words array<string>"), "labelled-words")
    families = sample.groupBy("family", "toxic").agg(F.count(F.lit(1)).alias("rows"))
    weighted = sample.join(families, ["family", "toxic"]).withColumn("share", 1 / F.col("rows"))
    sums = weighted.groupBy("toxic").agg(F.sum("share").alias("n")).toPandas()
    size = dict(zip(sums["toxic"], sums["n"], strict=True))
    bad, good = size.get(1, 0.0), size.get(0, 0.0)
    spread = weighted.select("toxic", "share", F.explode("kinds").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("share")).otherwise(0.0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("share")).otherwise(0.0)).alias("good"))
    odds = F.ln((F.col("bad") + 0.5) / (bad + 1)) - F.ln((F.col("good") + 0.5) / (good + 1))
    # Chernoff's bound of the chance that a word as frequent as in clean rows is in so many toxic ones
    expected = (F.col("good") + 1) * (bad + 1) / (good + 1)
    surprise = F.col("bad") * F.ln(F.greatest(F.col("bad"), expected) / expected) - F.col("bad") + expected
    found = stage(spread.where("bad > 0").withColumns({"odds": odds, "surprise": surprise}), "word-odds")
    rows = found.where((F.col("odds") >= LEAST_ODDS) & (F.col("surprise") >= math.log(max(1, spread.count()) / BY_CHANCE))
                       ).select("word", "odds").collect()
    weights = {r.word: r.odds for r in rows}

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        decoder = Decoder(costs)
        for batch in batches:
            out = []
            for words in batch.column(1):
                words = words.as_py()
                total = decoder.weight(words, weights)
                out.append((math.log1p(total), math.log1p(100 * total / (len(words) + 20))))
            columns = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)],
                                             names=["toxic", "total", "density"])

    seen = sample.select("toxic", "words").mapInArrow(evidence, "toxic int, total double, density double").toPandas()
    return costs, weights, _curve(seen[["total", "density"]].to_numpy("f8"), seen["toxic"].to_numpy("f8"))


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty; without rows, what says 0.5 at some evidence.

    More evidence never lowers a score, and no evidence gives less than 0.5, whatever share of the labels is toxic.
    """
    x = np.column_stack([np.ones(len(evidence)), evidence])
    least, most = np.array([-np.inf, 0.0, 0.0]), np.array([-0.1, np.inf, np.inf])
    beta = np.array([-2.0, 1.0, 0.0])
    if len(toxic) == 0:
        return beta
    free = np.ones(3, bool)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (toxic - p) - 0.01 * beta
        # a number at its bound stays there while the slope points beyond it
        free = ~((beta <= least) & (slope < 0) | (beta >= most) & (slope > 0))
        if not free.any():
            break
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        move = np.zeros(3)
        move[free] = np.linalg.solve(hess[np.ix_(free, free)], slope[free])
        new = np.clip(beta + np.clip(move, -5, 5), least, most)
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    Null and empty texts score as texts without evidence.  A null id is not held out and not
    learned from; repeated ids are scored row by row; labels without a document do nothing.
    Without any usable label no word has a weight, and a text without evidence scores below 0.5.
    Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    costs, weights, curve = train(docs, labels)
    key = xxhash.xxh3_64_hexdigest(costs.tobytes() + repr(sorted(weights.items())).encode() + curve.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(("scorer", key), lambda: Scorer(costs, weights, curve))
        for batch in batches:
            scores = [scorer.score(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
