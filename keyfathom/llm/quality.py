"""Quality rules: plain limits first, then robust multivariate outliers per language and source.

Each document is a vector of transformed statistics.  Of every group the minimum covariance
determinant is sought: mean and covariance of those three quarters of its documents that lie
closest together, by concentration steps over all documents, from two starts at once; the start
with the smaller determinant wins.  A document too far from its group by Mahalanobis distance is
rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfathom.llm.common import release, stage

#: Share of a group that the estimate is made of.
SHARE = 0.75
#: A clean document is further away than the limit with this probability.
TAIL = 1e-9
STEPS = 5
#: Smaller groups are judged by all documents of their language, and these by all.
LEAST_GROUP = 60
#: Distance bins per doubling; bounds the rows of the distance histogram.
BINS = 64
#: Transformed statistics: name, SQL over the counts, and a spread that never counts as far.
VECTOR = [
    ("size", "ln(1 + n_words)", 0.3),
    ("word_length", "ln(word_chars / n_words)", 0.06),
    ("symbols", "ln(1 + n_symbols / n_words)", 0.03),
    ("copied_lines", "n_dup_lines / n_full_lines", 0.12),
    ("repeats", "n_repeat_words / n_words", 0.12),
]
DIM = len(VECTOR)
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_full_lines long"
_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_BLANK = b" \t\n\r\x0b\x0c"


def text_counts(raw: bytes) -> tuple[int, ...]:
    """The counts of one text, given as UTF-8; all zero without words."""
    words = raw.split()
    n = len(words)
    letters = b"".join(words)
    chars = len(letters.decode()) if not letters.isascii() else len(letters)
    symbols = sum(map(letters.count, _SYMBOLS))
    seen: set[bytes] = set()
    full = copied = 0
    for line in raw.split(b"\n"):
        if line.strip(_BLANK):
            full += 1
            copied += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    found = set(windows)
    repeated = 0
    if len(found) < len(windows):
        times = Counter(windows)
        many = np.array([times[w] > 1 for w in windows] + [False, False])
        repeated = int((many | np.r_[False, many[:-1]] | np.r_[False, False, many[:-2]]).sum())
    return n, chars, symbols, copied, repeated, full


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")
            ) -> DataFrame:
    """(doc_id, lang, source, counts): texts are read once and leave as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = COUNTS.replace(",", "").split()[::2]
        for batch in batches:
            rows = [text_counts(text.as_py() or b"") for text in batch.column(3)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc_id", "lang", "source", *names])

    lang, source = groups
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"),
                       F.col(source).cast("string").alias("source"),
                       F.col(text_col).cast("string").cast("binary")).mapInArrow(
        run, f"doc_id long, lang string, source string, {COUNTS}")


def chi2_quantile(p: float, dim: int) -> float:
    """Where the chi-square distribution leaves 1 - p above."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if chi2_above(mid, dim) < 1 - p else (mid, high)
    return high


def chi2_above(x: float, dim: int) -> float:
    """Upper tail for an odd or even number of degrees of freedom, as a finite sum."""
    if dim % 2:
        total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(1, dim, 2):
            total += term
            term *= x / (k + 2)
        return total
    total, term = 0.0, math.exp(-x / 2)
    for k in range(dim // 2):
        total += term
        term *= x / 2 / (k + 1)
    return total


def _distance() -> Column:
    """Squared Mahalanobis distance of the columns x0... from `center` with `precision`."""
    gap = [F.col(f"x{i}") - F.get("center", F.lit(i)) for i in range(DIM)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + gap[i] * gap[j] * F.get("precision", F.lit(k)) * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, sums and sums of products, combined before the shuffle."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products).select(
        *keys, "n", F.array(*(f"s{i}" for i in range(DIM))).alias("sums"),
        F.array(*(f"p{k}" for k in range(len(_PAIRS)))).alias("products"))


FIT = "grp string, start int, center array<double>, precision array<double>, log_det double"


def _fits(moments: DataFrame, scale: float) -> DataFrame:
    """Center and inverse covariance per row of moments, one row per group and start.

    The least spread of each statistic is added, so a group whose statistic never varies has an inverse.
    """
    floor = np.diag([spread ** 2 for _, _, spread in VECTOR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, start, n, sums, products in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                center = np.array(sums) / n
                cov = np.zeros((DIM, DIM))
                for (i, j), p in zip(_PAIRS, products, strict=True):
                    cov[i, j] = cov[j, i] = p / n - center[i] * center[j]
                cov = cov * scale + floor
                inverse = np.linalg.inv(cov)
                rows.append((grp, start, center, [inverse[i, j] for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["grp", "start", "center", "precision", "log_det"])

    return moments.select("grp", "start", "n", "sums", "products").mapInArrow(run, FIT)


def _scaled(step: float):
    return lambda v: v * step


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts per group: medians with the middle half's spread, and all rows' moments."""
    # Quartiles from counts per group, statistic and bin: combined before the shuffle, never held per group.
    bins = rows.select("grp", F.posexplode(F.array(*(F.round(F.col(f"x{i}") / (VECTOR[i][2] / 10)) for i in range(DIM)))))
    counts = bins.groupBy("grp", "pos", "col").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("grp", "pos")
    summed = counts.withColumn("up_to", F.sum("n").over(own.orderBy("col"))).withColumn("all", F.sum("n").over(own))
    marks = [F.min(F.when(F.col("up_to") >= F.col("all") * q, F.col("col"))) for q in (0.25, 0.5, 0.75)]
    quartiles = summed.groupBy("grp", "pos").agg(F.array(*marks).alias("q"))
    middle = quartiles.groupBy("grp").agg(*(F.transform(F.first(F.when(F.col("pos") == i, F.col("q")), True),
                                                        _scaled(VECTOR[i][2] / 10)).alias(f"q{i}")
                                            for i in range(DIM)))
    spread = [F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, 2) + VECTOR[i][2] ** 2
              for i in range(DIM)]
    diagonal = [F.lit(1.0) / spread[i] if i == j else F.lit(0.0) for i, j in _PAIRS]
    robust = middle.select("grp", F.lit(0).alias("start"),
                           F.array(*(F.get(f"q{i}", F.lit(1)) for i in range(DIM))).alias("center"),
                           F.array(*diagonal).alias("precision"), F.lit(0.0).alias("log_det"))
    plain = _fits(_moments(rows.withColumn("start", F.lit(1)), ["grp", "start"]), 1.0)
    return robust.unionByName(plain)


def concentrate(rows: DataFrame, fits: DataFrame, scale: float) -> DataFrame:
    """One step for every group and start: the fit of the nearest share of rows under the last fit.

    The cut is found from a histogram of distances, so no group is sorted or held.
    """
    near = rows.join(fits, "grp").withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int"))
    counts = near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("grp", "start")
    cuts = counts.withColumn("up_to", F.sum("n").over(own.orderBy("bin"))).withColumn(
        "all", F.sum("n").over(own)).where(F.col("up_to") >= F.ceil(F.col("all") * SHARE)).groupBy(
        "grp", "start").agg(F.min("bin").alias("cut"))
    inner = near.join(cuts, ["grp", "start"]).where("bin <= cut")
    return stage(_fits(_moments(inner, ["grp", "start"]), scale), "concentrated")


def _group(*keys: str) -> Column:
    """Name of a group: nulls are written out, so that it cannot meet the name of a pooled one."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every document.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three; such
    documents are not judged further and not part of any estimate.  A null or empty text has no
    words and fails; null languages and sources are groups like others; ties and repeated rows count
    as often as they occur; a null id is carried along.  An empty table gives no rows.
    """
    rows = counted(docs, id_col, text_col, groups)
    base = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    rows = stage(rows.withColumn("base_failed", F.expr(base)), "counts")
    fine = rows.where("NOT base_failed")
    sizes = fine.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"))
    sizes = sizes.withColumn("of_lang", F.sum("own").over(Window.partitionBy("lang")))
    name = F.when(F.col("own") >= LEAST_GROUP, _group("lang", "source")).when(
        F.col("of_lang") >= LEAST_GROUP, _group("lang")).otherwise(F.lit("all"))
    names = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), name.alias("grp"), "own", "of_lang")
    vector = fine.join(names, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "grp", "lang", "own", "of_lang", *(F.expr(sql).alias(f"x{i}") for i, (_, sql, _) in enumerate(VECTOR)))
    # A pooled group is estimated from all its language's or all documents, not from the small ones only.
    pooled = stage(vector, "vectors-of-counts")
    xs = [f"x{i}" for i in range(DIM)]
    wanted = pooled.select("grp").distinct()
    samples = pooled.select("grp", *xs).where(F.col("own") >= LEAST_GROUP).unionByName(
        pooled.select(_group("lang").alias("grp"), *xs)).unionByName(
        pooled.select(F.lit("all").alias("grp"), *xs)).join(wanted, "grp", "left_semi")
    inner = chi2_quantile(SHARE, DIM)
    scale = SHARE / (1 - chi2_above(inner, DIM + 2))
    fits = stage(_starts(samples), "starts")
    for _ in range(STEPS):
        fits = concentrate(samples, fits, scale)
    best = fits.groupBy("grp").agg(F.min_by(F.struct("center", "precision"), F.struct("log_det", "start")).alias("fit"))
    best = best.select("grp", "fit.center", "fit.precision")
    limit = chi2_quantile(1 - TAIL, DIM)
    # The distance needs the counts only, so it is computed where the counts are.
    graded = rows.join(names, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").join(
        best, "grp", "left")
    for i, (_, sql, _) in enumerate(VECTOR):
        graded = graded.withColumn(f"x{i}", F.when(~F.col("base_failed"), F.expr(sql)))
    distance = F.when(~F.col("base_failed"), F.sqrt(_distance()))
    return graded.withColumn("distance", distance).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))).alias("kept"))
