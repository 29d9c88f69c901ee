"""How easily a repository could change its cryptography.

Signals are looked for in production files only.  A signal counts once per file:
at the first line that matches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import signals
from keyfathom.functions import paths, text
from keyfathom.functions.grades import lookup
from keyfathom.functions.sqltext import literal
from keyfathom.operators.detect import unnest

CONTEXT_CHARS = 300


def _first_hit(kind: str, pattern: str, description: str, weight: int, exclude: str | None) -> str:
    hits = text.single_line_hits([pattern], exclude)
    return (f"transform(slice({hits}, 1, 1), n -> named_struct('kind', {literal(kind)}, "
            f"'description', {literal(description)}, 'weight', {weight}, 'line_number', n))")


def is_production(path: Column) -> Column:
    return ~paths.is_test_path(path) & ~paths.is_vendor_path(path)


def signal_tokens() -> list[str]:
    return text.all_tokens([[row[0]] for row in [*signals.AGILITY_SIGNALS, *signals.HYBRID_SIGNALS]])


def signal_array() -> Column:
    """Signals of the file in this row, prepared by :func:`text.with_lines`."""
    parts = [_first_hit("agility", p, d, w, signals.NON_CRYPTO_LINE) for p, w, d in signals.AGILITY_SIGNALS]
    parts += [_first_hit("hybrid", p, d, 0, None) for p, d in signals.HYBRID_SIGNALS]
    return F.expr(f"concat({', '.join(parts)})")


def signal_context(found: str, shown: str) -> Column:
    """The same with the source lines around each signal."""
    return F.transform(found, lambda s: F.struct(
        s["kind"].alias("kind"), s["description"].alias("description"), s["weight"].alias("weight"),
        s["line_number"].alias("line_number"),
        F.left(text.window_of_lines(F.col(shown), s["line_number"] - 1, s["line_number"] + 2),
               F.lit(CONTEXT_CHARS)).alias("context")))


def signal_rows(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, kind, description, weight, line_number, context).

    ``kind`` is agility for signals that carry a weight and hybrid for signs of
    classical and post-quantum cryptography side by side; one pass finds both.
    """
    ready = text.with_lines(files.where(is_production(F.col("file_path"))), signal_tokens())
    shown = text.split_lines(text.without_last_newline(F.col("content")))
    ready = ready.select("repo_id", "file_path", shown.alias("shown"), signal_array().alias("found"))
    ready = ready.select("repo_id", "file_path", signal_context("found", "shown").alias("found"))
    return unnest(ready, ["repo_id", "file_path"], "found")


def agility_signals(files: DataFrame) -> DataFrame:
    return signal_rows(files).where(F.col("kind") == "agility").drop("kind")


def hybrid_signals(files: DataFrame) -> DataFrame:
    return signal_rows(files).where(F.col("kind") == "hybrid").drop("kind", "weight")


def _level_of(score: Column) -> Column:
    return (F.when(score <= 0, 1).when(score <= 2, 2).when(score <= 4, 3)
            .when(score <= 7, 4).otherwise(5))


def agility_levels(repos: DataFrame, found: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and level of every repository in ``repos(repo_id)``.

    ``found`` comes from :func:`signal_rows`.  Both inputs are reduced to one
    row per repository before they meet.
    """
    scored = found.groupBy("repo_id").agg(
        F.sum("weight").alias("raw_score"),
        F.bool_or(F.col("description") == signals.KEY_ANCHOR).alias("key_anchor"),
        F.bool_or(F.col("description") == signals.WEAK_RSA_ANCHOR).alias("rsa_anchor"),
        F.bool_or(F.col("kind") == "hybrid").alias("has_hybrid"))
    critical = (findings.where((F.col("risk_level") == "CRITICAL") & is_production(F.col("file_path")))
                .groupBy("repo_id").agg(F.count("*").alias("critical_count")))
    joined = (repos.select("repo_id").distinct()
              .join(scored, "repo_id", "left").join(critical, "repo_id", "left")
              .na.fill(0, ["raw_score", "critical_count"])
              .na.fill(False, ["key_anchor", "rsa_anchor", "has_hybrid"]))
    anchored = (F.when(F.col("key_anchor"), F.least(F.col("raw_score"), F.lit(0)))
                .when(F.col("rsa_anchor"), F.least(F.col("raw_score"), F.lit(2)))
                .otherwise(F.col("raw_score")))
    score = F.when(F.col("has_hybrid"), F.greatest(anchored, F.lit(3))).otherwise(anchored)
    cap = F.when(F.col("critical_count") >= 10, 2).when(F.col("critical_count") >= 1, 3).otherwise(5)
    graded = joined.select("repo_id", "has_hybrid", "critical_count", score.alias("agility_score"))
    graded = graded.withColumn("raw_level", _level_of(F.col("agility_score"))).withColumn(
        "agility_level", F.least(F.col("raw_level"), cap))
    label = lookup(F.col("agility_level"), signals.AGILITY_LABELS)
    notice = F.when(F.col("agility_level") < F.col("raw_level"), F.concat(
        F.lit("⚠ Agility capped at L"), F.col("agility_level").cast("string"), F.lit(" ("), label,
        F.lit(") — "), F.col("critical_count").cast("string"), F.lit(" CRITICAL finding"),
        F.when(F.col("critical_count") != 1, "s").otherwise(""),
        F.lit(" in production code must be resolved first")))
    return graded.select("repo_id", "agility_level", label.alias("agility_label"), "agility_score",
                         "has_hybrid", "critical_count", notice.alias("cap_notice"))
