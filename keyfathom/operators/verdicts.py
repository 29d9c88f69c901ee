"""Reading the free-text answers of a validation model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades

EXPLANATION_CHARS = 500
FALLBACK_CHARS = 300
FALLBACK_CONFIDENCE = 0.4


def normalise(responses: DataFrame, column: str = "response") -> DataFrame:
    """Add is_crypto_usage, confidence, label and explanation to raw responses.

    The first ``{...}`` span is parsed once code fences are gone.  Responses
    without readable JSON are judged by the words they contain.
    """
    bare = F.trim(F.regexp_replace(column, "```[a-z]*\n?", ""))
    span = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    schema = "is_crypto_usage boolean, confidence string, label string, explanation string"
    parsed = F.from_json(span, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = responses.withColumn("_j", F.when((span != "") & F.try_parse_json(span).isNotNull(), parsed))
    confidence = F.expr("try_cast(coalesce(_j.confidence, '0.5') AS double)")
    rows = rows.withColumn("_c", confidence)
    ok = F.col("_j").isNotNull() & F.col("_c").isNotNull()
    lower = F.lower(F.col(column))
    dismissed = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in grades.FALSE_POSITIVE_WORDS])
    return rows.select(
        *responses.columns,
        F.when(ok, F.coalesce("_j.is_crypto_usage", F.lit(True))).otherwise(~dismissed).alias("is_crypto_usage"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_c"))).otherwise(FALLBACK_CONFIDENCE).alias("confidence"),
        F.when(ok, F.coalesce("_j.label", F.lit("uncertain")))
        .when(dismissed, "false_positive").otherwise("uncertain").alias("label"),
        F.when(ok, F.left(F.coalesce("_j.explanation", F.lit("")), F.lit(EXPLANATION_CHARS)))
        .otherwise(F.trim(F.left(F.col(column), F.lit(FALLBACK_CHARS)))).alias("explanation"))
