"""Which remediation playbook applies to a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.session import small_table

COLUMNS = ["playbook_key", "algorithm", "severity", "migration_effort", "nist_replacement", "languages"]


def playbooks(spark: SparkSession) -> DataFrame:
    return small_table(spark, grades.PLAYBOOKS, COLUMNS)


def key_of(algorithm: Column) -> Column:
    return F.replace(F.replace(F.upper(algorithm), F.lit("%20"), F.lit("-")), F.lit(" "), F.lit("-"))


def attach(rows: DataFrame) -> DataFrame:
    """Severity, effort, replacement and languages of each row's playbook, null for none."""
    dim = playbooks(rows.sparkSession).select(
        "playbook_key", F.col("severity").alias("playbook_severity"), "migration_effort",
        F.col("nist_replacement").alias("playbook_replacement"), F.col("languages").alias("playbook_languages"))
    return (rows.withColumn("playbook_key", key_of(F.col("algorithm")))
            .join(F.broadcast(dim), "playbook_key", "left").drop("playbook_key"))


def for_language(rows: DataFrame, language: str) -> DataFrame:
    """Rows whose playbook covers a language."""
    return attach(rows).where(F.array_contains("playbook_languages", language.lower()))
