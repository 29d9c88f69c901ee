"""Picking rows per group without pulling a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of every group.

    Spark turns ``row_number() <= n`` into a group limit that already cuts each
    map task's rows before the shuffle, so a hot key costs one row per task.
    """
    return limit_per(rows, keys, 1, *order)


def limit_per(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of every group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (rows.withColumn("_row", F.row_number().over(window))
            .where(F.col("_row") <= n).drop("_row"))


def newest_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Like :func:`first_per` but ties for first place are all kept."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (rows.withColumn("_rank", F.rank().over(window))
            .where(F.col("_rank") <= 1).drop("_rank"))


#: Rows of a table that is sent to every task, at most.
BROADCAST_ROWS = 200_000
SALTS = 32


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by these columns into all partitions of an exchange of this session, before work that multiplies them.

    A number that is stated is one that adaptive execution does not make smaller, as it does for rows that are still few.
    """
    return rows.repartition(partitions(rows.sparkSession), *columns)


def partitions(spark: SparkSession) -> int:
    """Partitions that an exchange of this session has before any are coalesced."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def join_each(rows: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", most: int | None = None,
              deal: bool = False) -> DataFrame:
    """Each row with what a smaller table says about its key, however often a key occurs among the rows.

    ``small`` is cheap to read; what it says may be several rows.  It is counted first: few rows are broadcast,
    so that the rows stay where they are.  More are copied once per salt, and the rows dealt by key
    and salt, so that a hot key is spread over that many tasks.  With ``deal``, which takes keys of the same types on
    both sides, these tasks are not made fewer for few rows, which the join may make many.
    """
    most = BROADCAST_ROWS if most is None else most
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    keys = [key] if isinstance(key, str) else key
    if deal:  # by one number: of several columns the join may find one constant, and would deal again without it
        lot = F.xxhash64(*keys, "_salt")
        salted, copies = (spread(t.withColumn("_salt", lot), "_salt") for t in (salted, copies))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
