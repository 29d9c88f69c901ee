"""What several operators share: tables, staged results, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.session import checkpoint_dir, small_batches


_SHIPPED: set[str] = set()
_KEPT: dict[tuple, object] = {}


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing, which goes when another operator comes (release)."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Lets go of what an earlier operator kept in this worker; for tasks that keep nothing themselves."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that tasks can import it.

    Also makes the session's batches for Python workers small, unless it has its own size.
    """
    small_batches(spark)
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and keeps what is read more than once
    from being computed again.  The folder is the one in spark.checkpoint.dir; what is
    below it belongs to the job and goes with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, root) of every end of an edge (a, b): the smallest id reachable by edges.

    Large stars and small stars in turn until nothing changes.  Both are a minimum per
    vertex, combined before the shuffle, and an equi-join whose hot vertices adaptive
    execution may split.  Equal ends and repeated edges do no harm; no edges, no rows.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), f"{label}-edges")
    seen = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        current = stage(small, f"{label}-stars")
        now = _mark(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
