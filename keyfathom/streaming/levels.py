"""Runtime findings kept by a stream in levels, so that no compaction reads all that came before.

Every micro-batch is a run of level 0.  With a fan-out of k, k runs of a level that follow each other
are folded into one run of the next level as soon as they are there, so a row is rewritten once per
level: log_k of the number of batches.  Which runs exist after a batch follows from its number alone
(the digits of that number, base k); a manifest per batch names them.  A batch that is run again
writes the same runs from the same runs.

    <path>/level=L/last=N    findings of the k ** L batches that end with batch N
    <path>/manifest/batch_id=N    (level, first, last) of the runs that make up the state after batch N
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfathom.operators import runtime

Run = tuple[int, int, int]  # level, first batch, last batch
_COLUMNS = [*runtime.KEY, "library", "occurrences", "first_seen", "last_seen"]


def runs_after(batch_id: int, fanout: int) -> list[Run]:
    """The runs of the state after a batch, oldest first."""
    runs, begin, left = [], 0, batch_id + 1
    level = 0
    while fanout ** (level + 1) <= left:
        level += 1
    for step in range(level, -1, -1):
        size = fanout ** step
        for _ in range(left // size):
            runs.append((step, begin, begin + size - 1))
            begin += size
        left %= size
    return runs


def merges_after(batch_id: int, fanout: int) -> list[tuple[Run, list[Run]]]:
    """What a batch makes due: (new run, the runs folded into it), lowest level first."""
    due, level = [], 1
    while (batch_id + 1) % fanout ** level == 0:
        size, first = fanout ** (level - 1), batch_id + 1 - fanout ** level
        due.append(((level, first, batch_id),
                    [(level - 1, first + i * size, first + (i + 1) * size - 1) for i in range(fanout)]))
        level += 1
    return due


def _folder(path: str, run: Run) -> str:
    return f"{path}/level={run[0]}/last={run[2]}"


def read_runs(spark: SparkSession, path: str, runs: list[Run]) -> DataFrame:
    """The rows of runs; seq, the last batch of its run, is the order of arrival."""
    rows = spark.read.option("basePath", path).parquet(*[_folder(path, r) for r in runs])
    return rows.select(*_COLUMNS, F.col("last").cast("long").alias("seq"))


def _folded(rows: DataFrame) -> DataFrame:
    return runtime.upsert(rows.select(*_COLUMNS).limit(0), rows)


def add_batch(batch: DataFrame, batch_id: int, path: str, fanout: int) -> None:
    """Write one batch, the merges it makes due and the manifest; doing it again changes nothing."""
    spark = batch.sparkSession
    _folded(batch).write.mode("overwrite").parquet(_folder(path, (0, batch_id, batch_id)))
    for run, parts in merges_after(batch_id, fanout):
        _folded(read_runs(spark, path, parts)).write.mode("overwrite").parquet(_folder(path, run))
    manifest = spark.createDataFrame(runs_after(batch_id, fanout), "level int, first long, last long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch_id={batch_id}")


def upsert_stream(incoming: DataFrame, path: str, checkpoint: str, fanout: int = 8,
                  trigger: dict | None = None) -> StreamingQuery:
    """Keep runtime findings up to date from a stream of reported findings (see the module's text)."""
    return (incoming.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path, fanout))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def current_runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs of the newest manifest: fan-out times the number of levels at most."""
    manifest = spark.read.parquet(f"{path}/manifest")
    newest = manifest.groupBy("batch_id").agg(F.collect_list(F.struct("level", "first", "last")).alias("runs"))
    rows = newest.orderBy(F.col("batch_id").cast("long").desc()).limit(1).collect()
    return sorted((tuple(r) for row in rows for r in row["runs"]), key=lambda r: r[1])


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """The state after the newest batch, with registry grades."""
    return runtime.with_registry(_folded(read_runs(spark, path, current_runs(spark, path))))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete runs and manifests that the newest manifest does not need; returns how many folders went.

    For times when nobody reads an older state and no batch is being written.
    """
    kept = {_folder(path, r) for r in current_runs(spark, path)}
    newest = max(int(r["batch_id"]) for r in spark.read.parquet(f"{path}/manifest").agg(
        F.max(F.col("batch_id").cast("long")).alias("batch_id")).collect())
    kept.add(f"{path}/manifest/batch_id={newest}")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {k.rsplit(path.rstrip("/").rsplit("/", 1)[-1], 1)[-1] for k in kept}
    gone = 0
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/*=*")):
        place = status.getPath().toString()
        if not any(place.endswith(n) for n in names):
            files.delete(status.getPath(), True)
            gone += 1
    return gone
