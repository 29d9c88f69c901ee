"""Session helpers: time zone, checkpoint folder and small fixed tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from keyfathom.functions.sqltext import literal


def local_session(cpus: int | str = 8, app: str = "keyfathom", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """All stored times are naive UTC, so the session has to read them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The session setting wins.  Only a local master, as in tests, may fall back
    to a fresh temporary folder: executors on other machines could not read it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    folder = tempfile.mkdtemp(prefix="run-keyfathom-")
    sc.setCheckpointDir(folder)
    return folder


#: Bytes of rows that a Python worker gets at once, where the session has Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Makes the session's batches for Python workers small, unless it has its own size."""
    if spark.conf.get(_BATCH).strip("bB") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def small_table(spark: SparkSession, rows: Iterable[Sequence[object]], columns: Sequence[str]) -> DataFrame:
    """A fixed dimension as an inline table, which Catalyst folds and broadcasts.

    Only for the built-in tables of ``keyfathom.dims`` (tens of rows).
    """
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
