"""Token counts from flat token files that have no index: a scan for separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfathom.llm.common import release
from keyfathom.llm.tokens import SpacedWords, shared

#: Ids of a block of a flat file; documents run over its ends as they fall.
BLOCK_IDS = 1 << 16
#: Blocks of a row group.  Spark's reader takes up to 4,096 rows of a row group at once, 1 GB of blocks, whatever the task.
GROUP_BLOCKS = 16


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes all ids, the end id after each document, as blocks of BLOCK_IDS ids.

    One flat file per task: (shard, block, ids), no offsets.  The documents' ids go to the
    same rows' `doc_ids`, those whose text begins in the block, in the order of the file.
    Null texts are empty documents.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(SpacedWords, tokenizer)
        shard, block = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        held, docs_held = bytearray(), []

        def row(ids: bytes, begun: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.binary()),
                 pa.array([begun], pa.list_(pa.int64()))], names=["shard", "block", "ids", "doc_ids"])

        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                docs_held.append(doc.as_py())
                held += encoder.encode(text.as_py() or "") + end
                while len(held) >= 4 * BLOCK_IDS:
                    yield row(bytes(held[:4 * BLOCK_IDS]), docs_held)
                    block, docs_held = block + 1, []
                    del held[:4 * BLOCK_IDS]
        if held or docs_held:
            yield row(bytes(held), docs_held)

    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .mapInArrow(blocks, "shard int, block int, ids binary, doc_ids array<long>")
     .write.option("compression", "zstd").option("parquet.block.row.count.limit", str(GROUP_BLOCKS)).parquet(path))


def scan_flat(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """(shard, ordinal, start, n_tokens) of each document, by its separators alone.

    Every block is searched on its own, by one vector comparison.  What reaches over its ends
    is stitched by a prefix scan over the blocks of a file: ids before, separators before, and
    the last separator before.  Scanned rows are numbers, one row per block.  A file's
    end closes its last document even if the separator is missing.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids = [np.frombuffer(raw.as_py(), "<u4") for raw in batch.column(2)]
            found = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], names=["shard", "block", "n", "seps"])

    blocks = (spark.read.schema("shard int, block int, ids binary").parquet(path)
              .mapInArrow(search, "shard int, block int, n long, seps array<long>"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "seps_before", F.coalesce(F.sum(F.size("seps")).over(earlier), F.lit(0))).withColumn(
        "seps", F.transform("seps", lambda s: s + F.col("first"))).withColumn(
        "last_before", F.coalesce(F.max(F.try_element_at("seps", F.lit(-1))).over(earlier), F.lit(-1))).withColumn(
        "is_last", F.lead("block").over(Window.partitionBy("shard").orderBy("block")).isNull())
    end = F.col("first") + F.col("n") - 1
    open_end = F.col("is_last") & (end > F.coalesce(F.try_element_at("seps", F.lit(-1)), F.col("last_before")))
    ends = placed.withColumn("seps", F.when(open_end, F.concat("seps", F.array(end))).otherwise(F.col("seps")))
    rows = ends.select("shard", "seps_before", "seps", "last_before", F.posexplode("seps").alias("k", "sep"))
    previous = F.when(F.col("k") == 0, F.col("last_before")).otherwise(F.get("seps", F.col("k") - 1))
    return rows.select("shard", (F.col("seps_before") + F.col("k")).alias("ordinal"),
                       (previous + 1).alias("start"), (F.col("sep") - previous).alias("n_tokens"))


def document_counts(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """(doc_id, shard, ordinal, start, n_tokens): scanned counts with the names of the documents."""
    names = spark.read.schema("shard int, block int, doc_ids array<long>").parquet(path)
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = names.withColumn("docs_before", F.coalesce(F.sum(F.size("doc_ids")).over(earlier), F.lit(0))).select(
        "shard", "docs_before", F.posexplode("doc_ids").alias("k", "doc_id")).select(
        "shard", (F.col("docs_before") + F.col("k")).alias("ordinal"), "doc_id")
    return scan_flat(spark, path, end_id).join(named, ["shard", "ordinal"]).select(
        "doc_id", "shard", "ordinal", "start", "n_tokens")
