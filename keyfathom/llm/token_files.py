"""Token files: frequency-ranked ids in bytes of variable number, with control bytes apart.

A block holds the ids of whole documents in the order of doc_id.  An id is written as its
rank by frequency in 1 to 4 bytes, little end first; the number of bytes less one stands in
two bits of a separate control string, so four ids share a control byte and all lengths of
a block are known from one table lookup.  Blocks are rows of Parquet files, which Spark
writes and commits on any store; `ranks` is a small table beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfathom.llm.common import release, stage
from keyfathom.llm.tokens import MarkedWords, shared

#: Ids in a block, apart from the last document's, which is never cut.
BLOCK_IDS = 1 << 16
#: Lengths of the four ids of each control byte.
LENGTHS = (np.arange(256, dtype="u1")[:, None] >> np.array([0, 2, 4, 6], "u1") & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    longer_than = [np.flatnonzero(ranks >= 1 << 8 * k) for k in (1, 2, 3)]
    more = np.zeros(len(ranks), "u1")
    for longer in longer_than:
        more[longer] += 1
    ends = np.cumsum(more + 1, dtype="int64")
    starts = ends - more - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, "u1")
    data[starts] = ranks
    for k, longer in enumerate(longer_than, 1):
        data[starts[longer] + k] = ranks[longer] >> np.uint32(8 * k)
    quads = np.zeros((len(ranks) + 3) // 4 * 4, "u1")
    quads[:len(ranks)] = more
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype("u1").tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: lengths by table, then a gather for each byte of the longest."""
    sizes = LENGTHS[np.frombuffer(control, "u1")].reshape(-1)[:count]
    starts = np.cumsum(sizes, dtype="int64") - sizes
    padded = np.frombuffer(data + b"\0\0\0", "u1")
    out = padded[starts].astype("u4")
    for k in range(1, int(sizes.max()) if count else 1):
        out |= (padded[starts + k] * (sizes > k)).astype("u4") << np.uint32(8 * k)
    return out


def document_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids with the end id, two bytes each where all fit, else four.

    Null texts are empty: the end id alone.  The width is one for the whole table.
    """
    wide = shared(MarkedWords, tokenizer).tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(MarkedWords, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "") + end
                out.append(ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, ids binary").withColumn("width", F.lit(4 if wide else 2))


def batch_counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """How often each id occurs in the rows (ids, width), for each width: one count for all documents."""
    widths = batch.column(1).to_numpy()
    for width in np.unique(widths).tolist():
        raw = b"".join(batch.column(0).filter(pa.array(widths == width)).to_pylist())
        yield np.bincount(np.frombuffer(raw, f"<u{width}"))


def rank_ids(ids: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id: at most one entry per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(0, "int64")
        for batch in batches:
            for found in batch_counts(batch):
                if len(found) > len(total):
                    total, found = found.astype("int64"), total
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         names=["id", "n"])

    counted = ids.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return found["id"].to_numpy("u4")


BLOCK = ("shard int, block int, first_id long, doc_ids array<long>, doc_lengths array<int>, n_ids int, "
         "shard_start long, control binary, data binary")


def write_blocks(ids: DataFrame, ranked: np.ndarray, path: str) -> None:
    """Writes the blocks in ascending doc_id order, one shard per range of ids.

    A shard is sorted and streamed by one task, so its size is that of a shuffle partition
    however skewed the texts are; equal doc_ids follow each other by their ids.  Null ids
    come first.
    """
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, "u4")
    rank_of[ranked] = np.arange(len(ranked), dtype="u4")
    names = [f.split()[0] for f in BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(),
             pa.int64(), pa.binary(), pa.binary()]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.concatenate(parts)])
            row = (shard, block, docs[0], docs, [len(p) for p in parts], held, start, control, data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, raw, width in zip(*batch.columns, strict=True):
                docs.append(doc.as_py())
                parts.append(np.frombuffer(raw.as_py(), f"<u{width.as_py()}"))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    block, start, docs, parts, held = block + 1, start + held, [], [], 0
        if docs:
            yield close()

    (ids.select("doc_id", "ids", "width").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(blocks, BLOCK).write.parquet(f"{path}/blocks"))
    ids.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ranked)], "rank int, id long").write.parquet(
        f"{path}/ranks")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    Blocks are decoded on their own.  The first id of a shard follows from the shards' totals:
    one row per shard, summed in the order of shards.
    """
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_first"))
    ranked = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths, n, start, control, data = (c[row].as_py() for c in batch.columns)
                ids = ranked[decode_ranks(control, data, n)]
                ends = np.cumsum(lengths)
                parts = [ids[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = blocks.join(totals, "shard").withColumn("first", F.col("shard_first") + F.col("shard_start"))
    return placed.select("doc_ids", "doc_lengths", "n_ids", "first", "control", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Tokenizes once, ranks the ids over all documents, writes the files.

    An empty table gives files without rows.  Columns other than id and text are not read.
    """
    ids = stage(document_ids(docs, tokenizer, end_id), "token-ids")
    write_blocks(ids, rank_ids(ids), path)
