"""Lines that occur in several documents stay in the first one only.

Hashes of lines are range-partitioned and sorted by (hash, document); a stream over each
range sees the first document of a line before all others.  The range includes the document,
so a line that a third of all documents hold is spread over many tasks; what a task cannot
know, whether an earlier range already held its first line, is one row per task and settled
by a join of those rows.  The result is a bitmap per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import release, stage

BLANK = " \t\n\r\x0b\x0c"
LINE = "h1 long, h2 long, doc_id long, text_hash long, n_lines int, places binary"
FOUND = f"kind int, part int, {LINE}"
DROP, LEAD, TAIL = 0, 1, 2


def line_keys(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document and different key: its 128-bit hash and the places of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            hashes, rows = bytearray(), []
            for doc, text_hash, text in zip(*batch.columns, strict=True):
                lines = text.as_py().split("\n")
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = line.strip(BLANK)
                    if len(key) >= least:
                        places.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
                for key, at in places.items():
                    hashes += key
                    rows.append((doc.as_py(), text_hash.as_py(), len(lines), np.array(at, "<u4").tobytes()))
            pairs = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
                names=["h1", "h2", "doc_id", "text_hash", "n_lines", "places"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return kept.mapInArrow(run, LINE)


def repeats(lines: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_lines, places) of all lines whose key has an earlier document."""
    lines = stage(lines, "lines")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part = TaskContext.get().partitionId()
        held = None  # (h1, h2) of the run the last batch ended in, and its first document
        first, leading = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (np.asarray(batch.column(i)) for i in range(3))
            begins = np.r_[held != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            run = np.cumsum(begins)  # 0: goes on from the batch before
            firsts = np.r_[first, doc[begins]]
            kind = np.where(doc > firsts[run], DROP, -1)
            in_lead = (run == 0) & leading if held is not None else run == 1
            kind[in_lead & (kind < 0)] = LEAD
            leading = bool(in_lead[-1])
            held, first = (h1[-1], h2[-1]), int(firsts[run[-1]])
            keep = np.flatnonzero(kind >= 0)
            if len(keep):
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind[keep], pa.int32()), pa.array(np.full(len(keep), part), pa.int32()), *rows.columns],
                    names=["kind", "part", *rows.schema.names])
        if held is not None:
            values = (TAIL, part, int(held[0]), int(held[1]), first, None, None, None)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                             names=["kind", "part", *LINE.replace(",", "").split()[::2]])

    found = stage(lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id")
                  .mapInArrow(stream, FOUND), "line-repeats")
    tails = found.where(f"kind = {TAIL}").select("h1", "h2", F.col("part").alias("tail_part"),
                                                 F.col("doc_id").alias("tail_doc"))
    leads = found.where(f"kind = {LEAD}").join(tails, ["h1", "h2"], "left_semi").alias("l").join(
        tails.alias("t"), (F.col("l.h1") == F.col("t.h1")) & (F.col("l.h2") == F.col("t.h2"))
        & (F.col("t.tail_part") < F.col("l.part")) & (F.col("t.tail_doc") < F.col("l.doc_id")), "left_semi")
    columns = ["doc_id", "text_hash", "n_lines", "places"]
    return found.where(f"kind = {DROP}").select(columns).unionByName(leads.select(columns))


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep): a zlib-packed bitmap of the lines that stay.

    A key is a line without the white space at its ends, A-Z in lower case; shorter keys than
    `least` characters always stay.  Documents that keep every line have no row, nor have null
    ids and null texts.  Rows of one doc_id are one document; text_hash tells unequal ones apart.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            dropped, maps = [], []
            for n, places in zip(batch.column(2), batch.column(3), strict=True):
                keep = np.ones(n.as_py(), bool)
                keep[np.frombuffer(b"".join(set(places.as_py())), "<u4")] = False
                dropped.append(int(len(keep) - keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
                names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    found = repeats(line_keys(docs, least, id_col, text_col)).groupBy("doc_id", "text_hash", "n_lines").agg(
        F.collect_set("places").alias("places"))
    return found.mapInArrow(pack, "doc_id long, text_hash long, n_lines int, n_dropped int, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), "u1"))[:len(lines)]
    stay = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a bitmap column `line_keep`, null where every line stays."""
    maps = bitmaps.select(F.col("doc_id").alias("line_doc"), F.col("text_hash").alias("line_hash"),
                          F.col("keep").alias("line_keep"))
    on = (F.col(id_col).cast("long") == F.col("line_doc")) & (F.xxhash64(text_col) == F.col("line_hash"))
    return docs.join(maps, on, "left").drop("line_doc", "line_hash")


def without_repeats(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, their text without the lines that an earlier document has."""

    def kept(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([kept_text(t, m)[0] for t, m in zip(texts, maps, strict=True)], dtype=object)

    marked = drop_lines(docs, keep_bitmaps(docs, least, id_col, text_col), id_col, text_col)
    text = F.when(F.col("line_keep").isNull(), F.col(text_col)).otherwise(
        F.pandas_udf(kept, "string")(text_col, "line_keep"))
    return marked.withColumn(text_col, text).drop("line_keep")


def line_digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for text, keep in zip(batch.column(1), batch.column(2), strict=True):
                kept, n, dropped = kept_text(text.as_py(), keep.as_py())
                rows.append((n, dropped, hashlib.sha256(kept.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return drop_lines(docs, keep_bitmaps(docs, least)).select("doc_id", "text", "line_keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
