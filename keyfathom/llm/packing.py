"""Packing of token sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import release, stage
from keyfathom.llm.tokens import SpacelessWords, shared

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with the end id, cut into pieces of at most `length` ids.

    A null text is an empty one, which has the end id alone; a null id stays null;
    equal rows give equal pieces.  Texts leave the map stage as numbers only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(SpacelessWords, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start:4 * (start + length)]
                    out.append((doc.as_py(), start, len(piece) // 4, zlib.crc32(piece), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECE)


class Bins:
    """Bins of equal size; a tournament tree over their free room finds the first that fits."""

    def __init__(self, count: int, size: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def put(self, need: int) -> tuple[int, int]:
        """(bin, room it had): the leftmost bin with enough room, which then has less."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        had = room[at]
        found, room[at] = at - self.leaves, had - need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found, had


def first_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, placed longest first, ties in the order given."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    bins = Bins(len(lengths), size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found, had = bins.put(lengths[i])
        placed[i] = (found, size - had)
    return placed


def pack(pieces: DataFrame, length: int, group_size: int = 4096, seed: int = 11) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence is longer than `length`.

    Pieces are dealt at random to groups of about `group_size`, whatever their document,
    and every group is packed alone, so no task holds more than one group.  One number,
    the count of pieces, comes to the driver.  A larger group leaves less padding and
    costs memory; each group has about one sequence that is not full.  No pieces, no rows.
    """
    pieces = stage(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group_size))
    columns = [*pieces.columns, "sequence_id", "offset"]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        where = np.array(first_fit(frame["length"].tolist(), length), "int64").reshape(-1, 2)
        return frame.assign(sequence_id=frame["packing_group"] * (1 << 32) + where[:, 0], offset=where[:, 1])[columns]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return (pieces.withColumn("packing_group", F.floor(F.rand(seed) * groups).cast("long"))
            .groupBy("packing_group").applyInPandas(place, f"{kinds}, sequence_id long, offset long"))
