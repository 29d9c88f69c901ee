"""SentencePiece ids of a table of texts, and the texts back from the ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.pieces import Pieces
from keyfathom.llm.tokens import shared


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's ids, without begin and end.  Null texts are empty and have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(Pieces, model)
        for batch in batches:
            ids = [pieces.encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode_texts(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(Pieces, model)
        for batch in batches:
            texts = [pieces.decode(ids.values.to_numpy().tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; ids and texts stay in the task.

    Null and empty texts have no ids; null ids are carried along; repeated rows are coded row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(Pieces, model)
        digits = [str(i) for i in range(len(pieces.bytes_of))]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = pieces.encode(text.as_py() or "").tolist()
                listed = ",".join(map(digits.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
