"""Conversations as training texts with a loss mask, and back again.

Turns are collected in parts of bounded size and sorted, adjacent turns of one role become one
block, and blocks are joined to a text, all by Spark expressions.  A block opens with its role,
every turn in it ends with a mark:

    <|:user|>first text<|.|>second text<|.|><|:assistant|>answer<|.|>

All marks begin with `<|`.  Inside texts, `<`, any backslashes and `|` in a row get one more
backslash, which reading takes away, so no text can hold a mark and every text comes back.  In role
names, backslash, bar and `<` are written as a backslash and a digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfathom.llm.common import stage

TURN_END = "<|.|>"
ROLE_START, ROLE_END = "<|:", "|>"
ROLE_CODES = (("\\", "\\0"), ("|", "\\1"), ("<", "\\2"))
#: Turn numbers of a part, and the most rows of one; more rows than that are dealt by their order.
PART_TURNS, PART_ROWS = 256, 1024
KEY = ["conv_id", "block", "sub"]
BLOCKS = "array<struct<role: string, texts: array<string>>>"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_code(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_name(code: Column) -> Column:
    for plain, written in reversed(ROLE_CODES):
        code = F.replace(code, F.lit(written), F.lit(plain))
    return code


def _parts(turns: DataFrame) -> DataFrame:
    """The turns with the part that each belongs to: (conv_id, block, sub), in the order of the turns.

    A part is 256 turn numbers of a conversation.  Where these have more than 1,024 rows (turns
    without numbers, or one number many times) their sorted order cuts them into further parts.
    """
    keyed = turns.withColumn("block", F.floor(F.col("turn") / PART_TURNS))
    crowded = stage(keyed.groupBy("conv_id", "block").count().where(f"count > {PART_ROWS}")
                    .select(F.col("conv_id").alias("c"), F.col("block").alias("b")), "chat-crowded")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    order = ["conv_id", "block", "turn", "role", "text"]
    placed = stage(keyed.join(crowded, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("sub", F.monotonically_increasing_id()), "chat-sorted")
    return keyed.join(crowded, same, "left_anti").withColumn("sub", F.lit(0).cast("long")).unionByName(
        placed.withColumn("sub", 1 + F.floor(F.col("sub") / PART_ROWS)))


def _merged(turns: Column) -> Column:
    """The blocks of sorted turns: adjacent turns of one role are one block."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        joined = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        opened = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(last["role"] == turn["role"], F.array_append(F.slice(blocks, 1, F.size(blocks) - 1), joined)
                      ).otherwise(F.array_append(blocks, opened))

    return F.aggregate(turns, F.array().cast(BLOCKS), add)


def _written(blocks: Column, before: Column, learned: Column) -> Column:
    """Pieces of the text in order: what opens a turn, the turn, and whether it is learned."""

    def pieces(block: Column, i: Column) -> Column:
        goes_on = (i == 0) & block["role"].eqNullSafe(before)
        mark = F.concat(F.lit(ROLE_START), _role_code(block["role"]), F.lit(ROLE_END))
        return F.transform(block["texts"], lambda text, k: F.struct(
            F.when((k > 0) | goes_on, "").otherwise(mark).alias("mark"), _escaped(text).alias("text"),
            F.array_contains(learned, block["role"]).alias("learned")))

    return F.flatten(F.transform(blocks, pieces))


def _spans(pieces: Column) -> Column:
    """(start, length) of the learned texts, in characters of the formatted text."""

    def add(found: Column, piece: Column) -> Column:
        start = found["at"] + F.length(piece["mark"])
        length = F.length(piece["text"])
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct((start + length + len(TURN_END)).alias("at"),
                        F.when(piece["learned"], F.array_append(found["spans"], span)).otherwise(found["spans"])
                        .alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    return F.aggregate(pieces, start, add, lambda found: found["spans"])


def format_turns(turns: DataFrame, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, block, sub, formatted, loss) of all conversations; turns: (conv_id, turn, role, text).

    Most conversations have one row; the rows of a longer one, sorted by (block, sub), are pieces
    of one text, cut between two turns.  `loss` holds (start, length) of each text of a learned
    role, in characters of its row.  Turns stand in order of turn, role and text, nulls first, so
    ties and repeated rows have a place and all stay.  Null roles and texts are empty ones; rows
    without a conv_id are one conversation; an empty table gives no rows; other columns go.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = _parts(turns).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block"), "sub")
    blocks = parts.withColumn("before", F.lag(F.try_element_at("turns", F.lit(-1))["role"]).over(in_order)).withColumn(
        "blocks", _merged(F.col("turns")))
    pieces = blocks.withColumn("pieces", _written(F.col("blocks"), F.col("before"), F.lit(list(learned))))
    return pieces.select(
        *KEY, F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"], F.lit(TURN_END))), "")
        .alias("formatted"), _spans(F.col("pieces")).alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, block, sub, turns, learned, n_chars): what format_turns has written.

    `turns` are structs (role, text) in order, with a null role where a turn goes on with the role
    before it; `learned` are the texts under the loss mask.
    """
    def turn(piece: Column) -> Column:
        opens = F.startswith(piece, F.lit(ROLE_START))
        code = F.substring_index(F.substring(piece, F.lit(len(ROLE_START) + 1), F.length(piece)), ROLE_END, 1)
        body = F.substring(piece, F.length(code) + len(ROLE_START + ROLE_END) + 1, F.length(piece))
        return F.struct(F.when(opens, _role_name(code)).alias("role"),
                        _plain(F.when(opens, body).otherwise(piece)).alias("text"))

    pieces = F.split("formatted", r"<\|\.\|>", -1)
    return formatted.select(
        *KEY, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"),
        F.transform("loss", lambda s: _plain(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learned"),
        F.length("formatted").alias("n_chars"))


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of its turns and of its learned texts.

    Parts of a conversation go by in order and one is held at a time, whatever its length.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def row() -> tuple:
            conv, n, turns, _, chars, loss, total = held
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            for conv, turns, learned, chars in zip(*(batch.column(c) for c in ("conv_id", "turns", "learned", "n_chars")),
                                                   strict=True):
                conv = conv.as_py()
                if held is None or held[0] != conv:
                    if held is not None:
                        rows.append(row())
                    held = [conv, 0, hashlib.sha256(), "", 0, hashlib.sha256(), 0]
                for turn in turns.as_py():
                    held[3] = held[3] if turn["role"] is None else turn["role"]
                    held[2].update(f"{held[3]}\n{turn['text']}\n".encode())
                    held[1] += 1
                for text in learned.as_py():
                    held[4] += len(text)
                    held[5].update(text.encode())
                held[6] += chars.as_py()
            yield _digest_rows(rows)
            rows = []
        if held is not None:
            yield _digest_rows([row()])

    order = ["conv_id", F.asc_nulls_first("block"), "sub"]
    return read.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(stream, DIGESTS)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int64() for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
