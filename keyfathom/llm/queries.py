"""The registered queries of this folder and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyfathom.llm import (
    chat_format, line_dedup, main_text, ngram_join, oracles, packing, pivots, quality, spellings, token_files, token_scan,
    toxicity, word_runs)
from keyfathom.llm.common import stage, table
from keyfathom.llm.piece_codec import piece_digests
from keyfathom.session import checkpoint_dir


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)
    return packing.pack(pieces, 2048)


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, folder, "documents"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(table(spark, folder, "pages"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/flat-tokens-{uuid.uuid4().hex}"
    token_scan.write_flat(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256, path)
    return token_scan.document_counts(spark, path, 50256)


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(table(spark, folder, "embeddings"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: A conversation of the contract: both turns are full of control strings.
CONTROLS = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    controls = spark.sql("SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') "
                         "AS t(turn, role)", args={"text": CONTROLS})
    written = stage(chat_format.format_turns(given.unionByName(controls)), "chat-texts")
    return chat_format.conversation_digests(chat_format.read_turns(written))


def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return word_runs.document_runs(table(spark, folder, "documents"), word_runs.planted)


def op13_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.spelling_groups(table(spark, folder, "documents"), spellings.shortened)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_packing, op3_ngram_jaccard, op4_token_files, op5_main_text, op6_token_counts, op7_near_vectors,
    op8_line_dedup, op9_quality, op10_pieces, op11_chat_format, op12_word_runs, op13_spellings)}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT k.*, coalesce(first_id < doc_id, false) AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_ngram_jaccard": oracles.NEAR_DOCUMENTS,
    "op7_near_vectors": oracles.NEAR_VECTORS,
    "op11_chat_format": oracles.CONVERSATIONS,
    "op12_word_runs": oracles.RUNS,
    "op13_spellings": oracles.SPELLINGS,
}
