"""The corpus pipeline: each stage takes the documents that its predecessor kept.

(name, function) stages; run() applies them to the table of documents.  Every stage writes its
result to the shared folder and the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.llm import line_dedup, ngram_join, packing, quality, toxicity
from keyfathom.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEQUENCE = 2048


def _without(docs: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """The rows of docs whose doc_id is not among the rejected ones, which are few; rows without an id stay."""
    ids = stage(rejected.where("doc_id IS NOT NULL").select("doc_id").distinct(), label)
    return docs.join(ids, "doc_id", "left_anti").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    found = toxicity.score_toxicity(docs, table(spark, folder, "labels"))
    return _without(docs, found.where("predicted = 1"), "toxic-ids")


def drop_outliers(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _without(docs, quality.judged(docs).where("NOT kept"), "quality-ids")


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the lines that an earlier one has."""
    kept = line_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    found = ngram_join.near_documents(docs)
    return _without(docs, found.where("doc_id <> component_id"), "copy-ids")


def pack_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_outliers), ("line dedup", dedup_lines),
          ("n-gram Jaccard join", drop_near_copies), ("packing", pack_tokens)]

#: Learned scores, estimates and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, folder), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
