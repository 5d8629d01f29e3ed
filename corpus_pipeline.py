"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of ``documents``.

In every stage a null text counts as empty, very long texts are read whole, rows that repeat
a doc_id each count, an empty table gives an empty one, and columns beside those of
``documents`` are left out, whatever their names. What holds beyond that stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, jaccard, line_dedup, nbest, quality
from marginalia.llm.common import released, stored, table, written
from marginalia.llm.queries import PIECE_BPE

#: Parts of words that a worker of the last stage keeps: it also runs the other stages of the next corpus.
CACHE_SIZE = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose posterior is below a half.

    A null source or lang is a site of its own; texts without words are judged by their
    site and the features zero. Without labels of both kinds the site's rate decides.
    """
    scored = quality.quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), keep=COLUMNS[1:])
    return scored.where("kept").select(*COLUMNS)


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose the lines that ten documents or more have; n_chars follows.

    A document all of whose lines go stays, with an empty text, as one that was empty does.
    """
    cut = line_dedup.line_dedup(docs, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays.

    Documents without words are similar to nothing and stay. Of rows with one id and text
    all stay, as do groups in which no row has an id.
    """
    return jaccard.one_of_each(docs).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with a tenth of its length as edits, go; empty ones hold none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its best segmentation, the scores of the N best, and whether decoding gives the text again.

    Of segmentations with equal scores the same ones come first each time; an empty text has the piece of a single space.
    """
    return nbest.encoded(docs, PIECE_BPE, cache_size=CACHE_SIZE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", frequent_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", sentencepiece),
]

#: No SQL: the classifier is trained, and segmentation is a search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written for itself goes when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(written)
        docs = stored(stage(spark, docs, sf_dir), name)
        of_stage, written[before:] = written[before:], written[-1:]
        released(spark, of_stage[:-1])
        if name != STAGES[0][0]:
            released(spark, [written.pop(before - 1)])
    return docs
