"""Exact deduplication by a heavy-hitter split.

A frequent-items sketch (Misra and Gries, as Spark's ``freqItems`` keeps it) finds the
digests that may be frequent; an exact count over those few verifies them. The winners,
at most ``1 / support`` rows, are broadcast and settle their copies where these lie. Only
the other digests are shuffled, and none of them has more than ``support`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: A digest with more than this share of all rows is a heavy hitter.
SUPPORT = 0.001


def digest_of(text: str = "text"):
    """SHA-256 of the text in UTF-8, each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def heavy_hitters(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep_id, group_size of the digests that more than ``support`` of the rows have."""
    # freqItems tells byte arrays apart by identity, so it gets strings
    named = digests.select(F.hex("digest").alias("digest"))
    candidates = named.freqItems(["digest"], support).select(F.explode(F.col("digest_freqItems")).alias("name")).select(F.unhex("name").alias("digest"))
    heavy_rows = support * digests.count()
    # freqItems returns at most 1 / support digests, so both broadcasts have that bound
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > heavy_rows)
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    * A null text counts as empty; texts of white space alone equal a single space, not
      the empty text.
    * Of equal texts the smallest doc_id stays. Rows that repeat a doc_id with an equal
      text count as one document with that id: all of them carry the same ``kept``, and
      each counts in ``group_size``.
    * A null doc_id loses against any other; in a group of null ids alone they stay.
    * An empty table gives an empty result. Other columns are not read.
    """
    digests = stored(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(digest_of(text)).alias("digest")), "digests")
    winners = stored(heavy_hitters(digests, support), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest",
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, doc_id, text, support).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    match = docs[doc_id].eqNullSafe(kept["_kept_id"]) & (digest_of(text) == kept["_kept_sha"])
    return docs.join(kept, match, "left_semi")
