"""Plain-text documents as paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One paragraph for each line, numbered from 1; such texts have no styles and no headings."""
    lines = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "text"))
    idx = (F.col("at") + 1).cast("int")
    return lines.select(
        "doc_id",
        F.concat(F.lit("p"), idx).alias("p_id"),
        idx.alias("idx"),
        "text",
        F.lit("").alias("style_id"),
        F.lit("").alias("style_name"),
        F.lit(False).alias("is_heading"),
        F.lit(None).cast("int").alias("heading_level"),
    )
