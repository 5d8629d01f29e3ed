"""Headings, sections, reference lists and counts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import SPACE

# Patterns of headings and of the lines around reference lists.
_S = f"[{SPACE}]"
_NUMBER = rf"(?:第{_S}*[0-9０-９一二三四五六七八九十]{{1,3}}{_S}*[章節]|[0-9０-９]{{1,2}}|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅰⅱⅲⅳⅴⅵⅶⅷⅸⅹ]+)?{_S}*[．.，,、:：]?{_S}*"
REFERENCE_HEADING = rf"(?i)^{_S}*{_NUMBER}(?:参考・引用文献|参考文献|引用文献|文献一覧|参考資料|references|bibliography){_S}*(?:一覧)?{_S}*\z"
REFERENCE_END = rf"(?i)^{_S}*{_NUMBER}(?:付録|補遺|謝辞|あとがき|索引|用語集|appendix|acknowledg(?:e)?ments?){_S}*\z"
NAMED_APPENDIX = rf"(?iu)^{_S}*(?:付録|補遺|appendix){_S}*[A-ZＡ-Ｚ0-9０-９一二三四五六七八九十]?{_S}*(?:[.．:：\-－]{_S}*)?(?:[^{SPACE}].{{0,48}})?\z"
CITED = r"(?i)(?:19|20)[0-9]{2}|https?:|(?<![A-Za-z0-9_])?doi(?![A-Za-z0-9_])"
BODY = "本文"


def is_title_style(style: Column) -> Column:
    return F.trim(style).rlike(r"(?i)^(title|タイトル)\z")


def with_headings(paragraphs: DataFrame) -> DataFrame:
    """Adds is_heading and heading_level to paragraphs that have style_id, style_name and outline."""
    style = F.concat_ws(" ", "style_id", "style_name")
    title = is_title_style(F.col("style_id")) | is_title_style(F.col("style_name"))
    outlined = F.coalesce(F.col("outline").between(0, 8), F.lit(False))
    heading = ~title & (style.rlike("(?i)heading|見出し") | outlined)
    digit = F.regexp_extract(style, rf"(?i)(?:heading|見出し){_S}*([1-9])", 1)
    level = F.when(digit != "", digit.cast("int")).when(outlined, F.col("outline") + 1).otherwise(1)
    return paragraphs.select("doc_id", "p_id", "idx", "text", "style_id", "style_name", heading.alias("is_heading"), F.when(heading, level).cast("int").alias("heading_level"))


def is_reference_heading(text: Column) -> Column:
    return text.rlike(REFERENCE_HEADING)


def is_reference_end(text: Column, is_heading: Column) -> Column:
    return text.rlike(REFERENCE_END) | (text.rlike(NAMED_APPENDIX) & (is_heading | ~text.rlike(CITED)))


def with_parts(paragraphs: DataFrame) -> DataFrame:
    """Adds ``part``: body, heading (the line that opens the reference list) or reference."""
    whole = Window.partitionBy("doc_id")
    start = F.min(F.when(is_reference_heading(F.col("text")), F.col("idx"))).over(whole)
    marked = paragraphs.withColumn("_start", start)
    end = F.min(F.when(F.col("idx") > F.col("_start"), F.when(is_reference_end(F.col("text"), F.col("is_heading")), F.col("idx")))).over(whole)  # only lines after the start are matched
    marked = marked.withColumn("_end", end)
    inside = (F.col("idx") > F.col("_start")) & (F.col("_end").isNull() | (F.col("idx") < F.col("_end")))
    part = F.when(F.col("idx") == F.col("_start"), "heading").when(inside, "reference").otherwise("body")
    return marked.withColumn("part", part).drop("_start", "_end")


def references(parts: DataFrame) -> DataFrame:
    """doc_id, ref_id, p_id, text: the lines of reference lists that aren't empty."""
    lines = parts.where((F.col("part") == "reference") & (F.trim("text") != ""))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return lines.select("doc_id", F.concat(F.lit("ref"), number).alias("ref_id"), "p_id", "text")


def with_sections(paragraphs: DataFrame) -> DataFrame:
    """Adds section_no (from 1) and heading; a heading with text opens a section, what comes before is 本文."""
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("is_heading") & (F.col("text") != "")
    return (
        paragraphs.withColumn("section_no", (F.sum(opens.cast("int")).over(order) + 1).cast("int"))
        .withColumn("heading", F.coalesce(F.last(F.when(opens, F.col("text")), ignorenulls=True).over(order), F.lit(BODY)))
        .withColumn("section_level", F.coalesce(F.last(F.when(opens, F.coalesce("heading_level", F.lit(1))), ignorenulls=True).over(order), F.lit(0)))
    )


def sections(paragraphs: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, level, n_paragraphs; empty paragraphs don't count, an empty first section goes."""
    found = with_sections(paragraphs).where((F.col("text") != "") | F.col("is_heading"))
    body = ~F.col("is_heading") & (F.col("text") != "")
    grouped = found.groupBy("doc_id", "section_no", "heading", F.col("section_level").alias("level")).agg(F.count_if(body).alias("n_paragraphs"))
    return grouped.where((F.col("level") > 0) | (F.col("n_paragraphs") > 0))


def document_stats(paragraphs: DataFrame) -> DataFrame:
    """characters, paragraphs and headings that aren't empty."""
    filled = F.col("text") != ""
    return paragraphs.groupBy("doc_id").agg(
        F.sum(F.length("text")).alias("characters"),
        F.count_if(filled).alias("paragraphs"),
        F.count_if(filled & F.col("is_heading")).alias("headings"),
    )


def full_texts(paragraphs: DataFrame) -> DataFrame:
    """doc_id, full_text: paragraphs in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("full_text"))
