"""Bibliographic records of two providers as one table of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import distinct_texts, entities_decoded

CROSSREF = (
    "DOI string, title array<string>, subtitle array<string>, author array<struct<family:string,given:string>>, `container-title` array<string>, URL string, "
    + ", ".join(f"`{x}` struct<`date-parts`:array<array<int>>>" for x in ("published-print", "published", "issued", "published-online"))
)


def crossref_candidates(works: DataFrame, json: str = "json") -> DataFrame:
    """One candidate for each work: title with subtitle, authors, years of print, publication, issue and online."""
    w = works.withColumn("w", F.from_json(json, CROSSREF))
    title, subtitle = F.get("w.title", F.lit(0)), F.get("w.subtitle", F.lit(0))
    whole = F.when(F.coalesce(subtitle, F.lit("")) != "", F.concat_ws(": ", title, subtitle)).otherwise(title)
    authors = F.array_join(F.transform("w.author", lambda a: F.trim(F.concat_ws(" ", a["family"], a["given"]))), ", ")
    years = F.array(*(F.get(F.get(F.col(f"w.`{x}`.`date-parts`"), F.lit(0)), F.lit(0)).cast("string") for x in ("published-print", "published", "issued", "published-online")))
    return w.select(
        *works.columns,
        F.lit("Crossref").alias("provider"),
        F.col("w.DOI").alias("doi"),
        entities_decoded(whole).alias("title"),
        entities_decoded(authors).alias("authors"),
        entities_decoded(F.get("w.container-title", F.lit(0))).alias("journal"),
        F.get(distinct_texts(years), F.lit(0)).alias("year"),
        distinct_texts(years).alias("year_candidates"),
        F.coalesce("w.URL", F.concat(F.lit("https://doi.org/"), F.col("w.DOI"))).alias("url"),
    )


def _texts(value: Column) -> Column:
    """Strings of a JSON value that may be one or a list."""
    many = F.try_variant_get(value, "$", "array<string>")
    one = F.try_variant_get(value, "$", "string")
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), many), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def cinii_candidates(records: DataFrame, json: str = "json") -> DataFrame:
    """One candidate for each record; fields may be values or lists. Creators in Japanese letters come first."""
    v = records.withColumn("v", F.try_parse_json(json))
    creators = _texts(F.variant_get("v", "$['dc:creator']", "variant"))
    japanese = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    ordered = F.concat(F.filter(creators, lambda c: c.rlike(japanese)), F.filter(creators, lambda c: ~c.rlike(japanese)))
    identifiers = F.coalesce(
        F.try_variant_get("v", "$['dc:identifier']", "array<struct<`@type`:string,`@value`:string>>"),
        F.array(F.try_variant_get("v", "$['dc:identifier']", "struct<`@type`:string,`@value`:string>")),
    )
    doi = F.get(F.filter(identifiers, lambda x: x["@type"].rlike("(?i)DOI$")), F.lit(0))["@value"]
    year = F.regexp_extract(F.coalesce(F.try_variant_get("v", "$['prism:publicationDate']", "string"), F.lit("")), r"(?:19|20)\d{2}", 0)
    year = F.nullif(year, F.lit(""))
    return v.select(
        *records.columns,
        F.lit("CiNii Research").alias("provider"),
        doi.alias("doi"),
        F.try_variant_get("v", "$.title", "string").alias("title"),
        F.array_join(ordered, ", ").alias("authors"),
        F.try_variant_get("v", "$['prism:publicationName']", "string").alias("journal"),
        year.alias("year"),
        F.array_compact(F.array(year)).alias("year_candidates"),
        F.coalesce(F.try_variant_get("v", "$.link['@id']", "string"), F.try_variant_get("v", "$['@id']", "string")).alias("url"),
    )
