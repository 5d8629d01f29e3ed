"""What goes to a reviewing language model, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.pii import masked
from marginalia.functions.text import stripped
from marginalia.operators.structure import with_sections
from marginalia.schema import SEVERITIES

MAX_PAYLOAD = 120_000
ALL_CHECKS = ("format", "writing", "logic", "figures", "citations", "ethics", "completion")


def ai_payloads(paragraphs: DataFrame, references: DataFrame, checks: tuple[str, ...] = ALL_CHECKS) -> DataFrame:
    """doc_id, payload (JSON), n_chars, fits. Texts are masked, headings aren't; references go along only for citations."""
    placed = paragraphs if "heading" in paragraphs.columns else with_sections(paragraphs)
    body = placed.where(~F.col("is_heading") & (F.col("text") != "")).withColumn("text", masked(F.col("text")))

    def ordered(column: Column) -> Column:
        return F.array_sort(F.collect_list(column))

    sections = body.groupBy("doc_id", "section_no", "heading").agg(ordered(F.struct("idx", "p_id", "text")).alias("ps"))
    plain = F.transform("ps", lambda p: F.struct(p["p_id"].alias("id"), p["text"].alias("text")))
    docs = sections.groupBy("doc_id").agg(ordered(F.struct("section_no", "heading", plain.alias("paragraphs"))).alias("ss"))
    docs = docs.withColumn("sections", F.transform("ss", lambda s: F.struct(s["heading"].alias("heading"), s["paragraphs"].alias("paragraphs"))))
    none = F.array().cast("array<struct<id:string,text:string>>")
    if "citations" in checks:
        number = F.regexp_extract("ref_id", r"(\d+)", 1).cast("int").alias("n")
        refs = references.withColumn("text", masked(F.col("text"))).groupBy("doc_id").agg(ordered(F.struct(number, "ref_id", "text")).alias("rs"))
        docs = docs.join(refs, "doc_id", "left").withColumn("references", F.coalesce(F.transform("rs", lambda r: F.struct(r["ref_id"].alias("id"), r["text"].alias("text"))), none))
    else:
        docs = docs.withColumn("references", none)
    payload = F.to_json(F.struct(F.array(*map(F.lit, checks)).alias("checks"), "sections", "references"))
    return docs.select("doc_id", payload.alias("payload")).withColumn("n_chars", F.length("payload")).withColumn("fits", F.col("n_chars") <= MAX_PAYLOAD)


_ENVELOPE = "struct<output:array<struct<content:array<struct<type:string,text:string>>>>,output_text:string>"


def answer_text(response: Column) -> Column:
    """The answer in a response's JSON: the first output text, else the response's own; empty without either."""
    r = F.from_json(response, _ENVELOPE)
    contents = F.flatten(F.transform(F.filter(r["output"], lambda o: o["content"].isNotNull()), lambda o: o["content"]))
    texts = F.filter(contents, lambda c: (c["type"] == "output_text") & (c["text"] != ""))
    return F.coalesce(F.get(texts, F.lit(0))["text"], r["output_text"], F.lit(""))


def response_findings(responses: DataFrame, text: str = "text", default_category: str = "AI詳細チェック") -> DataFrame:
    """Findings in answers: JSON, perhaps in a code fence, with a list ``findings``.

    Entries that are no objects, or lack a title or a suggestion, go; an unknown severity
    becomes info.
    """
    bare = F.regexp_replace(stripped(F.col(text)), r"(?i)^```(?:json)?\s*|\s*```\z", "")
    entries = F.try_variant_get(F.try_parse_json(bare), "$.findings", "array<variant>")
    each = responses.withColumn("_e", entries).select(*responses.columns, F.posexplode("_e").alias("at", "_e"))

    def word(name: str) -> Column:
        return F.nullif(stripped(F.try_variant_get("_e", f"$.{name}", "string")), F.lit(""))

    severity = word("severity")
    known = F.when(severity.isin(*SEVERITIES), severity).otherwise("info")
    out = each.where(F.schema_of_variant("_e").startswith("OBJECT")).where(word("title").isNotNull() & word("suggestion").isNotNull())
    return out.select(
        *responses.columns,
        "at",
        F.coalesce(word("category"), F.lit(default_category)).alias("category"),
        known.alias("severity"),
        F.coalesce(word("location"), F.lit("")).alias("location"),
        word("title").alias("title"),
        F.coalesce(word("original"), F.lit("")).alias("original"),
        word("suggestion").alias("suggestion"),
        F.coalesce(word("reason"), F.lit("")).alias("reason"),
    )
