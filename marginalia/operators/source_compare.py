"""Comparison of a reference with what the cited page or report says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import SPACE, clean, dice_of_sets, stripped

# What the comparison of names leaves out, and departments that may follow a name.
_SIGNS = SPACE + r"""「」『』“”"'（）()\[\]{}.,，。、:：;；・\-–—"""
_LEGAL_FORMS = "【公式】|公式|株式会社|有限会社|公益社団法人|公益財団法人|一般社団法人|一般財団法人"
_DEPARTMENT = r"^(?:農林水産|経済|情報|事業|学部|大学院|研究|調査|政策|総務|企画|出版|広報).*(?:部|課|局|事業)\z"
TITLE, PUBLISHER, HTML_YEAR, PDF_YEAR = "題名", "作成者・発行元", "公開年", "発行年"


def _folded(text: Column) -> Column:
    """As ``folded_source``, for composed texts: usable inside arrays."""
    return F.regexp_replace(F.lower(text), f"[{_SIGNS}]", "")


def _grams(folded: Column) -> Column:
    n = F.length(folded)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(folded, i, F.lit(2))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def _name(folded: Column) -> Column:
    return F.regexp_replace(folded, _LEGAL_FORMS, "")


def _first(values: Column, test) -> Column:
    """The first value whose composed form passes."""
    return F.get(F.filter(values, lambda v: test(v["form"])), F.lit(0))["value"]


def _nearest(values: Column, text: Column) -> Column:
    """The value most like the text; of equals the first."""
    own = _grams(_folded(text))
    ranked = F.transform(values, lambda v, i: F.struct((-dice_of_sets(own, _grams(_folded(v["form"])))).alias("d"), i.alias("i"), v["value"].alias("v")))
    return F.array_min(ranked)["v"]


def compared_sources(cited: DataFrame) -> DataFrame:
    """cited: fields f and ``metadata``. Adds status, comparisons, differences and checked_fields.

    A title matches if equal in folded form, or for PDF texts inside one of their lines; a
    publisher if equal, equal without its legal form, or for PDF texts with a department
    after it; a year if equal. Status: source_verified, source_mismatch or source_partial.
    """
    joined = cited
    for name in ("title", "publisher"):  # each value with its composed form
        joined = joined.withColumn(f"_{name}s", F.zip_with(f"metadata.{name}s", f"metadata.{name}_forms", lambda v, f: F.struct(v.alias("value"), f.alias("form"))))
    title = clean(F.col("f.title"))  # the fields are parts of a composed text
    author = clean(F.col("f.author_area"))
    author = F.regexp_replace(F.regexp_replace(author, r"[（(.,]+\z", ""), rf"(?i)(?:HP|ホームページ|ウェブサイト|website)[{SPACE}]*\z", "")
    author = stripped(author)
    joined = joined.withColumns({"_title": title, "_author": author})
    t, a, pdf = _folded(F.col("_title")), _folded(F.col("_author")), F.col("metadata.format") == "pdf"
    same_title = F.coalesce(_first(F.col("_titles"), lambda v: _folded(v) == t), F.when(pdf & (F.length(t) >= 8), _first(F.col("_titles"), lambda v: F.contains(_folded(v), t))))
    bare = _name(a)
    department = F.when(
        pdf & (F.length(bare) >= 4),
        _first(F.col("_publishers"), lambda v: F.startswith(_name(_folded(v)), bare) & F.substring(_name(_folded(v)), F.length(bare) + 1, F.lit(500)).rlike(_DEPARTMENT)),
    )
    same_publisher = F.coalesce(
        F.when(a != "", _first(F.col("_publishers"), lambda v: _folded(v) == a)),
        F.when(F.length(bare) >= 3, _first(F.col("_publishers"), lambda v: _name(_folded(v)) == bare)),
        department,
    )
    best_title = F.coalesce(same_title, _nearest(F.col("_titles"), F.col("_title")))
    best_publisher = F.coalesce(same_publisher, _nearest(F.col("_publishers"), F.col("_author")))

    def row(field: Column, provided: Column, source: Column, unknown: Column, match: Column, evidence: Column) -> Column:
        state = F.when(unknown, "unknown").when(match, "match").otherwise("different")
        return F.struct(field.alias("field"), provided.alias("provided"), source.alias("source"), state.alias("state"), evidence.alias("evidence"))

    none = F.lit(None).cast("string")
    year = F.when(F.col("f.date_state") == "nd", "n.d.").otherwise(F.col("f.year"))
    rows = F.array(
        row(F.lit(TITLE), F.col("f.title"), best_title, (F.col("_title") == "") | best_title.isNull(), same_title.isNotNull(), none),
        row(F.lit(PUBLISHER), F.col("_author"), best_publisher, (F.col("_author") == "") | best_publisher.isNull(), same_publisher.isNotNull(), none),
        row(
            F.when(pdf, PDF_YEAR).otherwise(HTML_YEAR), year, F.col("metadata.year"),
            F.col("metadata.year").isNull() | (F.col("f.date_state") == "missing"), F.coalesce(F.col("f.year") == F.col("metadata.year"), F.lit(False)), F.col("metadata.year_evidence"),
        ),
    )
    out = joined.withColumn("comparisons", rows).drop("_title", "_author", "_titles", "_publishers")
    different = F.filter("comparisons", lambda r: r["state"] == "different")
    checked = F.transform(F.filter("comparisons", lambda r: r["state"] == "match"), lambda r: r["field"])
    status = F.when(F.size(different) > 0, "source_mismatch").when(F.size(checked) == 3, "source_verified").otherwise("source_partial")
    pairs = F.transform(different, lambda r: F.struct(r["field"].alias("field"), r["provided"].alias("provided"), r["source"].alias("database")))
    return out.withColumns({"status": status, "differences": pairs, "checked_fields": checked})
