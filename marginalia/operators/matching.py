"""Reconciliation of references with bibliographic candidates.

Both sides are prepared once: folded texts and their bigrams. Candidates meet references by
what a reliable match asks for, and by nothing that frequent phrases make common: equal
identifiers, titles whose bigrams are similar (``set_join``), and titles that begin others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.references import fields_of_composed
from marginalia.functions.text import LATIN_SIGNS, OTHER_SIGNS, bigrams, composed, dice_of_sets, distinct_texts, folded, or_empty, with_once
from marginalia.operators import set_join
from marginalia.storage import kept

# Thresholds and weights of the comparison.
TITLE_SCORE, TITLE_EQUAL, TITLE_PREFIX = 0.82, 0.86, 12
AUTHOR_SCORE, JOURNAL_SCORE, JOURNAL_LENGTH = 0.48, 0.72, 3
CONFIDENCE, LEAST_CONFIDENCE = 0.58, 0.43
WEIGHTS = {"title": 0.5, "year": 0.25, "author": 0.15, "doi": 0.1}
PROVIDERS = ("Crossref", "CiNii Research")
FIELD_NAMES = {"title": "題名", "author": "著者", "year": "発行年", "journal": "掲載誌", "doi": "DOI"}
MAX_REFERENCE = 1000
#: Parts in which references are taken apart, for each core.
_PARTS = 3


def _filled(c: Column) -> Column:
    return or_empty(c) != ""


def _author_parts(authors: Column) -> Column:
    parts = F.transform(F.split(or_empty(authors), r"(?i)[,，、;&]|(?<![A-Za-z0-9_])and(?![A-Za-z0-9_])|・"), folded_native)
    return F.filter(parts, lambda p: F.length(p) >= 2)


def folded_native(text: Column) -> Column:
    """``folded`` for texts that are composed already; a Python function can't run inside an array."""
    latin = F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), LATIN_SIGNS, "")
    others = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{OTHER_SIGNS[0]}-{OTHER_SIGNS[-1]}]")
    return F.when(others, F.translate(latin, OTHER_SIGNS, "")).otherwise(latin)


def prepared_references(references: DataFrame, text: str = "text") -> DataFrame:
    """Adds the fields f and folded forms; ``reference`` takes the text's place. Only the first 1000 code points of a reference count."""
    r = references.withColumn("reference", F.left(F.trim(text), F.lit(MAX_REFERENCE))).where("reference <> ''").drop(text)
    # a table may be a single file, or its rows in few of its parts
    r = r.repartition(_PARTS * references.sparkSession.sparkContext.defaultParallelism, "ref_id")
    r = with_once(r, "_composed", composed(F.col("reference")))
    r = with_once(r, "f", fields_of_composed(F.col("_composed"), F.col("reference")))
    # the fields are parts of a composed text
    own = {"title": F.coalesce("f.title", "_composed"), "author": F.col("f.author_area"), "journal": F.col("f.journal"), "doi": F.col("f.doi")}
    return r.withColumns({f"f_{name}": folded_native(or_empty(value)) for name, value in own.items()}).drop("_composed")


def prepared_candidates(candidates: DataFrame) -> DataFrame:
    """candidates: cand_id, provider, doi, title, authors, journal, year, year_candidates, url."""
    years = F.when(F.size("year_candidates") > 0, F.col("year_candidates")).otherwise(distinct_texts(F.array("year")))
    c = candidates.withColumns({"c_years": years, "c_title": folded(F.col("title")), "c_author": folded(F.col("authors")), "c_journal": folded(F.col("journal")), "c_doi": folded(F.col("doi"))})
    c = c.withColumn("c_composed", composed(or_empty(F.col("authors"))))
    return c.withColumn("c_parts", _author_parts(F.col("c_composed")))


def similar_to_items(rows: DataFrame, text: str, items: DataFrame, item: str) -> DataFrame:
    """rows without ``text``, with each of the items without ``item`` whose folded text has a Dice score of ``TITLE_SCORE`` or more, and ``dice``."""
    return set_join.similar_texts(rows, text, items, item, TITLE_SCORE)


def similar_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """l_id, r_id of folded titles (id, text) that are similar as wholes, or of which the shorter, of twelve code points at least, begins the longer.

    Titles that rows share are compared once; rows meet by the names of their titles.
    """
    sides = [set_join.with_key(side.withColumnRenamed("id", f"{name}_id"), "text") for side, name in ((left, "l"), (right, "r"))]
    few = kept(sides[1].where("text <> ''").select("high", "low", "text").dropDuplicates(["high", "low"]), "titles")
    sets = set_join.gram_sets(few, "sets")
    if set_join.fits_index(sets):
        return _similar_to_few(left, few, sets).join(sides[1].select("r_id", F.col("high").alias("r_high"), F.col("low").alias("r_low")), ["r_high", "r_low"]).select("l_id", "r_id")
    titles = [kept(sides[0].where("text <> ''").select("high", "low", "text").dropDuplicates(["high", "low"]), "titles"), few]
    similar = set_join.similar_sets(set_join.gram_sets(titles[0], "sets"), sets, TITLE_SCORE).select("l_high", "l_low", "r_high", "r_low")
    keyed = [side.select(F.struct("high", "low").alias("id"), "text") for side in titles]
    for shorter, longer in ((0, 1), (1, 0)):
        found = set_join.begins(keyed[shorter], keyed[longer], TITLE_PREFIX)
        ends = [F.col(f"{('s_id', 'l_id')[side != shorter]}.{part}").alias(f"{'lr'[side]}_{part}") for side in (0, 1) for part in ("high", "low")]
        similar = similar.unionByName(found.select(*ends))
    named = [side.withColumnsRenamed({"high": f"{name}_high", "low": f"{name}_low"}).drop("text") for side, name in zip(sides, "lr")]
    return kept(similar.distinct(), "pairs").join(named[0], ["l_high", "l_low"]).join(named[1], ["r_high", "r_low"]).select("l_id", "r_id")


def _similar_to_few(left: DataFrame, few: DataFrame, sets: DataFrame) -> DataFrame:
    """l_id, r_high, r_low: as ``similar_titles`` where the right titles fit into every task; the left ones stay where they are."""
    similar = set_join.similar_to_index(left, sets, TITLE_SCORE).select(F.col("id").alias("l_id"), "r_high", "r_low")
    start = F.left("text", F.lit(TITLE_PREFIX)).alias("start")
    starts = few.where(F.length("text") >= TITLE_PREFIX).select(start).distinct()
    alike = left.where(F.length("text") >= TITLE_PREFIX).select("id", "text", start).join(F.broadcast(starts), "start", "left_semi")  # one for each right title, at most
    begun, keyed = kept(alike.select("id", "text"), "alike"), few.select(F.struct("high", "low").alias("id"), "text")
    found = set_join.begins(begun, keyed, TITLE_PREFIX).select(F.col("s_id").alias("l_id"), F.col("l_id.high").alias("r_high"), F.col("l_id.low").alias("r_low"))
    begin_it = set_join.begins(keyed, begun, TITLE_PREFIX).select("l_id", F.col("s_id.high").alias("r_high"), F.col("s_id.low").alias("r_low"))
    return kept(similar.unionByName(found).unionByName(begin_it).distinct(), "pairs")


def candidate_pairs(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """References with each candidate that could be a reliable match, once: equal identifiers, or, for a reference without one, titles that match."""
    same = references.where("f_doi <> ''").join(candidates, F.col("f_doi") == F.col("c_doi")).select("ref_id", "cand_id")
    titled = references.where((F.col("f_doi") == "") & _filled(F.col("f.title"))).select(F.col("ref_id").alias("id"), F.col("f_title").alias("text"))
    titles = similar_titles(titled, candidates.select(F.col("cand_id").alias("id"), F.col("c_title").alias("text")))
    pairs = kept(same.unionByName(titles.select(F.col("l_id").alias("ref_id"), F.col("r_id").alias("cand_id"))).distinct(), "pairs")  # few pairs let the references lie
    return pairs.join(references, "ref_id").join(candidates, "cand_id")


def author_score(reference: Column, candidate: Column, parts: Column) -> Column:
    """1 where one names the other, else the best Dice score of the whole or a part; 0 if either is empty."""
    named = F.contains(reference, F.left(candidate, F.lit(4))) | F.exists(parts, lambda p: F.contains(reference, p) | F.contains(p, reference))
    own = bigrams(reference)
    part = F.coalesce(F.array_max(F.transform(parts, lambda p: dice_of_sets(own, bigrams(p)))), F.lit(0.0))
    score = F.when(named, F.lit(1.0)).otherwise(F.greatest(dice_of_sets(own, bigrams(candidate)), part))
    return F.when((reference == "") | (candidate == ""), F.lit(0.0)).otherwise(score)


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def scored(pairs: DataFrame) -> DataFrame:
    """Adds title_score, year_score, author_score, doi_score and confidence; what is unknown scores a half."""
    year_known = _filled(F.col("f.year")) & (F.size("c_years") > 0)
    out = pairs.withColumns(
        {
            "title_score": dice_of_sets(bigrams(F.col("f_title")), bigrams(F.col("c_title"))),
            "year_score": F.when(year_known, F.array_contains("c_years", F.col("f.year")).cast("double")).otherwise(0.5),
            "author_score": author_score(F.col("f_author"), F.col("c_author"), F.col("c_parts")),
            "doi_score": F.when(F.col("f_doi") != "", (F.col("f_doi") == F.col("c_doi")).cast("double")).otherwise(0.5),
        }
    )
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("confidence", two_places(total))


def titles_match(a: Column, b: Column, score: Column) -> Column:
    """Nearly equal, or the shorter, of twelve code points at least, begins the longer."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (score >= TITLE_EQUAL) | ((F.length(shorter) >= TITLE_PREFIX) & F.startswith(longer, shorter))


def journals_match(a: Column, b: Column) -> Column:
    inside = (F.length(a) >= JOURNAL_LENGTH) & (F.length(b) >= JOURNAL_LENGTH) & (F.contains(a, b) | F.contains(b, a))
    return inside | (dice_of_sets(bigrams(a), bigrams(b)) >= JOURNAL_SCORE)


def _titles_match() -> Column:
    return titles_match(F.col("f_title"), F.col("c_title"), F.col("title_score"))


def is_reliable() -> Column:
    title = _filled(F.col("f.title")) & ((F.col("title_score") >= TITLE_SCORE) | _titles_match())
    author = ~(_filled(F.col("f.author_area")) & _filled(F.col("authors"))) | (F.col("author_score") >= AUTHOR_SCORE)
    year = ~(_filled(F.col("f.year")) & (F.size("c_years") > 0)) | (F.col("year_score") != 0)
    return F.when(F.col("f_doi") != "", F.col("f_doi") == F.col("c_doi")).otherwise(title & author & year & (F.col("confidence") >= CONFIDENCE))


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each reference the reliable candidate with the highest confidence; of equals the first provider's, then the least id.

    ``providers`` names those of all its candidates, in order of their best confidence.
    """
    at = F.coalesce(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider")), F.lit(len(PROVIDERS) + 1))
    found = scored(pairs)
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), at.alias("at"), "provider")).over(Window.partitionBy("ref_id")))
    named = found.withColumn("providers", F.array_distinct(F.transform(order, lambda x: x["provider"])))
    rank = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("confidence"), at, "cand_id"))
    return named.where(is_reliable()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def compared(best: DataFrame) -> DataFrame:
    """Adds checked_fields (names) and differences (field, provided, database), for what both sides have."""
    tests = {
        "title": (F.col("f.title"), F.col("title"), _titles_match()),
        "author": (F.trim("f.author_area"), F.col("authors"), F.col("author_score") >= AUTHOR_SCORE),
        "year": (F.col("f.year"), F.array_join("c_years", " / "), F.array_contains("c_years", F.col("f.year"))),
        "journal": (F.col("f.journal"), F.col("journal"), journals_match(F.col("f_journal"), F.col("c_journal"))),
        "doi": (F.col("f.doi"), F.col("doi"), F.col("f_doi") == F.col("c_doi")),
    }
    rows = F.array(
        *(
            F.struct(F.lit(FIELD_NAMES[k]).alias("field"), a.alias("provided"), b.alias("database"), (_filled(a) & _filled(b)).alias("both"), F.coalesce(same, F.lit(False)).alias("same"))
            for k, (a, b, same) in tests.items()
        )
    )
    both = F.filter(rows, lambda r: r["both"])
    different = F.transform(F.filter(both, lambda r: ~r["same"]), lambda r: F.struct(r["field"], r["provided"], r["database"]))
    return best.withColumns({"checked_fields": F.transform(both, lambda r: r["field"]), "differences": different})


def encoded(text: Column, left: str = "!~'()") -> Column:
    """Percent-encoding of an address's part, but for letters, digits, -_.* and the signs in ``left``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign in left:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def match_status(references: DataFrame, candidates: DataFrame, provider_failed: bool = False, failures: DataFrame | None = None) -> DataFrame:
    """One row per reference: ref_id, status, cand_id, confidence, checked_fields, differences, provider, provider_errors, providers, book_like, best, links.

    Statuses: verified, mismatch, unconfirmed (the title differs and no identifier tells),
    doi_unconfirmed, not_found, and lookup_incomplete where a provider failed: all lookups
    with ``provider_failed``, else those in ``failures`` (ref_id, provider). What the other
    providers found counts all the same. A best match of less than ``LEAST_CONFIDENCE`` is
    none: nothing of it is told.
    """
    term = F.coalesce(F.nullif("f.title", F.lit("")), "reference")  # of the reference nothing else is told
    refs = kept(prepared_references(references).withColumn("_term", term).drop("reference"), "references")  # several joins read both sides
    best = compared(best_matches(candidate_pairs(refs, kept(prepared_candidates(candidates), "candidates"))))
    record = F.struct("provider", "title", "authors", "journal", "year", "doi", "url", "confidence")
    told = best.where(F.col("confidence") >= LEAST_CONFIDENCE).select(
        "ref_id", "cand_id", "confidence", "checked_fields", "differences", "provider", "providers", "url", record.alias("best"), (F.col("f_doi") == F.col("c_doi")).alias("_same_doi")
    )
    found = kept(told, "found")
    out = refs.select("ref_id", "_term", "f", (F.col("f_doi") != "").alias("_doi")).join(found, "ref_id", "left")
    none = F.array().cast("array<string>")
    if failures is None:
        out = out.withColumn("provider_errors", F.array(*map(F.lit, PROVIDERS)) if provider_failed else none)
    else:
        names = kept(failures.groupBy("ref_id").agg(F.array_sort(F.collect_set("provider")).alias("_failed")), "failures")
        out = out.join(names, "ref_id", "left").withColumn("provider_errors", F.coalesce("_failed", none))
    absent = F.when(F.size("provider_errors") > 0, "lookup_incomplete").when(F.col("_doi"), "doi_unconfirmed").otherwise("not_found")
    title_differs = F.exists("differences", lambda d: d["field"] == FIELD_NAMES["title"])
    missing = F.col("cand_id").isNull()
    unconfirmed = title_differs & ~(F.col("_doi") & F.col("_same_doi"))
    status = F.when(missing, absent).when(unconfirmed, "unconfirmed").when(F.size("differences") > 0, "mismatch").otherwise("verified")
    term = encoded(F.col("_term"))
    links = F.struct(
        F.col("url").alias("source"), F.concat(F.lit("https://doi.org/"), encoded(F.nullif("f.doi", F.lit("")), "!~'();,/?:@&=+$#")).alias("doi"),
        F.concat(F.lit("https://cir.nii.ac.jp/all?q="), term).alias("cinii"), F.concat(F.lit("https://scholar.google.com/scholar?q="), term).alias("scholar"),
    )
    differences = F.when(unconfirmed, F.slice("differences", 1, 0)).otherwise(F.col("differences"))
    providers = F.coalesce("providers", F.array(*map(F.lit, PROVIDERS)))
    return out.select(
        "ref_id", status.alias("status"), "cand_id", "confidence", "checked_fields", differences.alias("differences"), "provider", "provider_errors", providers.alias("providers"),
        F.col("f.is_book").alias("book_like"), "best", links.alias("links"),
    )


def as_json(matches: DataFrame) -> DataFrame:
    """ref_id and what ``match_status`` found as one JSON text.

    Without a best match the answer names the providers that failed, and its best match is
    null; with one it has the link to it, and whether the reference looks like a book only
    where the match is unconfirmed.
    """
    none = F.array().cast("array<string>")
    common = {"differences": F.coalesce("differences", F.array().cast("array<struct<field:string,provided:string,database:string>>")), "checkedFields": F.coalesce("checked_fields", none), "providers": F.col("providers")}
    manual = F.struct("links.doi", "links.cinii", "links.scholar")

    def text(**columns: Column) -> Column:
        return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})

    status, book = F.col("status"), F.col("book_like")
    missing = text(status=status, providerErrors=F.col("provider_errors"), bookLike=book, bestMatch=F.col("best"), **common, links=manual)
    unconfirmed = text(status=status, bookLike=book, bestMatch=F.col("best"), **common, links=F.col("links"))
    told = text(status=status, bestMatch=F.col("best"), **common, links=F.col("links"))
    return matches.select("ref_id", F.when(F.col("cand_id").isNull(), missing).when(status == "unconfirmed", unconfirmed).otherwise(told).alias("json"))
