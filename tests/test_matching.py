import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions.references import _clues, balanced, reference_fields
from marginalia.functions.text import LEFT_OUT, LEFT_OUT_ALSO
from marginalia.operators import matching, source_compare
from marginalia.sources import pages

TITLE = "山間地域の図書室における学習支援の試みと利用者への新たな「場づくり」"
RECORD = (1, "CiNii Research", None, TITLE, "林 亜紀, 西岡 透", "架空大学教養論叢", "2020", ["2020"], None)
DOI = (2, "Crossref", "10.1234/TEST", "Article", "Author", "Records", "2020", ["2020"], None)
CANDIDATES = "cand_id bigint, provider string, doi string, title string, authors string, journal string, year string, year_candidates array<string>, url string"


def status(spark, reference, candidates=(RECORD, DOI), **more):
    refs = spark.createDataFrame([("r1", reference)], "ref_id string, text string")
    return matching.match_status(refs, spark.createDataFrame(list(candidates), CANDIDATES), **more).first()


@pytest.mark.parametrize(
    ("author", "year", "wanted"), [("林・西岡", "2020", "verified"), ("別人", "2020", "not_found"), ("林・西岡", "2019", "not_found")]
)
def test_golden_references(spark, author, year, wanted):
    found = status(spark, f"{author}（{year}）「{TITLE}」『架空大学教養論叢』, 74, 109-117.")
    assert found.status == wanted
    if wanted == "verified":
        assert {"著者", "発行年"} <= set(found.checked_fields) and found.differences == []


def test_fields_are_computed_once(spark):
    """However many columns read them, the plan has the patterns of a reference's fields once."""
    refs = matching.prepared_references(spark.createDataFrame([("r1", "林（2020）「題名」")], "ref_id string, text string").repartition(2))
    assert refs._jdf.queryExecution().optimizedPlan().toString().count("ホームページ") == 1


def test_identifiers_decide_alone(spark):
    assert status(spark, "Author (2020) Article. https://doi.org/10.1234/test").status == "verified"
    assert status(spark, "Author (2020) Article. https://doi.org/10.1234/other").status == "doi_unconfirmed"


def test_failed_providers_and_no_candidates(spark):
    assert status(spark, "だれか（2020）「知られない題名の論文」", provider_failed=True).status == "lookup_incomplete"
    assert status(spark, "だれか（2020）「知られない題名の論文」").status == "not_found"


def page(spark, body, url="https://example.com/a"):
    return pages.with_page_metadata(spark.createDataFrame([(body, url)], "html string, url string")).first().metadata


def test_dates_of_pages(spark):
    ld = {"@type": "Article", "url": "https://example.com/a", "datePublished": "2021-01-01"}
    script = '<script type="application/ld+json">{}</script>'
    assert page(spark, "<title>t</title>" + script.format(json.dumps(ld)))["year"] == "2021"
    assert page(spark, "<title>t</title>" + script.format(json.dumps(ld | {"url": "https://example.com/other"})))["year"] is None
    assert page(spark, "<h1>題</h1>" + script.format("{broken"))["titles"] == ["題"]
    assert page(spark, '<article><time datetime="2021-02-03">x</time></article>')["year"] == "2021"
    assert page(spark, "<article><time>2020年</time></article><article><time>2021年</time></article>")["year"] is None
    assert page(spark, "<p>創業1950年</p><footer>© 2020</footer>")["year"] is None
    assert page(spark, "<title>Just a moment...</title>")["error"] == "access_restricted"


def test_titles_and_publishers_in_order(spark):
    body = (
        '<title>報告 | 例示の会</title><meta property="og:title" content="共有題"><meta name="citation_title" content="引用題"><meta name="author" content="著者">'
        '<header><h1>団体<br>\n部署</h1></header><h1>見出し</h1><nav><h1>索引</h1></nav><meta property="og:site_name" content="サイト|別名">'
    )
    found = page(spark, body)
    assert found.titles == ["引用題", "見出し", "共有題", "報告 | 例示の会", "報告"]
    assert found.publishers == ["著者", "サイト", "別名", "例示の会", "団体", "部署"]
    assert page(spark, None).titles == []


def test_full_width_pages_match(spark):
    metadata = page(spark, "<title>ＡＢＣ市場の報告 | 例示研究所</title><h1>ＡＢＣ市場の報告</h1><main><time>2021年</time></main>")
    assert metadata.titles[0] == "ＡＢＣ市場の報告" and metadata.title_forms[0] == "ABC市場の報告"
    given = spark.createDataFrame([("例示研究所（2021）「ＡＢＣ市場の報告」 https://example.com/a 閲覧", metadata)], f"r string, metadata {pages.METADATA}")
    assert source_compare.compared_sources(given.withColumn("f", reference_fields(F.col("r")))).first().status == "source_verified"


def pdf(spark, texts):
    rows = [(1, i + 1, len(texts), t, None, None) for i, t in enumerate(texts)]
    return pages.with_pdf_metadata(spark.createDataFrame(rows, "doc_id bigint, page_no int, n_pages int, text string, title string, author string")).first().metadata


def test_pdf_texts(spark):
    assert pdf(spark, ["平成24年度の調査\n平成25年3月"])["year"] == "2013"
    empty = pdf(spark, [""])
    assert empty["year"] is None and empty["notes"] == [pages.NO_TEXT]


@pytest.mark.parametrize(("year", "wanted"), [("2021", "source_verified"), ("2026", "source_mismatch"), ("n.d.", "source_mismatch")])
def test_sources(spark, year, wanted):
    metadata = page(spark, '<title>事業紹介 | 例示会社</title><article><h1>事業紹介</h1><time datetime="2021-01-01"></time></article>')
    given = spark.createDataFrame([(f"例示会社HP（{year}）「事業紹介」 https://example.com/a (2026年確認)", metadata)], f"r string, metadata {pages.METADATA}")
    assert source_compare.compared_sources(given.withColumn("f", reference_fields(F.col("r")))).first().status == wanted


def test_references_of_one_part_are_taken_apart_in_many(spark):
    refs = matching.prepared_references(spark.createDataFrame([(f"r{i}", f"林（2020）「題名{i}」") for i in range(50)], "ref_id string, text string").coalesce(1))
    assert refs.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_signs_that_are_left_out_natively(spark):
    given = ["a b–c—d", "“x” ‘y’", "（1）：；,.", "ı ß [q] {w}", "市場・調査。", ""]
    rows = spark.createDataFrame([(x,) for x in given], "t string")
    found = rows.select(matching.folded_native(F.col("t")).alias("a"), F.regexp_replace(F.lower("t"), f"[{LEFT_OUT}{LEFT_OUT_ALSO}]", "").alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and found[0].a == "abcd"


@pytest.mark.parametrize("text", ["「a」b「c」", "x「abc「d」e」f", "「abc「d」", "「ab」 「cde」", "no「end", "「abc", "」「abc」", "『abc』"])
def test_quotes_with_and_without_others_inside(spark, text):
    depth, start, wanted = 0, text.find("「"), None
    for i in range(start, len(text)) if start >= 0 else ():
        depth += (text[i] == "「") - (text[i] == "」")
        if depth == 0:
            wanted = text[start + 1 : i]
            break
    found = spark.createDataFrame([(text,)], "t string").select(balanced(F.col("t"), "「", "」").alias("q")).first().q
    assert found == (wanted if wanted is not None and len(wanted) >= 3 else None)


def test_titles_that_begin_others_and_records_that_repeat(spark):
    """Few records: the titles that cite them meet them where they lie, both ways, once for each record."""
    long = "a long title of a study of very many things"
    left = spark.createDataFrame([("whole", long), ("start", long[:14]), ("more", long + " and what came of them in later years and other places"), ("short", long[:5]), ("other", "something else"), ("none", "")], "id string, text string")
    right = spark.createDataFrame([(1, long), (2, long), (3, long[:13]), (4, None)], "id bigint, text string")
    found = sorted(map(tuple, matching.similar_titles(left, right).collect()))
    assert found == [(x, n) for x in ("more", "start", "whole") for n in (1, 2, 3)]


def test_references_stay_where_few_matches_meet_them(spark):
    refs = spark.createDataFrame([("r1", f"林・西岡（2020）「{TITLE}」『架空大学教養論叢』, 74, 109-117."), ("r2", "だれか（2020）「知られない題名の論文」")], "ref_id string, text string")
    found = matching.match_status(refs, spark.createDataFrame([RECORD, DOI], CANDIDATES))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ref_id, r.status) for r in found.collect()) == [("r1", "verified"), ("r2", "not_found")]


def test_other_quotes_are_sought_where_none_is_found(spark):
    given = ["林（2020）「題名である」『教養論叢』", "林（2020）『経営の考え方』", 'Li (2020) "A long title"']
    rows = spark.createDataFrame([(x,) for x in given], "t string").select(_clues(F.col("t"), F.lit(None).cast("string")).alias("c")).collect()
    assert [(r.c.quoted, r.c.book, r.c.in_quotes) for r in rows] == [("題名である", None, None), (None, "経営の考え方", None), (None, None, "A long title")]


def test_references_stay_where_failures_are_named(spark):
    refs = spark.createDataFrame([("r1", f"林・西岡（2020）「{TITLE}」"), ("r2", "だれか（2020）「知られない題名の論文」")], "ref_id string, text string")
    failures = spark.createDataFrame([("r2", "Crossref")], "ref_id string, provider string")
    found = matching.match_status(refs, spark.createDataFrame([RECORD, DOI], CANDIDATES), failures=failures)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ref_id, r.status) for r in matching.as_json(found).select("ref_id", F.get_json_object("json", "$.status").alias("status")).collect()) == [("r1", "verified"), ("r2", "lookup_incomplete")]
