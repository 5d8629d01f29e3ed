import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions import pii, references, text


@pytest.mark.parametrize(
    ("given", "kinds"),
    [
        ("調査日は 20250101 である。", []),
        ("学籍番号 20250101", [pii.STUDENT]),
        ("番号1234567番 student id", [pii.STUDENT]),
        ("連絡先 user@example.com 学籍番号 20250101", [pii.EMAIL, pii.STUDENT]),
        ("090-1234-5678", [pii.PHONE]),
        ("", []),
    ],
)
def test_pii(given, kinds):
    assert [s[0] for s in pii.spans_of(given)] == kinds


def test_masking_does_not_depend_on_the_order_of_kinds():
    assert pii.masked_text("連絡先 user@example.com 学籍番号 20250101") == f"連絡先 [{pii.EMAIL}] 学籍番号 [{pii.STUDENT}]"
    assert pii.masked_text("調査日は 20250101 である。") == "調査日は 20250101 である。"


@pytest.mark.parametrize(
    ("given", "state", "year"),
    [
        ("企業HP（n.d.）「事業紹介」 https://example.com/2016 (2026年1月14日確認)", "nd", None),
        ("企業HP（ｎ.ｄ.）「事業紹介」", "nd", None),
        ("企業HP（n. d.）「事業紹介」", "nd", None),
        ("企業HP「2020年の事業紹介」 https://example.com/2016 (2026年1月14日確認)", "missing", None),
        ("企業HP（2016b）「事業紹介」 (2026年確認)", "provided", "2016"),
        ("", "missing", None),
    ],
)
def test_dates(spark, given, state, year):
    found = one(spark, references.reference_date(F.lit(given)))
    assert (found["date_state"], found["year"]) == (state, year)


@pytest.mark.parametrize(("given", "year"), [("2021-04-01", "2021"), ("平成25年3月", "2013"), ("令和元年", "2019"), ("第12号", None), (None, None)])
def test_publication_year(spark, given, year):
    assert one(spark, references.year_of(F.lit(given).cast("string"))) == year


def test_urls_keep_their_own_brackets(spark):
    def source_url(x):
        return one(spark, references.source_url(F.lit(x)))

    assert source_url("見よ https://example.com/article_(details) を") == "https://example.com/article_(details)"
    assert source_url("(https://example.com/a)。") == "https://example.com/a"
    assert source_url("なし") is None


@pytest.mark.parametrize(
    ("given", "kind"),
    [
        ("企業HP（2020）「事業紹介」 https://example.com/2020-05-15/news", "web"),
        ("環境局（2021）「環境白書」 https://example.org/report.pdf 閲覧", "report"),
        ("佐藤（2018）『経営の考え方』中央出版.", "book"),
        ("Smith, J. (2019). A study of things. Journal of Things, 4(2), 10-20.", "article"),
    ],
)
def test_reference_types(spark, given, kind):
    assert one(spark, references.reference_fields(F.lit(given)))["reference_type"] == kind


def test_nested_quotes_are_balanced(spark):
    found = one(spark, references.reference_fields(F.lit("林・西岡（2020）「試みと新たな「場づくり」」『教養論叢』, 74, 109-117.")))
    assert found["title"] == "試みと新たな「場づくり」"
    assert found["journal"] == "教養論叢"


def test_clues_that_are_not_asked_for_are_not_sought(spark):
    clues = one(spark, references._clues(F.lit("林（2020）「題名である」『論叢』, 74, 109-117."), F.lit(None).cast("string")))
    assert (clues.quoted, clues.named, clues.parts, clues.numbered, clues.web_cue, clues.report_cue) == ("題名である", "論叢", None, None, None, None)
    clues = one(spark, references._clues(F.lit("Smith, J. (2019). A study of things. Journal of Things, 4(2), 10-20."), F.lit(None).cast("string")))
    assert clues.parts[0] == "A study of things" and clues.numbered


@pytest.mark.parametrize("address", ["0.0.0.0", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.169.254", "192.168.0.1", "224.0.0.1", "240.0.0.1", "::1", "fc00::1", "fe80::1", "::ffff:10.0.0.1", "", "x"])
def test_addresses_that_are_not_public(address):
    assert not references.is_public_address(address)


def test_public_address():
    assert references.is_public_address("8.8.8.8")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dice_and_overlap(spark):
    assert one(spark, F.round(text.dice(F.lit("abcd"), F.lit("abce")), 4)) == 0.6667
    assert one(spark, text.overlap(F.lit("abcd"), F.lit("abce"))) == 0.5
    assert one(spark, text.dice(F.lit(""), F.lit("abce"))) == 0.0


def test_folded(spark):
    assert one(spark, text.folded(F.lit("Ａ「b」 c・Ｄ"))) == "abcd"
    assert one(spark, text.clean(F.lit("　a ​\n b　"))) == "a b"


def test_sentences_and_entities(spark):
    assert one(spark, text.sentences(F.lit("一つ。二つ！ 三つ"))) == ["一つ。", "二つ！", "三つ"]
    assert one(spark, text.entities_decoded(F.lit("a &amp;amp; &#233;&#39;&#26085;"))) == "a &amp; é'日"


def test_query_variants(spark):
    assert one(spark, text.query_variants(F.lit("A study (of things): sub"))) == ["A study (of things): sub", "A study  : sub", "A study (of things)"]
    assert one(spark, text.query_variants(F.lit(None).cast("string"))) == []


def test_numeric_entities_of_every_plane(spark):
    given = {"&#128512;": "😀", "&#55357;&#56832;": "😀", "&#9999999;": "\ufffd", "&#55357;x": "\ufffdx", "&#56832;": "\ufffd", "a&b&#;&#65;": "a&b&#;A", "&#99999999999;": "\ufffd"}
    rows = spark.createDataFrame(list(given.items()), "x string, y string").select("y", text.entities_decoded(F.col("x")).alias("x"))
    assert [r.x for r in rows.collect()] == list(given.values())


def test_only_texts_that_need_it_reach_python(spark):
    rows = spark.createDataFrame([("plain",), ("Ａ a@b.jp",), (None,), ("学籍番号 20250101",)], "x string")
    found = rows.select(text.composed(F.col("x")).alias("c"), pii.masked(F.col("x")).alias("m"), F.size(pii.pii_spans(F.col("x"))).alias("n")).collect()
    assert [tuple(r) for r in found] == [("plain", "plain", 0), ("A a@b.jp", "Ａ [メールアドレス]", 1), (None, None, 0), ("学籍番号 20250101", "学籍番号 [学籍番号候補]", 1)]


def test_overlap_lays_characters_out_once():
    """No character goes through a pattern: 2,000 lines of 500 characters against their neighbours take a second or two."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdeé市場 😀") for _ in range(rng.choice([0, 1, 2, 40, 500]))) for _ in range(2_000)]

    def grams(x):
        return {x[i : i + 2] for i in range(len(x))}

    wanted = [2 * len(grams(a) & grams(b)) / max(1, len(grams(a)) + len(grams(b))) for a, b in zip(lines, lines[1:])]
    began = time.process_time()
    assert list(text.overlaps_of(pd.Series(lines[:-1]), pd.Series(lines[1:]))) == pytest.approx(wanted)
    assert time.process_time() - began < 5
    assert list(text.overlaps_of(pd.Series(["", None]), pd.Series([None, ""]))) == [0.0, 0.0]


def test_folded_forms_are_those_of_the_patterns(spark):
    given = ["Ａ ｂ「ｃ」–—d’e‘　​F", "  a   b\x1c\n", "x" * 499 + " yz", "İΟΔΟΣ; ①", "", None]
    rows = spark.createDataFrame([(x,) for x in given], "t string")
    c = F.coalesce("t", F.lit(""))
    wanted = F.regexp_replace(F.lower(text.composed(c)), f"[{text.LEFT_OUT}{text.LEFT_OUT_ALSO}]", ""), F.regexp_replace(F.lower(text.composed(text.clean(c))), f"[{text.LEFT_OUT}]", "")
    for r in rows.select(text.folded(F.col("t")).alias("a"), text.folded_source(F.col("t")).alias("b"), wanted[0].alias("x"), wanted[1].alias("y")).collect():
        assert (r.a, r.b) == (r.x, r.y)


def test_overlap_of_texts_that_hold_more_than_is_laid_out_at_once(monkeypatch):
    monkeypatch.setattr(text, "_CHARACTERS", 10)
    lines = pd.Series(["abcd", "", "x" * 30, "abce", "x" * 30 + "y", None, "abcd"])
    assert list(text.overlaps_of(lines, lines.shift(-1))) == pytest.approx([0, 0, 0, 0, 0, 0, 0])
    assert list(text.overlaps_of(lines, lines[::-1].reset_index(drop=True))) == pytest.approx([1, 0, 0.4, 1, 0.4, 0, 1])
