import pytest
from pyspark.sql import functions as F

from marginalia.operators import results, rules, structure
from marginalia.plans import corpus
from marginalia.schema import PARAGRAPHS


def tables(spark, *texts, headings=()):
    rows = [(1, f"p{i}", i, t, "", "", False, None) for i, t in enumerate(texts, 1)]
    rows += [(1, f"p{i}", i, f"見出し{i}", "Heading", "heading", True, level) for i, level in enumerate(headings, len(texts) + 1)]
    return rules.DocTables.of(spark.createDataFrame(rows, PARAGRAPHS))


def spans(findings):
    return [[(r.start, r.end) for r in f.ranges] for f in findings.orderBy("seq").collect()]


def test_heading_jumps(spark):
    found = rules.heading_jumps(tables(spark, headings=(1, 3, 1, 4))).orderBy("p_idx").collect()
    assert [f.p_idx for f in found] == [2, 4]


def test_thinking_in_quotes_is_not_the_writer(spark):
    assert rules.thinking(tables(spark, "参加者は「重要だと思う」と回答した。")).count() == 0
    assert rules.thinking(tables(spark, "重要だと思う。")).count() == 1


@pytest.mark.parametrize(("given", "wanted"), [("本をを読む。", [[(1, 3)]]), ("そののち", []), ("終わった。。", [[(4, 6)]])])
def test_doubled(spark, given, wanted):
    assert spans(rules.doubled(tables(spark, given))) == wanted


def test_full_width(spark):
    assert spans(rules.full_width(tables(spark, "ブランド経験を４つに分け、4つ目を説明した。"))) == [[(7, 8)]]
    assert rules.full_width(tables(spark, "４つに分けた。")).count() == 0


@pytest.mark.parametrize(("given", "wanted"), [("調査は,次の通りである(Brakus, 2008)。", [[(3, 4)]]), ("A, 日本", [[(1, 2)]]), ("A, B", []), ("）,本", [[(1, 2)]])])
def test_ascii_commas(spark, given, wanted):
    assert spans(rules.ascii_commas(tables(spark, given))) == wanted


def test_variants(spark):
    assert rules.spelling_variants(tables(spark, "サーバーとサーバ")).first().detail == "サーバー:1 サーバ:1"
    assert rules.spelling_variants(tables(spark, "サーバー")).count() == 0


def test_any_latin_r_is_a_design_term(spark):
    assert rules.no_design(tables(spark, "調査を行う")).count() == 1
    assert rules.no_design(tables(spark, "調査を行う", "brand")).count() == 0


def test_caption_sources(spark):
    assert rules.caption_sources(tables(spark, "本文", "図1 概念", "説明", "出典：筆者作成")).count() == 0
    assert rules.caption_sources(tables(spark, "先行研究を参考にした。", "図1 概念モデル")).count() == 1


@pytest.mark.parametrize(("given", "wanted"), [("図1 図3", ["図2"]), ("図1-2 図3", []), ("図1 図9", []), ("図2", []), ("図１ 図３ 図4", ["図2"])])
def test_missing_numbers(spark, given, wanted):
    assert [f.detail for f in rules.missing_numbers(tables(spark, given)).collect()] == wanted


def test_style_mixture(spark):
    polite, plain = "この文は丁寧に書いています。" * 3, "この文は断定の形である。" * 3
    found = rules.style_mixture(tables(spark, polite, plain)).collect()
    assert len(found) == 3 and all("います" in f.original for f in found)


def test_chosen_checks(spark):
    placed = structure.with_sections(structure.with_parts(corpus.paragraphs(spark)))
    t = rules.DocTables.of(placed.where("part = 'body'"), structure.references(placed))
    assert rules.run_checks(t, ["nothing"]).count() == 0
    found = rules.run_checks(t, ["ethics", "format"])
    assert {r.rule for r in found.select("rule").distinct().collect()} == {"personal_data", "heading_jump", "no_headings"}
    assert results.ordered(found).first().severity == "important"
    assert found.select("finding_id").distinct().count() == found.count()
    assert results.shown(found, important_only=True).count() == 5


def test_empty_documents(spark):
    assert rules.run_checks(rules.DocTables.of(spark.createDataFrame([], PARAGRAPHS))).count() == 0


FILLER = "地域の店舗を訪れた人の話を聞き"


def sentence(n, pauses=0, connectives=0, more=""):
    """A sentence of ``n`` characters with so many pauses and connectives."""
    body = "、" * pauses + "しかし" * connectives + more
    return body + (FILLER * 20)[: n - len(body) - 1] + "。"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (sentence(180), 1), (sentence(179), 0), (sentence(145, pauses=4), 1), (sentence(144, pauses=4), 0), (sentence(145, pauses=3), 0),
        (sentence(135, pauses=3, connectives=2), 1), (sentence(135, pauses=3, connectives=1), 0), (sentence(134, pauses=3, connectives=2), 0),
        (sentence(190, more="CFI=0.95、AIC=120、p<0.05、"), 0), (sentence(190, more="尺度(Brakus, 2008)と(Smith, 2010)"), 0),
        (sentence(150) + "「" + "引" * 60 + "」", 0), (sentence(100) + sentence(100), 0),
    ],
)
def test_long_sentences(spark, given, wanted):
    assert rules.long_sentences(tables(spark, given)).count() == wanted


def test_document_rules_one_by_one_and_together(spark):
    given = tables(spark, "アンケートの結果", "・一", "・二", "・三", "本文")
    together = rules.run_checks(given, ["format", "logic", "completion"])
    alone = [rule(given) for name in ("format", "logic", "completion") for rule in rules.CHECKS[name]]
    assert sorted((r.rule, r.detail) for r in together.collect()) == sorted((r.rule, r.detail) for f in alone for r in f.collect())
    assert {r.rule for r in together.collect()} == {"no_headings", "no_purpose", "no_conclusion", "no_prior_research", "no_design", "bullets", "no_discussion"}
    order = [r.emit_order for r in results.ordered(together).collect() if r.severity == "info"]
    assert order == sorted(order)


def test_compiled_rules_read_few_tables_and_give_what_single_ones_give(spark):
    """Three scans and four exchanges for all rules; tables add their terms and numbers."""
    placed = structure.with_sections(structure.with_parts(corpus.paragraphs(spark)))
    more = spark.createDataFrame([(1, "図9 調査"), (77, "アンケート"), (77, None)], "doc_id bigint, text string")
    for t in (rules.DocTables.of_parts(placed), rules.DocTables.of(placed.where("part = 'body'"), structure.references(placed)), rules.DocTables.of_parts(placed, more)):
        found = rules.run_checks(t)
        together = sorted(str(r) for r in found.drop("finding_id", "emit_order").collect())
        chosen = [rule for of_check in rules.CHECKS.values() for rule in of_check]
        assert together == sorted(str(r) for rule in chosen for r in rule(t).collect())
    plan = rules.run_checks(rules.DocTables.of_parts(placed))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 3


def test_numbers_of_figures_over_lines(spark):
    """A number on the line after its sign counts, one beyond another line doesn't, and tables follow the last paragraph."""
    assert [f.detail for f in rules.missing_numbers(tables(spark, "図", "1 と図3", "図", "ほか", "9")).collect()] == ["図2"]
    table = spark.createDataFrame([(1, "3 である")], "doc_id bigint, text string")
    with_table = rules.DocTables(tables(spark, "図1", "続く図").rows, table)
    assert [f.detail for f in rules.missing_numbers(with_table).collect()] == ["図2"]


def test_rules_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(rules, "CHECKS", dict(rules.CHECKS))
    monkeypatch.setattr(rules, "CATEGORIES", dict(rules.CATEGORIES))
    rules.register("house", rules.Rule("no_tabs", "house", "info", lambda: rules._one(F.col("text").contains("\t")), first=1))
    rules.register("house", lambda t: rules.no_purpose(t))
    found = rules.run_checks(tables(spark, "a\tb", "c\td", "e"), ["house"]).orderBy("emit_order").collect()
    assert [(f.rule, f.p_idx, f.emit_order) for f in found] == [("no_tabs", 1, 0), ("no_purpose", None, 1)]


def test_places_in_the_order_in_which_findings_are_shown(spark):
    found = rules.run_checks(rules.DocTables.of_parts(structure.with_sections(structure.with_parts(corpus.paragraphs(spark)))))
    placed = results.positions(found).orderBy("pos").collect()
    wanted = results.ordered(found).collect()
    assert [r.pos for r in placed] == list(range(1, len(wanted) + 1))
    assert [(r.severity, r.emit_order, r.doc_id, r.seq) for r in placed] == [(r.severity, r.emit_order, r.doc_id, r.seq) for r in wanted]
    assert results.positions(found.where("false")).count() == 0
