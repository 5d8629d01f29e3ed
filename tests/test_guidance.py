from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import folded
from marginalia.operators import guidance, matching, payload, rules, set_join, state, structure
from marginalia.plans import corpus, queries


def test_every_rule_has_texts(spark):
    found = guidance.with_texts(rules.run_checks(rules.DocTables.of_parts(structure.with_sections(structure.with_parts(corpus.paragraphs(spark)))))).collect()
    assert {r.rule for r in found} <= {x[0] for x in guidance.RULE_TEXTS}
    assert all(r.title and r.original and r.suggestion and r.reason for r in found if r.rule != "missing_number")
    assert not [r for r in found if "{" in f"{r.title}{r.suggestion}{r.reason}"]
    texts = {r.rule: r for r in found}
    assert texts["missing_number"].title.startswith(("図番号に欠番の可能性（図", "表番号に欠番の可能性（表"))


def lookup(spark, **values):
    names = [x.split(":")[0] for x in guidance.LOOKUP_RESULT.replace(", ", "|").split("|")]
    columns = [x.split(" ")[0] for x in names]
    row = {"ref_id": "ref3", "text": "原文"} | values
    return guidance.lookup_findings(spark.createDataFrame([tuple(row.get(c) for c in columns)], guidance.LOOKUP_RESULT))


def test_lookup_findings(spark):
    assert lookup(spark, status="verified").count() == 0
    assert lookup(spark, status="manual_source", reference_type="report").first().outcome == "manual_report"
    assert lookup(spark, status="not_found", book_like=True).first().outcome == "book"
    assert lookup(spark, status=None).first().outcome == "unsettled"
    differs = lookup(spark, status="mismatch", provider="CiNii", differences=[("発行年", "2020", None), ("題名", "", "別")]).first()
    assert differs.severity == "warning" and differs.location == "参考文献 3"
    assert differs.suggestion == "発行年\n記載：2020\n照合先：なし\n\n題名\n記載：なし\n照合先：別"
    assert lookup(spark, status="source_unavailable", source_error="http_404").first().reason.startswith(guidance.SOURCE_ERRORS["http_404"])
    assert lookup(spark, status="source_unavailable", source_error="other").first().reason.startswith(guidance.OTHER_ERROR)
    unknown = lookup(spark, status="source_partial", comparisons=[("公開年", "unknown")]).first()
    assert unknown.suggestion.endswith(guidance.NO_YEAR)
    assert lookup(spark, status="source_verified", source_year="2020", comparisons=[("公開年", "unknown")], date_state="missing").first().suggestion.endswith(guidance.NO_DATE)


@pytest.mark.parametrize(("ranges", "wanted"), [([(0, 2), (1, 3), (2, 4)], [(0, 2), (2, 4)]), ([(3, 9)], []), ([(-1, 2), (1, 1)], [(1, 1)]), ([], []), (None, [])])
def test_highlighted(spark, ranges, wanted):
    rows = spark.createDataFrame([("abcd", ranges)], "t string, r array<struct<start:int,end:int>>")
    assert [tuple(x) for x in rows.select(guidance.highlighted(F.col("t"), F.col("r")).alias("x")).first().x] == wanted


def test_failures_of_single_providers(spark):
    failures = spark.createDataFrame([("r02", "Crossref"), ("r04", "CiNii Research")], "ref_id string, provider string")
    found = {r.ref_id: r for r in matching.match_status(corpus.references(spark), corpus.candidates(spark), failures=failures).collect()}
    assert found["r02"].status == "lookup_incomplete" and found["r02"].provider_errors == ["Crossref"]
    assert found["r04"].status == "verified" and found["r03"].status == "not_found" and found["r09"].book_like


def brute_outcomes(requests, client_limit, global_limit, window):
    """(id, client, seconds, method, origin allowed) in order of time."""
    clients, passed, out = {}, [], {}
    for at, client, now, method, own in requests:
        mine = clients.setdefault(client, [])
        mine[:] = [t for t in mine if now - t < window]
        passed[:] = [t for t in passed if now - t < window]
        if method != "POST":
            out[at] = "method_not_allowed"
        elif not own:
            out[at] = "forbidden"
        elif len(mine) >= client_limit:
            out[at] = "client_limited"
        else:
            mine.append(now)
            out[at] = "globally_limited" if len(passed) >= global_limit else "passed"
            if out[at] == "passed":
                passed.append(now)
    return out


def test_guard_chain_against_brute_force(spark):
    rows = [(i, f"c{i * 7 % 5}", i * 3 + i % 4, "GET" if i % 9 == 0 else "POST", i % 6 != 0) for i in range(120)]
    start = datetime(2024, 1, 1)
    given = spark.createDataFrame(
        [(i, c, start + timedelta(seconds=s), m, "https://own.example" if ok else "https://x.example", None) for i, c, s, m, ok in rows],
        "id bigint, client string, ts timestamp, method string, origin string, referer string",
    )
    allowed = spark.createDataFrame([("https://own.example",)], "origin string")
    found = state.guard_chain(given, allowed, "client", "ts", "id", 3, 9, 60)
    wanted = brute_outcomes(rows, 3, 9, 60)
    assert {r.id: r.outcome for r in found.collect()} == wanted and len(set(wanted.values())) == 5


def test_answers(spark):
    given = [('{"output":[{"content":[{"type":"output_text","text":"a"}]}]}', "a"), ('{"output_text":"b"}', "b"), ("{}", ""), (None, "")]
    rows = spark.createDataFrame(given, "r string, wanted string").select(payload.answer_text(F.col("r")).alias("x"), "wanted").collect()
    assert all(r.x == r.wanted for r in rows)


def test_similar_items_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 5)
    base = "the quick brown fox jumps over the lazy dog while nobody is looking at the hills"
    texts = [base, base[5:], base[:40], base.upper(), "a", "A", "", None, "b", base.replace("fox", "cat"), "ab", "aba", "日本語の題名です", "日本語の題名でした"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    items = spark.createDataFrame([(i, x) for i, x in enumerate([base, "a", "ab", "日本語の題名です", "", base[:30]])], "item_id bigint, item string")
    found = {(r.id, r.item_id): r.dice for r in matching.similar_to_items(rows, "t", items, "item").collect()}
    fold = {x.s: x.f for x in spark.createDataFrame([(t,) for t in {*texts, *(r.item for r in items.collect())} if t is not None], "s string").select("s", folded(F.col("s")).alias("f")).collect()}

    def grams(x):
        return {x} if len(x) == 1 else {x[i : i + 2] for i in range(len(x) - 1)}

    wanted = {}
    for i, t in enumerate(texts):
        for item in items.collect():
            a, b = grams(fold.get(t, "")), grams(fold[item.item])
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= matching.TITLE_SCORE:
                wanted[i, item.item_id] = 2 * len(a & b) / (len(a) + len(b))
    assert found == pytest.approx(wanted) and len(wanted) > 8
