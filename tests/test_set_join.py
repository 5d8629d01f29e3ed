import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import LEFT_OUT, LEFT_OUT_ALSO
from marginalia.operators import matching, set_join

WORDS = ["ka", "tori", "mise", "jutsu", "ken", "kyu", "hon", "no", "data", "市場", "調査", "学習", "支援"]


def grams(text):
    text = re.sub(f"[{LEFT_OUT}{LEFT_OUT_ALSO}]", "", unicodedata.normalize("NFKC", text or "").lower())
    return {text} if len(text) == 1 else {text[i : i + 2] for i in range(len(text) - 1)}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def varied(rng, text):
    signs = list(text)
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        signs[rng.randrange(len(signs))] = rng.choice("abcdeftx")
    return "".join(signs)


@pytest.mark.parametrize(("index_grams", "block"), [(1 << 40, 2_000), (0, 2_000), (0, 5)])
def test_all_similar_pairs_and_no_others(spark, monkeypatch, index_grams, block):
    """As one index for all tasks, or by first bigrams; frequent bigrams are dealt in blocks."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    left = [(i, varied(rng, rng.choice(base))) for i in range(160)] + [(500, ""), (501, None), (502, "a"), (503, "É"), (502, "a")]
    right = [(i, varied(rng, rng.choice(base))) for i in range(120)] + [(900, "A"), (901, "é"), (902, " - "), (903, None)]
    found = set_join.similar_texts(spark.createDataFrame(left, "a bigint, t string").repartition(3), "t", spark.createDataFrame(right, "b bigint, u string"), "u", 0.82, index_grams)
    want = sorted((i, j, round(d, 9)) for i, a in left for j, b in right if (d := dice(grams(a), grams(b))) >= 0.82)
    assert sorted((r.a, r.b, round(r.dice, 9)) for r in found.collect()) == want


def test_empty_sides(spark):
    rows, none = spark.createDataFrame([(1, "text")], "a bigint, t string"), spark.createDataFrame([], "b bigint, u string")
    for index_grams in (10, 0):
        assert set_join.similar_texts(rows, "t", none, "u", 0.82, index_grams).collect() == []


def test_a_phrase_that_all_titles_share_makes_few_pairs():
    """3,000 titles on either side with one phrase in common; under 1 % of the pairs are compared and no link is lost."""
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    own = ["".join(rng.choice(letters) for _ in range(rng.randint(14, 22))) for _ in range(3_000)]
    left = ["の学習支援に関する研究" + x for x in own]
    right = ["の学習支援に関する研究" + (x[:-1] + rng.choice(letters) if i % 10 == 0 else "".join(rng.choice(letters) for _ in range(18))) for i, x in enumerate(own)]
    sets = [set_join.grams_of(side) for side in (left, right)]
    number, count = np.unique(np.concatenate([np.concatenate(x) for x in sets]), return_counts=True)
    order = set_join.Order([int(g) for g in number[np.argsort(-count, kind="stable")] if count[number == g][0] > 1][: set_join.DICTIONARY])
    ranked = [set_join.Sets([np.sort(order.ranked(s)) for s in side], order.pivots()) for side in sets]
    meeting = set_join.Meeting(ranked[1], *ranked[1].firsts(0.82), 0.82)
    found = {(int(i), int(j)) for a, b, _ in meeting.links(ranked[0], *ranked[0].firsts(0.82)) for i, j in zip(a, b)}
    assert meeting.compared < 90_000
    as_sets = [[set(s.tolist()) for s in side] for side in sets]
    near = {(i, i) for i in range(3_000) if dice(as_sets[0][i], as_sets[1][i]) >= 0.82}
    assert len(near) > 250
    sampled = {(i, j) for i in rng.sample(range(3_000), 60) for j in range(3_000) if dice(as_sets[0][i], as_sets[1][j]) >= 0.82}
    assert near <= found and sampled <= found
    assert all(dice(as_sets[0][i], as_sets[1][j]) >= 0.82 for i, j in found)


def test_titles_that_begin_others(spark):
    texts = ["abcdefghijkl", "abcdefghijklm", "abcdefghijklmn", "abcdefghijk", "xbcdefghijklmn"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    found = sorted(tuple(r) for r in set_join.begins(frame, frame, 12).collect())
    assert found == sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if len(a) >= 12 and b.startswith(a))


def test_only_beginnings_that_a_text_can_have_are_made(spark):
    """200 texts with other beginnings and 30 lengths: the one that shares its beginning is cut at two lengths."""
    shorter = spark.createDataFrame([(i, f"{i:02}" * 6 + "x" * i) for i in range(30)] + [(30, "07" * 6)], "id bigint, text string")
    longer = spark.createDataFrame([(i, "another beginning " + "y" * i) for i in range(200)] + [(200, "07" * 6 + "x" * 9)], "id bigint, text string")
    assert sorted(tuple(r) for r in set_join._cuts(shorter, longer, 12).collect()) == [(200, "07" * 6), (200, "07" * 6 + "x" * 7)]
    assert sorted(tuple(r) for r in set_join.begins(shorter, longer, 12).collect()) == [(7, 200), (30, 200)]


def test_rows_with_one_title_all_link(spark):
    left = spark.createDataFrame([(1, "titleofmanyrows"), (2, "titleofmanyrows"), (3, ""), (4, "titleofmanyrowsandmoreofit")], "id bigint, text string")
    right = spark.createDataFrame([(10, "titleofmanyrows"), (11, "titleofmanyrows"), (12, "")], "id bigint, text string")
    found = {tuple(r) for r in matching.similar_titles(left, right).collect()}
    assert found == {(i, j) for i in (1, 2, 4) for j in (10, 11)}


def test_an_answer_below_the_least_confidence_tells_nothing_of_its_candidate(spark):
    record = [(7, "Crossref", "10.1234/a", "全く別の題名である論文の記録", "別人", "別の雑誌", "1950", ["1950"], "https://records.example/7")]
    candidates = spark.createDataFrame(record, "cand_id bigint, provider string, doi string, title string, authors string, journal string, year string, year_candidates array<string>, url string")
    references = spark.createDataFrame([("r1", "Smith（2019）「Another title altogether」 https://doi.org/10.1234/a")], "ref_id string, text string")
    found = matching.match_status(references, candidates)
    row = found.first()
    assert (row.status, row.cand_id, row.confidence, row.differences, row.checked_fields, row.best) == ("doi_unconfirmed", None, None, None, None, None)
    told = matching.as_json(found).select(F.get_json_object("json", "$.bestMatch").alias("best"), F.get_json_object("json", "$.differences").alias("d"), F.get_json_object("json", "$.checkedFields").alias("c"), "json").first()
    assert (told.best, told.d, told.c) == (None, "[]", "[]")
    assert '"bestMatch":null' in told.json and '"providers":["Crossref","CiNii Research"]' in told.json


def test_links_are_encoded_as_parts_of_addresses(spark):
    rows = spark.createDataFrame([("a b(c)!*'~é&/?",)], "t string").select(matching.encoded(F.col("t")).alias("part"), matching.encoded(F.col("t"), "!~'();,/?:@&=+$#").alias("whole")).first()
    assert rows.part == "a%20b(c)!*'~%C3%A9%26%2F%3F" and rows.whole == "a%20b(c)!*'~%C3%A9&/?"


@pytest.mark.parametrize(("product", "cells"), [(1 << 40, 1 << 22), (1 << 40, 3_000), (0, 1 << 22)])
def test_texts_that_meet_an_index_where_they_lie(spark, monkeypatch, product, cells):
    """All overlaps at once, by blocks of a few texts, or by first bigrams; rows that repeat a text come as often as they do."""
    monkeypatch.setattr(set_join, "CELLS", cells)
    rng = random.Random(4)
    base = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(30)]
    left = [(f"l{i}", varied(rng, rng.choice(base))) for i in range(150)] + [("same", base[0]), ("again", base[0]), ("none", ""), ("null", None), ("one", "é"), ("late", "a\U00020b9f")]
    right = [(i, varied(rng, rng.choice(base))) for i in range(60)] + [(900, "é"), (901, base[0]), (902, "a\U00020b9f")]
    items = set_join.with_key(spark.createDataFrame(right, "b bigint, text string"), "text")
    rows = spark.createDataFrame(left, "id string, text string").repartition(3)
    found = set_join.similar_to_index(rows, set_join.gram_sets(items, "sets"), 0.82, product)
    if product:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    names = {(r.high, r.low): r.text for r in items.collect()}
    want = sorted({(i, b) for i, a in left for _, b in right if dice(grams(a), grams(b)) >= 0.82})
    assert sorted((r.id, names[r.r_high, r.r_low]) for r in found.collect()) == want


def test_an_index_without_sets(spark):
    rows, none = spark.createDataFrame([("a", "text")], "id string, text string"), spark.createDataFrame([], "high bigint, low bigint, grams array<bigint>")
    assert set_join.similar_to_index(rows, none, 0.82).collect() == []
