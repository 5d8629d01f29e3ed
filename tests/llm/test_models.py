import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_helpers import by_id
from marginalia.llm import decontaminate, langid, quality

WORDS = {"aa": ["der", "und", "nicht", "schön", "über"], "bb": ["the", "and", "of", "there", "with"], "cc": ["que", "les", "été", "pour", "une"]}


def labelled(spark, dice, n=300):
    rows = []
    for i in range(n):
        lang = dice.choice(list(WORDS))
        rows.append((i, " ".join(dice.choices(WORDS[lang], k=dice.randint(3, 60))), lang))
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !", "bb"), (None, "the and of", "bb"), (1003, "the " * 40_000, None), (5, "the and", "bb"), (5, "the and", "bb")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"label": F.lit(1), "held_out": F.lit("x")})




def test_language_id(spark, dice):
    docs = labelled(spark, dice)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = langid.language_id(docs, held_out).collect()
    assert len(found) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    known = [r for r in found if r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in known if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    special = {r.doc_id: r for r in found if r.doc_id in (1000, 1001, 1002, 1003)}
    assert [special[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert not special[1000].accepted and special[1000].score == 0


def test_language_id_without_anything_to_learn(spark, dice):
    docs = labelled(spark, dice, 5)
    assert {r.lang_pred for r in langid.language_id(docs, F.lit(True)).collect()} == {"und"}
    assert langid.language_id(docs.limit(0), F.lit(False)).count() == 0


def test_slices_of_long_texts_count_as_the_whole(monkeypatch):
    text = "Über die Größe, und so weiter. " * 200
    whole = langid.subword_counts(text)
    monkeypatch.setattr(langid, "_SLICE", 100)
    assert (langid.subword_counts(text) == whole).all()


def corpus(spark, dice):
    good = lambda: " ".join(dice.choices(["This", "is", "a", "plain", "text", "with", "words.", "Some", "more,"], k=dice.randint(20, 80)))
    junk = lambda: " | ".join(dice.choices(["buy%%%", "now###", "BUY!!", "click$$$"], k=dice.randint(20, 80)))
    rows = [(i, junk() if i % 7 == 0 else good(), "hot" if i % 3 else f"s{i % 5}", "p") for i in range(400)]
    rows += [(1000, None, "hot", "p"), (1001, "", None, None), (None, "A plain text with words.", "hot", "p"), (3, rows[3][1], "hot", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumns({"host": F.lit(1), "quality": F.lit("x"), "p": F.lit("y")})
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(0, 400, 2)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    return docs, labels


def test_quality(spark, dice):
    docs, labels = corpus(spark, dice)
    found = quality.quality(docs, labels, F.col("source"), F.col("lang"), keep=("quality",)).collect()
    assert len(found) == docs.count()
    odd = [r for r in found if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 400]
    assert np.mean([r.kept == (r.doc_id % 7 != 0) for r in odd]) > 0.97


def test_quality_decisions_do_not_depend_on_the_kept_columns(spark, dice):
    docs, labels = corpus(spark, dice)
    plain = quality.quality(docs, labels, F.col("source"), F.col("lang")).select("doc_id", F.round("quality", 9).alias("q"))
    wide = quality.quality(docs, labels, F.col("source"), F.col("lang"), keep=("text",)).select("doc_id", F.round(F.col("quality"), 9).alias("q"))
    assert by_id(map(tuple, plain.collect())) == by_id(map(tuple, wide.collect()))


def test_quality_without_labels_or_documents(spark, dice):
    docs, labels = corpus(spark, dice)
    found = quality.quality(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(found) == docs.count() and all(r.evidence == 0 for r in found)
    assert quality.quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_the_levels_above(spark):
    rows = [("big", "a", 0.9)] * 500 + [("big", "b", 0.9)] * 500 + [("bad", "a", 0.1)] * 1000 + [("big", "c", 0.1)] + [("tiny", "a", 0.1)]
    sites = {(r.host, r.path): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    assert sites["big", "c"].host_rate > 0.85 and sites["bad", "a"].host_rate < 0.15
    assert 0.1 < sites["tiny", "a"].host_rate < 0.5


def brute_posteriors(rows, prior, threshold):
    """rows: (host, path, evidence). Rates of sites and posteriors in plain Python, level by level."""
    sigmoid, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    good = [sigmoid(e + logit(prior)) for _, _, e in rows]
    paths, hosts = {}, {}
    for (host, path, _), p in zip(rows, good):
        for table, key in ((paths, (host, path)), (hosts, host)):
            g, n = table.get(key, (0.0, 0))
            table[key] = (g + p, n + 1)

    def strength(rate, spread, noise):
        return min(max(rate * (1 - rate) / max(spread - noise, 1e-6) - 1, 1.0), 1e6)

    total = len(rows)
    overall = min(max(sum(g for g, _ in hosts.values()) / total, 1e-3), 1 - 1e-3)
    of_hosts = strength(overall, sum(n * (g / n - prior) ** 2 for g, n in hosts.values()) / total, sum(g / n * (1 - g / n) for g, n in hosts.values()) / total)
    rate = {h: (g + of_hosts * overall) / (n + of_hosts) for h, (g, n) in hosts.items()}
    of_paths = strength(overall, sum(n * (g / n - rate[h]) ** 2 for (h, _), (g, n) in paths.items()) / total, sum(g / n * (1 - g / n) for g, n in paths.values()) / total)
    out = []
    for (host, path, evidence), p in zip(rows, good):
        g, n = paths[host, path]
        site = min(max((g - p + of_paths * rate[host]) / (n - 1 + of_paths), 1e-6), 1 - 1e-6)
        posterior = sigmoid(evidence + logit(site))
        out.append((site, posterior, posterior >= threshold))
    return out


def test_posteriors_against_brute_force(spark, dice):
    docs, labels = corpus(spark, dice)
    found = quality.quality(docs, labels, F.col("source"), F.col("lang"), keep=("source", "lang")).collect()
    least = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()
    prior = min(max(sum(r.q > 0 for r in least) / len(least), 1e-3), 1 - 1e-3)
    wanted = brute_posteriors([(r.source, r.lang, r.evidence) for r in found], prior, quality.THRESHOLD)
    assert [(r.site_rate, r.quality) for r in found] == [pytest.approx(w[:2], abs=1e-9) for w in wanted]
    assert [r.kept for r in found] == [w[2] for w in wanted] and len({r.source for r in found}) > 1


def test_predictions_against_plain_softmax(spark, dice):
    """From the learned table alone: the mean of a text's subword rows, softmax, the best language."""
    docs = labelled(spark, dice)
    held_out = F.col("doc_id") % 5 == 0
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").alias("id"), "lang", "text")
    model = langid.train(*langid.labelled_sample(rows, langid.TRAIN_ROWS))
    ids = Counter(r.doc_id for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect() if ids[r.doc_id] == 1}
    found = [r for r in langid.language_id(docs, held_out).collect() if texts.get(r.doc_id) and langid.has_letter(texts[r.doc_id])]
    for r in found[:60]:
        counts = langid.subword_counts(texts[r.doc_id]).astype(float)
        logits = [float(sum(c * w for c, w in zip(counts[counts > 0] / counts.sum(), model.table[counts > 0, k]))) + float(model.bias[k]) for k in range(len(model.languages))]
        odds = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        best = max(range(len(odds)), key=odds.__getitem__)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(odds[best] / sum(odds), abs=1e-3)
    assert len(found) > 60


def levenshtein_inside(pattern, text):
    """Least distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return min(row)


def edited(dice, text, k):
    out = list(text)
    for _ in range(k):
        at = dice.randrange(len(out))
        kind = dice.random()
        if kind < 0.4:
            out[at] = dice.choice("abcdefgh ")
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, dice.choice("abcdefgh"))
    return "".join(out)


def test_matches_against_brute_force(spark, documents, dice):
    words = ["".join(dice.choices("abcdefgh", k=dice.randint(2, 8))) for _ in range(200)]
    items = [(i, " ".join(dice.choices(words, k=dice.choice([1, 3, 12, 25])))) for i in range(12)] + [(50, None), (51, ""), (52, "!!!")]
    rows = [(0, None), (1, ""), (None, items[0][1])]
    for doc in range(2, 60):
        _, text = dice.choice(items[:12])
        around = " ".join(dice.choices(words, k=6))
        rows.append((doc, f"{around} {edited(dice, text, dice.choice([0, 0, 1, 2, 5, 9]))}, {around}".upper() if doc % 2 else around))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    wanted = set()
    for doc, text in rows:
        whole = decontaminate.normalised(text or "")
        for item, body in items:
            pattern = decontaminate.normalised(body or "").strip()
            if pattern and (text or ""):
                pattern = f" {pattern} "
                k = decontaminate.error_budget(len(pattern))
                distance = levenshtein_inside(pattern, whole)
                if distance <= k:
                    wanted.add((doc, item, distance))
    for block in (40, 2_000_000):
        found = decontaminate.benchmark_matches(documents(rows), bench, block_size=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == wanted
    left = decontaminate.decontaminated(documents(rows), bench)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((d is None, d or 0) for d, t in rows if d not in {w[0] for w in wanted})
    assert "set" in left.columns and len(wanted) > 10


@pytest.mark.parametrize("letters", ["abcdefgh", "ab"])
def test_items_match_up_to_a_tenth_of_their_length(dice, letters):
    words = ["".join(dice.choices(letters, k=dice.randint(2, 8))) for _ in range(200)]
    body = lambda n: " ".join(dice.choices(words, k=n))[: n - 2].strip().ljust(n - 2, "a")
    items = [(at, f" {body(n)} ") for at, n in enumerate((9, 10, 20, 31, 47, 97, 200, 396))]
    matcher = decontaminate.Matcher([(at, text, decontaminate.error_budget(len(text))) for at, text in items])
    reached = set()
    for _ in range(12):
        for at, text in items:
            k = len(text) // 10
            whole = decontaminate.normalised(f"{body(40)} {edited(dice, text, dice.choice([k // 2, k, k, k + 1, k + 3]))} {body(40)}")
            near = {i: d for i, t in items if (d := levenshtein_inside(t, whole)) <= len(t) // 10}
            assert {m[0]: m[1] for m in matcher.matches(whole)} == near
            reached |= {at} if near.get(at, 0) > len(text) // 16 - 1 else set()
    assert reached >= {3, 4, 5, 6, 7}


def test_the_error_rate_is_what_is_allowed():
    assert [decontaminate.error_budget(n) for n in (9, 10, 20, 31, 97, 200, 396)] == [0, 1, 2, 3, 9, 20, 39]
    with pytest.raises(ValueError, match="error_rate"):
        decontaminate.error_budget(10, 1.0)


def test_matches_of_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.benchmark_matches(documents([]), bench).count() == 0
    assert decontaminate.benchmark_matches(documents([(1, "a b c")]), bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(documents([(1, "a b c")]), bench.limit(0)).count() == 1
