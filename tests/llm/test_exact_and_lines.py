import hashlib
import re

import pytest

from conftest_helpers import by_id

from marginalia.llm import exact_dedup, line_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (7, None), (5, ""), (5, ""), (9, " "), (8, "é b"), (4, "x" * 50_000), (6, "x" * 50_000)] + [(i, "hot") for i in range(20, 60)]


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(normal(text), []).append(doc)
    out = []
    for doc, text in rows:
        members = groups[normal(text)]
        keep = min((d for d in members if d is not None), default=None)
        out.append((doc, keep, len(members), doc == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return by_id(out)


def test_exact_dedup(documents):
    for support in (0.001, 0.2, 0.9):  # with all, one and no digest as a heavy hitter
        found = exact_dedup.exact_dedup(documents(ROWS), support=support)
        assert by_id((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()) == expected(ROWS)


def test_exact_dedup_empty_and_survivors(documents):
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    left = exact_dedup.without_copies(documents(ROWS))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5, 5, 8, 9, 20]


@pytest.mark.parametrize("first", [True, False])
def test_a_hot_digest_is_a_heavy_hitter(spark, first):
    """A third of each partition's rows has it, all before the others or spread among them."""
    hot = "id % 20000 < 6666" if first else "id % 3 = 0"
    rows = spark.range(0, 60_000, 1, 3).selectExpr("id AS doc_id", f"unhex(sha2(IF({hot}, 'hot', CAST(id AS STRING)), 256)) AS digest")
    found = exact_dedup.heavy_hitters(rows).collect()
    count = 3 * 6666 if first else 20_000
    assert [(bytes(r.digest), r.keep_id, r.group_size) for r in found] == [(hashlib.sha256(b"hot").digest(), 0, count)]


def brute_lines(rows, min_docs):
    seen = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line.encode())
            if key:
                seen.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(seen.get(line_dedup.line_key(x.encode()), ())) < min_docs]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return by_id(out)


def test_line_dedup(documents, dice):
    lines = ["Shared line", " shared LINE\t", "É", "é", "", "  ", "\x0b\x0c", "two", "three"] + [f"own {i}" for i in range(30)]
    rows = [(dice.choice([None, *range(40)]), dice.choice([None, "", "\n".join(dice.choices(lines, k=dice.randint(1, 8)))])) for _ in range(80)]
    rows += rows[:5]
    for min_docs, batches in ((3, 4), (10, 3), (1, 1)):
        found = line_dedup.line_dedup(documents(rows), min_docs=min_docs, batches=batches)
        assert by_id((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in found.collect()) == brute_lines(rows, min_docs)
    assert line_dedup.line_dedup(documents([])).count() == 0


def test_line_dedup_keeps_columns(documents):
    found = line_dedup.line_dedup(documents([(1, "a")]), keep=("part", "kept")).first()
    assert (found.part, found.kept, found.kept_text) == ("x", "x", "a")


def test_lines_of_rows_without_an_id_and_of_id_minus_one(documents):
    """They are two documents, so a line in eight others and both is in ten."""
    rows = [(i, f"shared\nown {i}") for i in [*range(1, 9), -1, None]]
    found = line_dedup.line_dedup(documents(rows)).collect()
    assert by_id((r.doc_id, r.n_dropped, r.kept_text) for r in found) == by_id((d, 1, f"own {d}") for d, _ in rows)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_frequent_keys_by_broadcast_or_shuffle(documents, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    rows = [(i, f"a\n{i}\nB \n{'x' * 70_000 if i == 3 else ''}") for i in range(12)]
    assert by_id((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(documents(rows)).collect()) == by_id((i, 4, 2) for i, _ in rows)
