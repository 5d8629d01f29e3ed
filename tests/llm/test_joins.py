import re

import numpy as np

from conftest_helpers import by_id
from marginalia.llm import jaccard, suffix_dedup
from marginalia.llm.rolling import gram_hashes, triggers


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and (common := len(a & b)) and 100 * common >= 75 * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return by_id((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows))


def near_copies(dice, n):
    words = [f"w{i}" for i in range(300)] + ["É", "the", "of"]
    base = [[dice.choice(words) for _ in range(dice.choice([2, 4, 6, 9, 14, 25, 40, 80, 160, 400]))] for _ in range(n // 10)]
    rows = []
    for i in range(n):
        text = list(dice.choice(base))
        for _ in range(int(len(text) * dice.choice([0, 0, 0.01, 0.02, 0.03, 0.05, 0.08])) + (dice.random() < 0.3)):
            text[dice.randrange(len(text))] = dice.choice(words)
        if dice.random() < 0.3:
            text += "licensed under the apache license version two".split()
        body = " ".join(text)
        rows.append((dice.choice([None] + [i] * 20), dice.choice([body, body.upper(), body.replace(" ", "\n"), None if i % 50 == 0 else body])))
    return [*rows, *rows[:7], (900, ""), (901, " \n")]


def test_components(documents, dice):
    rows = near_copies(dice, 250)
    found = jaccard.jaccard_components(documents(rows)).collect()
    assert by_id((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_families_larger_than_a_block(documents, dice, monkeypatch):
    """Blocks, sketches cut short and the limit on near sets of the first comparison change no result."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "NEAREST", (1, None))
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in dice.sample(range(60), dice.choice([1, 1, 2, 2, 3])):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    found = jaccard.jaccard_components(documents(rows)).collect()
    assert by_id((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_pairs_that_sketches_leave(dice, monkeypatch):
    """The same pairs as from every two sketches, from small buckets as from large ones."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([dice.choice([base, base[:300]])[int(rng.integers(0, 60)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(60)]
    words, size = [jaccard.shortened(jaccard.sketch(x)) for x in sets], np.array([len(x) for x in sets])
    root = np.unique(rng.integers(0, 8, 60), return_inverse=True)[1]
    buckets = [np.unique(rng.integers(0, 60, n)) for n in (2, 2, 3, 3, 5, 9, 20, 40, 60, 60)]
    wanted = set()
    for bucket in buckets:
        for i in bucket.tolist():
            for j in bucket.tolist():
                n = min(len(words[i]), len(words[j]))
                x, y = (np.bitwise_xor.reduce(words[k].reshape(-1, n), axis=0).view(np.uint64) for k in (i, j))
                odd = sum(int(w).bit_count() for w in x ^ y)
                near = min(size[i], size[j]) * 100 >= 75 * max(size[i], size[j])
                if i < j and root[i] != root[j] and near and 175 * odd <= 25 * (size[i] + size[j]):
                    wanted.add((i, j))
    length = np.array([len(x) for x in words])
    folded = jaccard._folded_words(np.concatenate(words).view(np.uint64), length)
    for small, at_once in ((64, 2_000_000), (4, 100), (0, 64)):
        monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", at_once)
        found = set()
        for a, b in jaccard._several_roots(buckets, root):
            a, b, _ = jaccard._left(a, b, size, folded, length)
            found |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
        assert found == wanted and wanted
    kept = jaccard._nearest(np.array([0, 0, 0, 1]), np.array([1, 2, 3, 3]), np.array([5, 1, 9, 2]), 1)
    assert kept.tolist() == [True, True, False, True]


def test_one_of_each(documents):
    rows = [(4, "a b c"), (2, "A b  c"), (9, "other words"), (None, "a b c"), (None, "alone"), (7, None)]
    left = jaccard.one_of_each(documents(rows))
    assert by_id((r.doc_id, r.text or '') for r in left.collect()) == by_id([(2, "A b  c"), (9, "other words"), (None, "alone"), (7, "")])
    assert jaccard.jaccard_components(documents([])).count() == 0


def test_similar_sets_share_signatures():
    """Of every two similar sets, what remains after the spare signatures are left out overlaps."""
    rng = np.random.default_rng(1)
    spare = {x.level: x.spare for x in (*jaccard.BANDS, jaccard.SINGLE)}
    few = 0
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 13, 14, 18, 19, 25, 30, 46, 47, 65, 84, 100, 210, 270, 500, 900):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            gone, new = (int(x) for x in rng.integers(0, size // 7 + 2, 2))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            keys, levels, numbers = jaccard.all_signatures([a, b])
            of_a, of_b = ({x: keys[(levels == x) & (numbers == i)] for x in set(levels[numbers == i].tolist())} for i in (0, 1))
            few += jaccard.SINGLE.level in of_a
            assert any(len(np.intersect1d(of_a[x], of_b[x])) > spare[x] for x in of_a.keys() & of_b.keys()), (len(a), len(b))
    assert few


def test_signatures_pack_and_meet():
    """What is let go early because it is frequent, and what waits to the end, gives each signature's sets."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    upper, level, name = rng.integers(0, 50, 6000), rng.integers(0, 70, 6000), rng.integers(0, 1 << 40, 6000)
    upper[:3000] = 7
    keys = upper.astype(np.uint64) << np.uint64(32)
    found = [x.tolist() for x in jaccard._unpacked(jaccard._packed(keys, level, name))]
    assert found == [upper.tolist(), level.tolist(), name.tolist()]
    batches = [jaccard.list_batch(jaccard._SENT, [{"part": 2, "kind": 0, "data": jaccard._packed(keys[i : i + 500], level[i : i + 500], name[i : i + 500])}]) for i in range(0, 6000, 500)]
    wanted = sorted((2 << 32 | k, n) for k, n in zip(upper.tolist(), name.tolist()))
    before = jaccard.HELD_SIGNATURES, jaccard.FREQUENT
    try:
        for held, frequent in ((10**6, 10**6), (700, 1000)):
            jaccard.HELD_SIGNATURES, jaccard.FREQUENT = held, frequent
            rows = [r for out in jaccard._met((pa.scalar(2),), iter(batches)) for r in out.to_pylist()]
            assert sorted((r["key"], r["name"]) for r in rows) == wanted
            counts = {r["key"] & 0xFFFFFFFF: r["count"] for r in rows}
            assert counts == {k: min(int((upper == k).sum()), frequent) for k in set(upper.tolist())}
    finally:
        jaccard.HELD_SIGNATURES, jaccard.FREQUENT = before


def test_names_that_two_sets_have(documents, dice, monkeypatch):
    monkeypatch.setattr(jaccard, "set_id", lambda features: (len(features) and int(features[0]) & 3, int(jaccard.mixed(features).sum().view(np.int64))))
    rows = near_copies(dice, 60)
    found = jaccard.jaccard_components(documents(rows)).collect()
    assert by_id((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 40, 300, 1000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        x, y = jaccard.sketch(np.unique(a)), jaccard.sketch(np.unique(b))
        size = min(len(x), len(y))
        x, y = (v if len(v) == size else v[:size] ^ v[size:] for v in (x, y))
        assert sum(int(z).bit_count() for z in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def brute_removed(rows):
    first, coded = {}, [(1 << 62 if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, data in coded:
        for at in range(len(data) - 49):
            first[data[at : at + 50]] = min(first.get(data[at : at + 50], doc), doc)
    out = []
    for doc, data in coded:
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            if first[data[at : at + 50]] < doc:
                gone[at : at + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((None if doc == 1 << 62 else doc, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return by_id(out)


def passages(dice):
    known = ["".join(dice.choices("ab é", k=dice.randint(30, 140))) for _ in range(12)] + ["a" * 120, "xy" * 60]

    def text():
        return "".join(dice.choice(known) if dice.random() < 0.6 else "".join(dice.choices("abcdefgh", k=20)) for _ in range(dice.randint(1, 8)))

    rows = [(dice.choice([None, *range(60)]), dice.choice([None, "", *(text() for _ in range(10))])) for _ in range(90)]
    return [*rows, *rows[:5]]


def test_suffix_dedup(documents, dice, monkeypatch):
    rows = passages(dice)
    for share, held in ((1e-4, 1 << 20), (1e-2, 2000), (1, 1500)):
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
        monkeypatch.setattr(suffix_dedup, "HELD_BYTES", held)
        found = suffix_dedup.suffix_dedup(documents(rows)).collect()
        assert by_id((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == brute_removed(rows)
    assert suffix_dedup.suffix_dedup(documents([])).count() == 0


def test_every_window_has_a_trigger():
    data = np.frombuffer(bytes(np.random.default_rng(3).integers(97, 101, 5000)), np.uint8)
    at, keys = triggers(data, 16, 50)
    assert (np.diff(at) <= 35).all() and at[0] <= 34 and at[-1] >= 5000 - 50
    assert (gram_hashes(data, 16)[at] == keys).all()


def test_triggers_of_long_texts_are_those_of_the_whole(monkeypatch):
    data = bytes(np.random.default_rng(4).integers(97, 123, 9000).astype(np.uint8))
    whole = list(suffix_dedup._pieces([data]))
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    parts = list(suffix_dedup._pieces([data]))
    assert np.array_equal(np.concatenate([p[1] for p in parts]), np.concatenate([w[1] for w in whole]))


def test_suffix_classes():
    data = b"x" * 10 + b"abcde" * 30 + b"q" + b"abcde" * 30
    order, classes = suffix_dedup.suffix_classes(np.frombuffer(data, np.uint8), np.arange(len(data) - 49))
    strings = [data[i : i + 50] for i in order]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:])] == (np.diff(classes) == 0).tolist()


def test_the_largest_id_and_rows_without_one(documents):
    """The largest id isn't taken for a missing one; both lose what a smaller id has."""
    passage = "passage of more than fifty bytes that several documents have in common with others"
    rows = [(1, passage), (2**63 - 1, passage), (None, f"{passage} and more of it")]
    found = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(documents(rows)).collect()}
    assert found == {1: 0, 2**63 - 1: len(passage), None: len(passage)}
