import math

import numpy as np
import pytest

from conftest_helpers import by_id
from marginalia.llm import near_vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, node string, cells string, x string"


def brute_links(rows, cosine=0.98):
    def usable(label, v):
        return label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, (_, a, label) in enumerate(rows):
        for j, (_, b, other) in enumerate(rows[:i]):
            if usable(label, a) and usable(other, b) and label == other and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[root(i)] = min(least.get(root(i), vec), vec)
    return by_id((vec, links[i], c := least.get(root(i)), vec == c) for i, (vec, _, _) in enumerate(rows))


def vectors():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((25, 16))
    rows = []
    for i in range(260):
        v = (centres[rng.integers(25)] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.1, 0.2])).astype(np.float32).tolist()
        rows.append((i if i % 40 else None, v, [1, 1, 1, 2, None][i % 5]))
    odd = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0], [2.0], [3e38] * 16, [1e-40] * 16, [-1.0] * 16]
    return [*rows, *rows[:9], *((900 + i, v, 1) for i, v in enumerate(odd))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("send", "block"), [(2_000, 2_048), (2_000, 16), (1, 2_048), (1, 8)])
def test_near_vectors(spark, monkeypatch, send, block):
    """Labels as wholes or in cells, cells as wholes or in blocks."""
    monkeypatch.setattr(near_vectors, "SEND", send)
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    assert (near_vectors.depth_and_repetitions(200)[0] > 0) == (send == 1)
    rows = vectors()
    found = near_vectors.near_vectors(frame(spark, rows)).collect()
    assert by_id((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == brute_links(rows)


def test_near_vectors_of_an_empty_table(spark):
    assert near_vectors.near_vectors(frame(spark, [])).collect() == []


def test_collisions_are_counted_as_defined(monkeypatch):
    monkeypatch.setattr(near_vectors, "EVENTS", 50)
    rng = np.random.default_rng(2)
    p, q = rng.standard_normal((40, 7)).round(1), rng.standard_normal((30, 7)).round(1)
    p[3] = p[4] = q[5]
    assert (near_vectors.collision_counts(p, q, 0.25) == (abs(p[:, None] - q[None]) <= 0.25).sum(axis=2)).all()
    assert (near_vectors.collision_counts(p, None, 0.25) == np.triu((abs(p[:, None] - p[None]) <= 0.25).sum(axis=2), 1)).all()


def test_recall_of_counts_and_cells():
    """Pairs at the least cosine, where a pair is missed most often."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60_000, 8))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1)[:, None]
    distance = math.sqrt(0.04)
    directions = rng.standard_normal((60, 8, near_vectors.PROJECTIONS))
    of = np.repeat(np.arange(60), 1_000)
    counts = (abs(np.einsum("nd,ndk->nk", a - b, directions[of])) <= near_vectors.WINDOW * distance).sum(axis=1)
    assert (counts >= near_vectors.least_count()).mean() > 0.9999
    for largest in (10**5, 10**9):
        depth, repetitions = near_vectors.depth_and_repetitions(largest)
        chance = near_vectors.in_cell(distance, near_vectors.CELL * distance) ** depth
        assert (1 - chance) ** repetitions < near_vectors.MISSED
        assert repetitions * largest * near_vectors.in_cell(math.sqrt(2), near_vectors.CELL * distance) ** depth < largest / 5


def brute_whitened(rows, components=32):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    mean = np.array([s / n for s in sums])
    centred = np.array(x, float) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return usable, n, deviations, centred @ axes / np.sqrt(values), values


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i if i % 11 else None, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5] + 40).tolist()) for i in range(300)]
    rows += [*rows[:5], (800, None), (801, []), (802, [None, *[1.0] * 5]), (803, [float("nan")] * 6), (804, [1.0] * 3)]
    found = whitening.whitened(frame(spark, [(i, v, 1) for i, v in rows]), components=4).collect()
    usable, n, deviations, scores, values = brute_whitened([r for r in rows if r[0] != 804])
    assert len(found) == 4 * len(usable) and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-9
    share = values / values.sum()
    assert all(abs(r.explained - share[r.component - 1]) < 1e-9 for r in found)
    assert by_id((r.vec_id, r.component, r.deviation) for r in found) == by_id((i, c, d) for (i, _), d in zip(usable, deviations) for c in (1, 2, 3, 4))
    once = {i: s for (i, _), s in zip(usable, scores) if i is not None}
    for component in (1, 2, 3, 4):  # one sign for all rows
        got = {r.vec_id: r.whitened for r in found if r.component == component and r.vec_id is not None}
        apart = [abs(np.array([sign * got[i] - once[i][component - 1] for i in once])).max() for sign in (1, -1)]
        assert min(apart) < 1e-9


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None, 1), (2, [float("inf")], 1)])).collect() == []
    same = whitening.whitened(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(c, 2, 0, None, None, None) for _ in range(2) for c in (1, 2)]
    flat = whitening.whitened(frame(spark, [(i, [float(i), 5.0], 1) for i in range(50)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    huge = whitening.whitened(frame(spark, [(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [0.0, 3.0], 1)])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id != 3} == {None}


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (500, 4)) + 10**6
    whole = whitening.Moments.of(x)
    for cuts in ([100, 101, 350], [1, 2, 3], [250]):
        parts = [whitening.Moments.of(p) for p in np.split(x, cuts)] + [whitening.NONE]
        rng.shuffle(parts)
        merged = whitening.NONE
        for p in parts:
            merged = merged.merged(p)
        assert merged.n == 500 and merged.sums == tuple(int(s) for s in x.sum(axis=0))
        assert np.allclose(merged.scatter, whole.scatter, rtol=1e-12)
    assert np.allclose(whole.scatter, np.cov((x - 10**6).T, bias=True) * 500, rtol=1e-12)
