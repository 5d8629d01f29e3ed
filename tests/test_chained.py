import random
from datetime import UTC, datetime, timedelta

import pytest

from marginalia.operators import chained, state

START = datetime(2024, 1, 1, tzinfo=UTC)


def requests(rng, n, gap):
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0, gap / 4, gap, gap, gap * 2] + ([gap * 200] if i % 40 == 0 else []))
        rows.append((i, rng.choice([None, *"abcdefghij"]), START + timedelta(seconds=at), rng.random() < 0.2))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, client string, ts timestamp, failed boolean").repartition(3)


def folded(fold, rows):
    now_state, out = fold.empty(), {}
    for i, client, ts, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = fold.step(now_state, int((ts - START) / timedelta(microseconds=1)), client or "unknown", failed)
    return out


FOLDS = {
    "limit": chained.WindowLimit(3, 20_000_000),
    "limit of one": chained.WindowLimit(1, 7_000_000),
    "cache": chained.CappedCache(60_000_000, 4),
    "clients": chained.ClientLimit(2, 30_000_000, 5),
}


@pytest.mark.parametrize("name", FOLDS)
@pytest.mark.parametrize("gap", [1, 15])
def test_chunks_give_what_one_fold_gives(spark, monkeypatch, name, gap):
    monkeypatch.setattr(chained, "COMPARED", 2)
    rows = requests(random.Random(gap), 240, gap)
    failed = "failed" if name == "cache" else None
    wanted = folded(FOLDS[name], [(*r[:3], r[3] if failed else False) for r in rows])
    found = chained.chained(frame(spark, rows), FOLDS[name], "ts", "id", "out", "client", failed, chunk_rows=30)
    assert {r.id: r.out for r in found.collect()} == wanted
    assert len(set(wanted.values())) == 2 or (name, gap) == ("clients", 15)


def test_empty_and_single_rows(spark):
    none = frame(spark, []).where("false")
    assert state.globally_limited(none, "ts", "id", 1).collect() == []
    one = frame(spark, [(1, None, None, False)])
    assert [r.hit for r in state.capped_cache_hits(one, "client", "ts", "id").collect()] == [False]


def test_an_evicted_key_is_a_miss_and_a_reset_client_passes(spark):
    rows = [(i, c, START + timedelta(seconds=i), False) for i, c in enumerate("abcab")]
    hits = state.capped_cache_hits(frame(spark, rows), "client", "ts", "id", cap=2)
    assert [r.hit for r in hits.orderBy("id").collect()] == [False] * 5
    assert [r.hit for r in state.cache_hits(frame(spark, rows), "client", "ts", "id").orderBy("id").collect()] == [False] * 3 + [True] * 2
    found = state.rate_limited_with_reset(frame(spark, rows), "client", "ts", "id", 1, cap=2)
    assert [r.rejected for r in found.orderBy("id").collect()] == [False] * 5
    again = [(i, c, START + timedelta(seconds=i), False) for i, c in enumerate("abba")]
    kept = state.rate_limited_with_reset(frame(spark, again), "client", "ts", "id", 1, cap=2)
    assert [r.rejected for r in kept.orderBy("id").collect()] == [False, False, True, True]


def test_a_guard_chain_limits_all_clients_together(spark):
    rows = [(i, f"c{i % 7}", START + timedelta(seconds=i), "POST" if i % 5 else "GET", "https://own.example" if i % 4 else None) for i in range(60)]
    given = spark.createDataFrame(rows, "id bigint, client string, ts timestamp, method string, origin string").selectExpr("*", "string(null) AS referer")
    allowed = spark.createDataFrame([("https://own.example/",), (None,)], "origin string")
    found = {r.id: r.outcome for r in state.guard_chain(given, allowed, "client", "ts", "id", 1, 4, 20).collect()}
    wanted, clients, passed = {}, {}, []
    for i, client, ts, method, origin in rows:
        if method != "POST":
            wanted[i] = "method_not_allowed"
        elif origin is None:
            wanted[i] = "forbidden"
        elif any(ts - t < timedelta(seconds=20) for t in clients.get(client, [])):
            wanted[i] = "client_limited"
        else:
            clients.setdefault(client, []).append(ts)
            if sum(ts - t < timedelta(seconds=20) for t in passed) >= 4:
                wanted[i] = "globally_limited"
            else:
                passed.append(ts)
                wanted[i] = "passed"
    assert found == wanted and len(set(wanted.values())) == 5


def test_a_state_that_never_forgets_folds_no_chunk_more_often_than_others(spark, monkeypatch, tmp_path):
    """As many rounds as chunks, but each over a chunk or two: before, all later chunks were folded again in each."""

    class EverySeventh:
        """Its state never forgets: two that differ once differ for ever."""

        def empty(self):
            return [0]

        def step(self, state, now, key, failed):
            state[0] = (state[0] + 1) % 7
            return state[0] == 0

        def normal(self, state, now):
            return list(state)

        def restored(self, normal):
            return list(normal)

        def reach(self):
            return None

    monkeypatch.setattr(chained, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = [(i, "a", START + timedelta(seconds=i), False) for i in range(100)]
    found = chained.chained(frame(spark, rows), EverySeventh(), "ts", "id", "out", chunk_rows=10)
    assert {r.id: r.out for r in found.collect()} == {i: i % 7 == 6 for i in range(100)}
    chunks = len(list(tmp_path.glob(f"chained-*/_round={chained.PLACED}/_chunk=*")))
    folds = len(list(tmp_path.glob("chained-*/_round=*/_chunk=*"))) - chunks
    assert chunks >= 8 and folds <= (chained.SPECULATED + 2) * chunks
