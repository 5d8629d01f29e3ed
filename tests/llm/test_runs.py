import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_helpers import by_id
from marginalia.llm import periodic_runs


def brute_runs(words):
    runs, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                runs.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in runs.items()), key=lambda r: (r[0], r[2]))


def found_in(texts):
    names = {}
    numbers = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
    return periodic_runs.runs_of(numbers, np.array([len(w) for w in texts], np.int64))


def repetitive(rng, letters, n):
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.4 and words:
            p = rng.randint(1, min(len(words), 40))
            words += (words[-p:] * rng.randint(1, 6))[: p * 6 - rng.randint(0, p)]
        elif kind < 0.7 and len(words) > 10:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 60)]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randint(1, 10))]
    return words


def test_runs_of_repetitive_documents():
    rng = random.Random(1)
    for _ in range(120):
        texts = [repetitive(rng, rng.choice([1, 2, 2, 3, 4, 8, 50]), rng.choice([0, 5, 20, 60, 150, 300])) for _ in range(rng.randint(1, 8))]
        assert found_in(texts) == [brute_runs(w) for w in texts]


@given(st.lists(st.lists(st.integers(0, 1), max_size=70), max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_over_two_letters(texts):
    assert found_in(texts) == [brute_runs(w) for w in texts]


def test_runs_of_sturmian_and_doubling_words():
    """Words with as many runs as words can have, and with long overlapping ones."""
    fibonacci, thue = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    texts = [fibonacci[-1], thue, [0] * 500, [*range(40)] * 9, [0] * 30 + [1] + [0] * 30 + [1] + [0] * 30]
    assert found_in(texts) == [brute_runs(w) for w in texts]


def test_longest_previous_factors():
    rng = random.Random(2)
    words = [rng.randrange(2) for _ in range(120)]
    n = len(words)
    levels = periodic_runs.Levels(np.array(words), np.zeros(n, np.int64), np.full(n, n))
    length, source = periodic_runs.longest_previous(levels)

    def common(i, j):
        k = 0
        while j + k < n and words[i + k] == words[j + k]:
            k += 1
        return k

    for j in range(n):
        assert length[j] == max((common(i, j) for i in range(j)), default=0)
        assert not length[j] or (source[j] < j and common(source[j], j) == length[j])


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_periodic_runs(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 90)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a b " * 30 + "é x\x1cy " * 20), (None, "so it goes on and " * 9), (204, "word " * 15_000), (7, rows[7][1])]
    rows += [(300 + i, rng.choice(["x\ny ", "ab cd ef "]) * rng.randint(3, 20)) for i in range(40)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    small = [r for r in rows if r[0] != 204]
    found = periodic_runs.periodic_runs(documents(rows), plant=True).collect()
    got = [tuple(r)[:8] for r in found]
    assert by_id(r for r in got if r[0] != 204) == by_id(expected(*r) for r in small)
    long = next(r for r in found if r.doc_id == 204)
    assert (long.n_runs, long.start, long.length, long.period, long.collapsed) == (1, 0, 15_000, 1, "word")
    assert all(len(r.runs) == r.n_runs for r in found)
    assert periodic_runs.periodic_runs(documents([])).collect() == []
