"""Runs: stretches of words that repeat with a period, found through the longest previous factors.

The documents of a batch are one array of words; ranks by prefix doubling (two words, four,
eight ...) give their suffix array, and the ranks of all levels tell how far two places
agree, to the right or to the left. That gives the array of common prefixes and, from the
nearest smaller neighbours in the suffix array, for each place the longest factor that also
begins before it (LPF), with the place where. LPF cuts a document into LZ blocks.

A run that touches the boundary of two blocks is found by extending from the boundary. Let
the run begin at s with period q. A block that begins q or more words after s copies the
word q before, so it goes on to the end of the run: at most one block begins there. If one
does, at b, the block before began less than q after s, and q is less than both lengths
together; the run is then where the words before b and those q earlier agree. Else the last
block that begins in the run's first period, at b, reaches the run's end, q is no more than
its length, and the run is where the words from b and those q later agree. A run inside a
block touches neither end and is a copy of one where the block's source lies; such runs are
taken over by their starts, block after block.

Documents in which no six words come twice have no run and go no further.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .grouped import run_starts

LEAST_LENGTH = 12
#: Words of a batch of documents, and pairs of places compared at once.
WORDS, PAIRS = 250_000, 1_000_000

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
)


class Levels:
    """Words of several documents with the ranks of all places by their next 1, 2, 4 ... words.

    Places of one document have equal ranks at level k if and only if the next 2^k words
    are equal; other places never have.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int | None = None):
        self.n, self.begin = len(words), begin
        rank, left = self._ranked(begin * (int(words.max()) + 1 if self.n else 1) + words, np.arange(self.n), np.zeros(self.n, np.int64))
        self.ranks = [rank]
        while len(left) and (most is None or len(self.ranks) <= most):
            after = left + (1 << (len(self.ranks) - 1))
            inside = after < end[left]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            rank, left = self._ranked(rank[left] * (self.n + 1) + second, left, rank)
            self.ranks.append(rank)
        self.left = left
        self.padded = [np.append(r, -1) for r in self.ranks]

    @staticmethod
    def _ranked(key: np.ndarray, places: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks with those of ``places`` told apart by key, and the places that still share theirs."""
        order = np.argsort(key, kind="stable")
        sorted_key, of = key[order], places[order]
        first = run_starts(sorted_key)
        size = np.diff(np.append(first, len(of)))
        old = before[of]
        group = run_starts(old)  # a rank is the number of places that sort before
        at = np.arange(len(of)) - np.repeat(group, np.diff(np.append(group, len(of))))
        rank = before.copy()
        rank[of] = np.repeat((old + at)[first], size)
        return rank, of[np.repeat(size > 1, size)]

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i and j on agree; i differs from j."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.padded) - 1, -1, -1):
            length += (self.padded[k][i + length] == self.padded[k][j + length]).astype(np.int64) << k
        return length

    def to_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before places i and j agree; j < i, places of one document or its end."""
        length = np.zeros(len(i), np.int64)
        first = self.begin[j]
        for k in range(len(self.padded) - 1, -1, -1):
            a, b = i - length - (1 << k), j - length - (1 << k)
            inside = b >= first
            length += (inside & (self.padded[k][np.where(inside, a, 0)] == self.padded[k][np.where(inside, b, 0)]) & (a != b)).astype(np.int64) << k
        return length


def longest_previous(levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest factor there that begins before it too, and where it does."""
    n = levels.n
    suffixes = np.empty(n, np.int64)
    suffixes[levels.ranks[-1]] = np.arange(n)
    common = np.zeros(n + 1, np.int64)
    if n > 1:
        common[1:n] = levels.right(suffixes[:-1], suffixes[1:])
    best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        agree = common[:-1].copy() if step < 0 else common[1:].copy()
        active = np.flatnonzero(agree > 0)
        while len(active := active[(agree[active] > 0) & (suffixes[to[active]] > suffixes[active])]):
            over = to[active]  # all suffixes passed so far begin later; those that it passed do too
            agree[active], to[active] = np.minimum(agree[active], agree[over]), to[over]
            active = active[(to[active] >= 0) & (to[active] < n)]
        better = agree > best[suffixes]
        better &= (to >= 0) & (to < n)
        best[suffixes[better]], source[suffixes[better]] = agree[better], suffixes[to[better]]
    return best, source


def blocks_of(longest: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """(start, length) of the LZ blocks of a document."""
    out, at = [], begin
    while at < end:
        out.append((at, max(1, longest[at])))
        at += out[-1][1]
    return out


def _spread(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``first``, each as often as ``number`` has it, with 1, 2 ... beside them."""
    return np.repeat(first, number), np.arange(1, number.sum() + 1) - np.repeat(np.cumsum(number) - number, number)


def at_boundaries(levels: Levels, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, end, period of the runs that touch a start or end of a block; ``ends`` has the documents' ends."""
    doc_begin = levels.begin[starts]
    before = np.where(starts > doc_begin, np.concatenate([[0], lengths[:-1]]), 0)
    last = np.flatnonzero(np.concatenate([doc_begin[1:] != doc_begin[:-1], [True]])) if len(starts) else np.zeros(0, np.int64)
    # boundaries: the block's start, and the document's end
    place = np.concatenate([starts, starts[last] + lengths[last]])
    ahead = np.concatenate([lengths, np.zeros(len(last), np.int64)])
    behind = np.concatenate([before, lengths[last]])
    begin, end = np.concatenate([doc_begin, doc_begin[last]]), np.concatenate([ends, ends[last]])
    found = []
    for forward in (True, False):
        number = np.minimum(ahead, np.maximum(end - place - 1, 0)) if forward else np.minimum(ahead + behind, place - begin)
        upto = np.cumsum(number)
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            at, period = _spread(place[a:b], number[a:b])
            late, early = (at + period, at) if forward else (at, at - period)
            s, e = early - levels.to_left(late, early), late + levels.right(late, early)
            ok = e - s >= np.maximum(LEAST_LENGTH, 2 * period)
            found.append(np.stack([s[ok], e[ok], period[ok]], axis=1))
            a = b
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)  # multiples of a run's period
    return runs[np.concatenate([[True], ~same])] if len(runs) else runs


def copied(blocks: list[tuple[int, int]], source: list[int], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All runs of a document: those at boundaries and, block by block, those inside the blocks' sources."""
    by_start: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in runs:
        by_start.setdefault(s, []).append((e, q))
    out = list(runs)
    for b, length in blocks:
        if length < LEAST_LENGTH + 2:
            continue
        src = source[b]
        for s in range(src + 1, src + length - LEAST_LENGTH):
            for e, q in by_start.get(s, ()):
                if e < src + length:
                    out.append((s + b - src, e + b - src, q))
                    by_start.setdefault(s + b - src, []).append((e + b - src, q))
    return out


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """start, length, period of the runs of each document, by start and period; words are numbers, documents lie one after the other."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    begin_of = np.cumsum(sizes) - sizes
    begin, end = np.repeat(begin_of, sizes), np.repeat(begin_of + sizes, sizes)
    short = Levels(words, begin, end, 2)  # up to four words
    four = np.append(short.ranks[-1], -1)
    left = short.left[short.left + 6 <= end[short.left]] if len(short.ranks) == 3 else short.left[:0]
    six = np.sort(four[left] * (len(words) + 1) + four[left + 2])
    twice = six[1:][six[1:] == six[:-1]] // (len(words) + 1)
    has = np.unique(np.searchsorted(begin_of + sizes, _places(short.ranks[-1], twice), side="right"))
    if not len(has):
        return out
    kept = np.zeros(len(sizes), bool)
    kept[has] = True
    words, sizes = words[np.repeat(kept, sizes)], sizes[kept]
    begin_of = np.cumsum(sizes) - sizes
    begin, end = np.repeat(begin_of, sizes), np.repeat(begin_of + sizes, sizes)
    levels = Levels(words, begin, end)
    longest, source = longest_previous(levels)
    longest, source = longest.tolist(), source.tolist()
    blocks = [blocks_of(longest, b, b + n) for b, n in zip(begin_of.tolist(), sizes.tolist())]
    starts, lengths = np.concatenate([np.array(of, np.int64) for of in blocks]).T
    touching = at_boundaries(levels, starts, lengths, end[starts])
    cuts = np.searchsorted(touching[:, 0], [*begin_of, len(words)])
    for of, doc, b, x, y in zip(blocks, has.tolist(), begin_of.tolist(), cuts[:-1], cuts[1:]):
        runs = copied(of, source, [tuple(r) for r in touching[x:y].tolist()])
        out[doc] = sorted(((s - b, e - s, q) for s, e, q in runs), key=lambda r: (r[0], r[2]))
    return out


def _places(rank: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A place for each of the ranks wanted."""
    at = np.zeros(len(rank) + 1, np.int64)
    at[rank] = np.arange(len(rank))
    return at[wanted]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a document's tail begins to repeat and with what period, as the contract has it for a tenth of the ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        s, length, q = np.array(runs).T
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, s + q, 1)
        np.add.at(inside, s + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]
    return b" ".join(words)


def _rows(ids: list[int | None], texts: list[list[bytes]], with_texts: bool) -> pa.RecordBatch:
    flat = [w for words in texts for w in words]
    numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    out = []
    for doc_id, words, runs in zip(ids, texts, runs_of(numbers, np.array([len(w) for w in texts], np.int64))):
        longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        collapsed = _collapsed(words, runs)
        shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
        row = (doc_id, len(runs), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        out.append((*row, [dict(zip(("start", "length", "period"), r)) for r in runs] if with_texts else None, collapsed.decode() if with_texts else None))
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
    names = [x.split()[0] for x in SCHEMA.replace("start: bigint, length: bigint, period: bigint", "").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False, with_texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run, digests of all runs and of the text without repeats, and these themselves.

    * Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with least period q, as
      long as max(12, 2 q) or longer, that no neighbour extends. Of runs of equal length the
      one with the least start, then period, is the longest. Words of a run after its first
      q are dropped from the text, whose others are joined by a space.
    * A null or empty text has no words and no run: null start, length, period and
      exponent_milli, digests of the empty string. Rows that repeat a doc_id and rows
      without one count on their own. An empty table gives an empty result. Other columns are not read.
    * Very long texts are taken whole, by one task each: some 200 bytes a word.
    * ``plant`` makes the tails of a tenth of all documents repeat, by their id; a row
      without an id keeps its words. Without ``with_texts`` the last two columns are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2_048):
            ids, texts, held = [], [], 0
            for number, body in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = body.as_buffer().to_pybytes().split()
                if plant and (tail := planted(number, len(words))):
                    a, p = tail
                    words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                ids.append(number)
                texts.append(words)
                held += len(words)
                if held > WORDS:
                    yield _rows(ids, texts, with_texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield _rows(ids, texts, with_texts)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)
