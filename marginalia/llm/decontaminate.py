"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``k`` edits. Cut into ``k + 1`` pieces, at
least one piece then occurs unchanged. An Aho-Corasick automaton over the pieces of all
items of a block finds such hits in one pass over the document. Pieces are short, so many
hit by chance: each hit is followed up a binary tree of the pieces. Of ``m`` pieces with
less than ``m`` edits, one half of the pieces has fewer edits than pieces as well, so an
occurrence has a piece all of whose ancestors lie within their budgets. What passes names a
window of the text, where Myers' bit-parallel algorithm computes the least edit distance
between the item and any part of the window. Items come in blocks of bounded size, one pass each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Edits allowed for each code point of a normalised item.
ERROR_RATE = 0.1
#: Bound of a block's items together, in code points.
BLOCK_SIZE = 2_000_000

#: Ancestors of hits whose answers are kept.
_ANSWERS = 100_000

_GAPS = re.compile(r"[\W_]+")
_matchers: dict[object, "Matcher"] = {}

MATCHES = "doc_id bigint, item_id bigint, distance int, start int, length int, item_length int"


def normalised(text: str) -> str:
    """Lower case; letters and digits alone, one space between words and at both ends."""
    return _GAPS.sub(" ", f" {text.lower()} ")


def error_budget(length: int, error_rate: float = ERROR_RATE) -> int:
    if not 0 <= error_rate < 1:
        raise ValueError(f"error_rate {error_rate} isn't from 0 to less than 1")
    return int(length * error_rate)


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(pattern) * i // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Above one piece or more: start and end in the pattern, edits allowed, the node above (None at the root).
Node = tuple[int, int, int, "Node | None"]


def nodes_above(cuts: list[int]) -> list[Node | None]:
    """The node above each piece, in a tree that halves the pieces; the root, the item itself, is left out."""
    out: list[Node | None] = []
    stack: list[tuple[int, int, Node | None]] = [(0, len(cuts) - 1, None)]
    while stack:
        low, high, above = stack.pop()
        if high - low == 1:
            out.append(above)
            continue
        node = (cuts[low], cuts[high], high - low - 1, above) if high - low < len(cuts) - 1 else None
        middle = (low + high) // 2
        stack += [(middle, high, node), (low, middle, node)]
    return out


class Pattern:
    """Myers' algorithm for one pattern: the masks of its characters in one integer each."""

    def __init__(self, text: str):
        self.length = len(text)
        self.full = (1 << self.length) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the nearest part of ``text``, the first of equals; None beyond ``most``."""
        full, last = self.full, 1 << (self.length - 1)
        plus, minus, score = full, 0, self.length
        found = None
        get = self.masks.get
        for at, c in enumerate(text):
            match = get(c, 0)
            vertical = match | minus
            horizontal = ((((match & plus) + plus) ^ plus) | match) & full
            up = (minus | ~(horizontal | plus)) & full
            down = plus & horizontal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
            up = (up << 1) & full
            down = (down << 1) & full
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical
            if score <= most:
                found, most = (score, at + 1), score - 1
                if score == 0:
                    break
        return found


    def holds(self, start: int, end: int, text: str, most: int) -> bool:
        """Whether some part of ``text`` is within ``most`` edits of the pattern from ``start`` to ``end``."""
        full, last = (1 << (end - start)) - 1, 1 << (end - start - 1)
        plus, minus, score = full, 0, end - start
        get = self.masks.get
        left = len(text)
        for c in text:
            match = (get(c, 0) >> start) & full
            vertical = match | minus
            horizontal = ((((match & plus) + plus) ^ plus) | match) & full
            up = (minus | ~(horizontal | plus)) & full
            down = plus & horizontal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
                if score <= most:
                    return True
            left -= 1
            if score - left > most:
                return False
            up = (up << 1) & full
            down = (down << 1) & full
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical
        return False


class Matcher:
    def __init__(self, items: list[tuple[int, str, int]]):
        """items: (id, normalised text, error budget)."""
        self.items = items
        self.forward = [Pattern(text) for _, text, _ in items]
        self.backward = [Pattern(text[::-1]) for _, text, _ in items]
        owners: dict[str, list[tuple[int, int, Node | None]]] = {}
        for at, (_, text, k) in enumerate(items):
            cut = pieces(text, k)
            for (offset, piece), above in zip(cut, nodes_above([*(a for a, _ in cut), len(text)])):
                owners.setdefault(piece, []).append((at, offset, above))
        self.automaton = ahocorasick.Automaton()
        for piece, found in owners.items():
            self.automaton.add_word(piece, (len(piece), found))
        if owners:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, start, length, item length): the nearest part for each item within its budget."""
        diagonals: dict[int, set[int]] = {}
        answers: dict[tuple[int, int, int, int], bool] = {}
        for end, (size, owners) in self.automaton.iter(text) if self.items else ():
            for at, offset, above in owners:
                start = end + 1 - size - offset
                if start not in diagonals.get(at, ()) and self._within(at, start, above, text, answers):
                    diagonals.setdefault(at, set()).add(start)
        out = []
        for at, found in sorted(diagonals.items()):
            name, pattern, k = self.items[at]
            best = None
            starts = sorted(found)
            first = 0
            for i, start in enumerate(starts):
                # hits that lie near each other share a window
                if i + 1 < len(starts) and starts[i + 1] - start <= k:
                    continue
                low, high = max(0, starts[first] - k), start + len(pattern) + k
                first = i + 1
                window = text[low:high]
                found = self.forward[at].best(window, k if best is None else best[0] - 1)
                if found:
                    distance, end = found
                    back = self.backward[at].best(window[:end][::-1], distance)
                    length = back[1] if back else end
                    best = (distance, low + end - length, length)
            if best:
                out.append((name, *best, len(pattern)))
        return out


    def _within(self, at: int, start: int, above: Node | None, text: str, answers: dict[tuple[int, int, int, int], bool]) -> bool:
        """Whether all nodes above a piece lie within their budgets in a text where the item would start at ``start``."""
        while above is not None:
            low, high, most, parent = above
            key = (at, start, low, high)
            if key not in answers:
                if len(answers) > _ANSWERS:
                    answers.clear()
                answers[key] = self.forward[at].holds(low, high, text[max(0, start + low - most) : max(0, start + high + most)], most)
            if not answers[key]:
                return False
            above = parent
        return True


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items)
        matcher = _matchers[key]
        types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
        for batch in small_batches(batches):
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matcher.matches(normalised(text))]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "item_id", "distance", "start", "length", "item_length"])

    return run


def item_blocks(benchmark: DataFrame, item_id: str, text: str, error_rate: float, block_size: int) -> Iterator[list[tuple[int, str, int]]]:
    """The items in blocks of ``block_size`` code points; each block alone is held."""
    block: list[tuple[int, str, int]] = []
    size = 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if pattern := normalised(row.text).strip():
            pattern = f" {pattern} "
            if block and size + len(pattern) > block_size:
                yield block
                block, size = [], 0
            block.append((row.item_id, pattern, error_budget(len(pattern), error_rate)))
            size += len(pattern)
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """One row per row of ``docs`` and item that it contains: doc_id, item_id, distance, start, length, item_length.

    * Item and document are compared as ``normalised``; ``start`` and ``length`` point into
      that form of the document. Of several places the nearest counts, then the first.
    * The error budget is ``error_rate`` of the length of the normalised item with a space
      at both ends, rounded down; items whose budget is none match unchanged, as words.
    * Very long texts are searched whole. Null or empty texts and items match nothing. Items that repeat an id with another
      text each count; rows that repeat a document repeat its matches. Empty tables give
      an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).where("text <> ''")
    found = []
    for at, items in enumerate(item_blocks(benchmark, item_id, item_text, error_rate, block_size)):
        # block_size bounds what is broadcast
        shared = spark.sparkContext.broadcast(((spark.sparkContext.applicationId, id(benchmark), at, hash(tuple(items))), items))
        found.append(rows.mapInArrow(_found(shared), MATCHES))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCHES)


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any match, with all their columns."""
    spark, own = docs.sparkSession, "_text"
    while own in docs.columns:
        own += "_"
    blocks = item_blocks(
        benchmark, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("error_rate", ERROR_RATE), options.get("block_size", BLOCK_SIZE)
    )
    for items in blocks:
        shared = spark.sparkContext.broadcast(((spark.sparkContext.applicationId, id(benchmark), hash(tuple(items))), items))
        docs = docs.withColumn(own, text_of(text)).mapInArrow(_clean(shared, own), docs.schema)
    return docs


def _clean(shared, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items)
        matcher = _matchers[key]
        for batch in small_batches(batches):
            keep = [not matcher.matches(normalised(x)) for x in batch.column(own).to_pylist()]
            names = [n for n in batch.schema.names if n != own]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run
