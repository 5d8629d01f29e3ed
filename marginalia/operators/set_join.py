"""Pairs of texts with similar sets of bigrams.

A dictionary of the most frequent bigrams orders all bigrams, rare ones first; those that it
doesn't hold come before those that it does, in hash order. Two sets with a Dice score of t
or more have one of their first n - ceil(n t / (2 - t)) + 1 bigrams in common, n being their
size, so sets meet by these alone. What meets is compared by size, then by the place of the
common bigram in both (what can still follow it bounds the overlap), then by counts of the
bigrams between fixed pivots (the suffix filter, all pivots at once), and last by the sets.

A side that is small enough goes to every task as one index; where it is smaller still, all
overlaps with a block of sets are one matrix product, which takes less time. Otherwise sets travel by
their first bigrams, and a pair is compared only where its first common one is. A bigram
whose sets are many all the same is dealt in blocks, two of which meet in a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import distinct_sorted, folded
from marginalia.storage import kept

#: Entries of the dictionary at most, and bigrams of the side that goes to every task.
DICTIONARY, INDEX_GRAMS = 1 << 16, 4_000_000
#: Meetings looked at together, sets of a block, sets of a group.
AT_ONCE, BLOCK, GROUP = 1_000_000, 2_000, 20_000
PIVOTS = 64
#: Right sets times their bigrams up to which all overlaps are counted, and cells of a block's matrix.
PRODUCT, CELLS = 1 << 23, 1 << 22
_LONE = 1 << 42
_MASK = (1 << 62) - 1


def grams_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct bigrams of folded texts as numbers; a single character is its own."""
    out = []
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        out.append(points | _LONE if len(points) == 1 else np.unique(points[:-1] << 21 | points[1:]))
    return out


def grams_of_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``grams_of``, laid out together: bigrams, the texts that have them, and how many each text has."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    last = np.append(of[1:] != of[:-1], True)[: len(of)]
    grams = points << 21 | np.append(points[1:], 0)[: len(points)]
    grams[last] = points[last] | _LONE
    coded = distinct_sorted((of << 43 | grams)[~last | (size[of] == 1)])
    of = coded >> 43
    return coded & ((1 << 43) - 1), of, np.bincount(of, minlength=len(texts))


class Order:
    """Ranks of bigrams: those outside the dictionary by a hash, below zero, then the dictionary's, the rarest first."""

    def __init__(self, frequent: list[int]):
        """frequent: the dictionary, the most frequent first."""
        grams = np.array(frequent, np.int64)
        self.order = np.argsort(grams)
        self.grams, self.rank = grams[self.order], (len(grams) - 1 - self.order).astype(np.int64)

    def ranked(self, grams: np.ndarray) -> np.ndarray:
        out = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(_MASK)).astype(np.int64) - (1 << 62)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            known = self.grams[at] == grams
            out[known] = self.rank[at[known]]
        return out

    def pivots(self) -> np.ndarray:
        """Ranks between which bigrams are counted."""
        return np.unique(np.linspace(0, len(self.grams), PIVOTS).astype(np.int64))


def prefix_length(n: np.ndarray, score: float) -> np.ndarray:
    return n - np.ceil(n * (score / (2 - score)) - 1e-9).astype(np.int64) + 1


class Sets:
    """Sets of ranks, each in ascending order."""

    def __init__(self, sets: list[np.ndarray], pivots: np.ndarray):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.zeros(0, np.int64), *sets])
        cell = np.searchsorted(pivots, self.flat, side="right")
        of = np.repeat(np.arange(len(sets)), self.size)
        self.counts = np.bincount(of * (len(pivots) + 1) + cell, minlength=len(sets) * (len(pivots) + 1)).reshape(len(sets), len(pivots) + 1).astype(np.int16)
        self.own = of

    def firsts(self, score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rank, set and place of the bigrams by which sets meet."""
        number = np.minimum(prefix_length(self.size, score), self.size)
        of = np.repeat(np.arange(len(self.size)), number)
        place = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        return self.flat[self.begin[of] + place], of, place


def _least_overlap(a: np.ndarray, b: np.ndarray, score: float) -> np.ndarray:
    return np.ceil((a + b) * (score / 2) - 1e-9).astype(np.int64)


def _overlaps(left: Sets, right: Sets, i: np.ndarray, j: np.ndarray, universe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ranks sets i and j have in common, and the first of them; universe: all ranks of the right sets, ascending."""
    width = len(universe) + 1
    key = right.own * width + np.searchsorted(universe, right.flat)  # ascending: sets in order, ranks in order
    size = left.size[i]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left.begin[i], size)
    value = left.flat[at]
    where = np.searchsorted(universe, value)
    known = (where < len(universe)) & (universe[np.minimum(where, len(universe) - 1)] == value)
    sought = np.repeat(j, size) * width + where
    found = np.minimum(np.searchsorted(key, sought), len(key) - 1)
    hit = known & (key[found] == sought)
    of = np.repeat(np.arange(len(i)), size)
    first = np.full(len(i), np.iinfo(np.int64).max)
    np.minimum.at(first, of[hit], value[hit])
    return np.bincount(of[hit], minlength=len(i)), first


class Meeting:
    """Right sets, found by the bigrams with which they are listed."""

    def __init__(self, right: Sets, rank: np.ndarray, of: np.ndarray, place: np.ndarray, score: float):
        order = np.lexsort((right.size[of], rank))
        self.right, self.rank, self.of, self.place, self.score = right, rank[order], of[order], place[order], score
        self.universe = np.unique(right.flat)
        self.compared = 0

    def links(self, left: Sets, rank: np.ndarray, of: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, overlap) of the left sets, listed by some bigrams, that are similar to right ones and whose first common bigram is listed."""
        begin, end = np.searchsorted(self.rank, rank), np.searchsorted(self.rank, rank, side="right")
        some = end > begin
        rank, of, place, begin, number = rank[some], of[some], place[some], begin[some], (end - begin)[some]
        order = np.argsort(of, kind="stable")
        rank, of, place, begin, number = (x[order] for x in (rank, of, place, begin, number))
        upto = np.cumsum(number)
        cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
        a = 0
        while a < len(cuts) - 1:  # all of a left set's meetings together
            before = upto[cuts[a] - 1] if cuts[a] else 0
            b = max(a + 1, int(np.searchsorted(upto[cuts[1:] - 1], before + AT_ONCE, side="right")))
            yield self._some(left, *(x[cuts[a] : cuts[b]] for x in (rank, of, place, begin, number)))
            a = b

    def _some(self, left: Sets, rank, of, place, begin, number) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(begin, number)
        i, j, by = np.repeat(of, number), self.of[met], np.repeat(rank, number)
        m, n = left.size[i], self.right.size[j]
        least = _least_overlap(m, n, self.score)
        rest = 1 + np.minimum(m - np.repeat(place, number) - 1, n - self.place[met] - 1)
        near = (np.minimum(m, n) >= least) & (rest >= least)
        i, j, by, least = i[near], j[near], by[near], least[near]
        code, first, inverse = np.unique(i * len(self.right.size) + j, return_index=True, return_inverse=True)
        lowest = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(lowest, inverse, by)
        i, j, least = i[first], j[first], least[first]
        step, kept_rows = max(1, AT_ONCE // 64), []
        for at in range(0, len(i), step):
            bound = np.minimum(left.counts[i[at : at + step]], self.right.counts[j[at : at + step]]).sum(axis=1)
            kept_rows.append(at + np.flatnonzero(bound >= least[at : at + step]))
        of_bound = np.concatenate([np.zeros(0, np.int64), *kept_rows])
        i, j, least, lowest = i[of_bound], j[of_bound], least[of_bound], lowest[of_bound]
        self.compared += len(i)
        if not len(i):
            return i, j, least
        common, first_common = (np.concatenate(x) for x in zip(*(_overlaps(left, self.right, i[at : at + step], j[at : at + step], self.universe) for at in range(0, len(i), step))))
        similar = (common >= least) & (first_common == lowest)
        return i[similar], j[similar], common[similar]


def _column(table: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
    values = table.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat, size = values.flatten().to_numpy(), values.value_lengths().to_numpy()
    return np.split(flat, np.cumsum(size)[:-1]) if len(size) else []


_PAIRS = "l_high bigint, l_low bigint, r_high bigint, r_low bigint, dice double"


def _pairs(found, left_keys, right_keys, left: Sets, right: Sets) -> pa.Table:
    i, j, common = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    score = 2.0 * common / np.maximum(left.size[i] + right.size[j], 1)
    columns = [*(k[i] for k in left_keys), *(k[j] for k in right_keys), score]
    return pa.table([pa.array(c) for c in columns], [x.split()[0] for x in _PAIRS.split(", ")])


def _by_index(right_keys: tuple[np.ndarray, np.ndarray], right_sets: list[np.ndarray], frequent: list[int], score: float):
    """Pairs of a task's sets with those of an index that every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(frequent)
        pivots = order.pivots()
        right = Sets([np.sort(order.ranked(s)) for s in right_sets], pivots)
        meeting = Meeting(right, *right.firsts(score), score)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                left = Sets([np.sort(order.ranked(s)) for s in _column(piece, "grams")], pivots)
                keys = tuple(piece.column(n).to_numpy() for n in ("high", "low"))
                yield from _pairs(list(meeting.links(left, *left.firsts(score))), keys, right_keys, left, right).to_batches()

    return run


def _by_product(right_keys: tuple[np.ndarray, np.ndarray], right_sets: list[np.ndarray], score: float):
    """Names of a task's texts with those of the right sets, of which all overlaps are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.array([len(s) for s in right_sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *right_sets])
        universe, place = np.unique(flat, return_inverse=True)
        right = np.zeros((len(universe), len(number)), np.float32)
        right[place, np.repeat(np.arange(len(number)), number)] = 1
        about = (number * (score / 2) - 0.5).astype(np.float32)  # singles may err by less; what passes is judged in doubles
        step = max(1, min(BLOCK, CELLS // max(1, len(universe), len(number))))
        for batch in batches:
            for at in range(0, batch.num_rows if len(universe) else 0, step):
                piece = batch.slice(at, step)
                texts = piece.column("text").dictionary_encode()
                grams, of, size = grams_of_block(texts.dictionary.to_pylist())
                where = np.minimum(np.searchsorted(universe, grams), len(universe) - 1)
                known = universe[where] == grams
                left = np.zeros((len(size), len(universe)), np.float32)
                left[of[known], where[known]] = 1
                common = left @ right
                i, j = np.nonzero(common >= (size.astype(np.float32) * np.float32(score / 2))[:, None] + about)
                similar = (size[i] > 0) & (common[i, j] >= (size[i] + number[j]) * (score / 2) - 1e-9)
                i, j = i[similar], j[similar]
                rows, row_text = np.arange(piece.num_rows), texts.indices.to_numpy()
                order = np.argsort(row_text, kind="stable")
                begin, end = np.searchsorted(row_text[order], i), np.searchsorted(row_text[order], i, side="right")
                times = end - begin
                met = rows[order][np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)]
                columns = [piece.column("id").take(pa.array(met)), *(pa.array(np.repeat(k[j], times)) for k in right_keys)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "r_high", "r_low"])

    return run


def _listed(frequent: list[int], score: float):
    """Sets once for each bigram by which they meet: rank, place, ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(frequent)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                sets = Sets([np.sort(order.ranked(s)) for s in _column(piece, "grams")], np.zeros(0, np.int64))
                rank, of, place = sets.firsts(score)
                ranks = pa.ListArray.from_arrays(pa.array(np.append(sets.begin, len(sets.flat)).astype(np.int32)), pa.array(sets.flat))
                columns = [*(piece.column(n).take(pa.array(of)) for n in ("high", "low")), pa.array(rank), pa.array(place.astype(np.int32)), ranks.take(pa.array(of))]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "rank", "place", "ranks"])

    return run


def _of_groups(frequent: list[int], score: float):
    def run(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        pivots = Order(frequent).pivots()
        sides = []
        for rows in (left_rows, right_rows):
            codes = np.stack([rows.column(n).to_numpy() for n in ("high", "low")], axis=1)
            _, first, of = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            sets = _column(rows, "ranks")
            cell = rows.column("l_block").to_numpy().astype(np.int64) << 32 | rows.column("r_block").to_numpy().astype(np.int64)
            sides.append((Sets([sets[x] for x in first], pivots), tuple(codes[first].T), rows.column("rank").to_numpy(), of.ravel(), rows.column("place").to_numpy().astype(np.int64), cell))
        (left, left_keys, l_rank, l_of, l_place, l_cell), (right, right_keys, r_rank, r_of, r_place, r_cell) = sides
        found = []
        for cell in np.intersect1d(l_cell, r_cell):
            a, b = l_cell == cell, r_cell == cell
            found += Meeting(right, r_rank[b], r_of[b], r_place[b], score).links(left, l_rank[a], l_of[a], l_place[a])
        return _pairs(found, left_keys, right_keys, left, right)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task have each bigram."""
    for batch in batches:
        grams, number = np.unique(batch.column("grams").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(number.astype(np.int64))], ["gram", "n"])


def gram_sets(texts: DataFrame, name: str) -> DataFrame:
    """high, low, grams of the distinct folded texts (text); those without a character are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array(grams_of(batch.column("text").to_pylist()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("high"), batch.column("low"), grams], ["high", "low", "grams"])

    distinct = texts.where("text <> ''").select("high", "low", "text").dropDuplicates(["high", "low"])
    return kept(distinct.mapInArrow(run, "high bigint, low bigint, grams array<bigint>"), name)


def with_key(rows: DataFrame, text: str, high: str = "high", low: str = "low") -> DataFrame:
    """Adds the 128-bit name of a folded text."""
    return rows.withColumns({high: F.xxhash64(text), low: F.xxhash64(F.lit("low"), text)})


def fits_index(right: DataFrame, index_grams: int = INDEX_GRAMS) -> bool:
    return (right.agg(F.sum(F.size("grams").cast("bigint"))).first()[0] or 0) <= index_grams


def similar_to_index(left: DataFrame, right: DataFrame, score: float, product: int = PRODUCT) -> DataFrame:
    """id, r_high, r_low: texts (id, text) with the sets (high, low, grams) that have a Dice score of ``score`` or more with theirs.

    The right side goes to all tasks. Where it has more sets and bigrams than ``product``
    allows, equal texts meet it once and by their first bigrams.
    """
    left = left.where("text <> ''")
    index = right.toArrow()
    keys, sets = tuple(index.column(n).to_numpy() for n in ("high", "low")), _column(index, "grams")
    if len(sets) * len(np.unique(np.concatenate([np.zeros(0, np.int64), *sets]))) <= product:
        id_type = left.schema["id"].dataType.simpleString()
        return left.select("id", "text").mapInArrow(_by_product(keys, sets, score), f"id {id_type}, r_high bigint, r_low bigint")
    keyed = kept(with_key(left.select("id", "text"), "text"), "titles")
    pairs = similar_sets(gram_sets(keyed, "sets"), right, score).withColumnsRenamed({"l_high": "high", "l_low": "low"})
    return keyed.select("id", "high", "low").join(pairs, ["high", "low"]).select("id", "r_high", "r_low")


def similar_sets(left: DataFrame, right: DataFrame, score: float, index_grams: int = INDEX_GRAMS) -> DataFrame:
    """l_high, l_low, r_high, r_low, dice: pairs of sets (high, low, grams) with a Dice score of ``score`` or more.

    Every pair is found, whatever the dictionary holds; sets without bigrams are similar to
    nothing. The right side goes to all tasks where it has ``index_grams`` bigrams at most.
    """
    counts = left.select("grams").unionByName(right.select("grams")).mapInArrow(_counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = [r.gram for r in counts.where("n > 1").orderBy(F.desc("n"), "gram").limit(DICTIONARY).collect()]
    if fits_index(right, index_grams):
        index = right.toArrow()
        keys = tuple(index.column(n).to_numpy() for n in ("high", "low"))
        return left.mapInArrow(_by_index(keys, _column(index, "grams"), frequent, score), _PAIRS)
    listed = [kept(side.mapInArrow(_listed(frequent, score), "high bigint, low bigint, rank bigint, place int, ranks array<bigint>"), name) for side, name in ((left, "left"), (right, "right"))]
    blocks = [side.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)) for side, n in zip(listed, ("l_blocks", "r_blocks"))]
    grids = kept(blocks[0].join(blocks[1], "rank"), "grids")
    groups = max(1, math.ceil(sum(side.count() for side in listed) / GROUP))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(grids, "rank").withColumn(f"{own}_block", F.pmod(F.xxhash64("high", "low"), F.col(f"{own}_blocks")).cast("int"))
        rows = rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return rows.withColumn("group", F.pmod(F.xxhash64("rank", "l_block", "r_block"), F.lit(groups))).select("group", "high", "low", "rank", "place", "ranks", "l_block", "r_block")

    return dealt(listed[0], "l", "r").groupBy("group").cogroup(dealt(listed[1], "r", "l").groupBy("group")).applyInArrow(_of_groups(frequent, score), _PAIRS)


def similar_texts(left: DataFrame, text: str, right: DataFrame, item: str, score: float, index_grams: int = INDEX_GRAMS) -> DataFrame:
    """left without ``text`` with right without ``item``, where their folded texts have a Dice score of ``score`` or more, and ``dice``.

    Texts are folded once and equal ones compared once; rows that repeat come as often as
    they do. Null texts and those without a character match nothing. Names of columns must
    differ between the sides.
    """
    own, other = [c for c in left.columns if c != text], [c for c in right.columns if c != item]
    l_rows = kept(with_key(left.withColumn("text", folded(F.col(text))).select(*own, "text"), "text", "l_high", "l_low"), "rows")
    r_rows = kept(with_key(right.withColumn("text", folded(F.col(item))).select(*other, "text"), "text", "r_high", "r_low"), "items")
    l_sets = gram_sets(l_rows.withColumnsRenamed({"l_high": "high", "l_low": "low"}), "sets")
    r_sets = gram_sets(r_rows.withColumnsRenamed({"r_high": "high", "r_low": "low"}), "sets")
    pairs = kept(similar_sets(l_sets, r_sets, score, index_grams), "pairs")
    return l_rows.join(pairs, ["l_high", "l_low"]).join(r_rows.select(*other, "r_high", "r_low"), ["r_high", "r_low"]).select(*own, *other, "dice")


def _cuts(shorter: DataFrame, longer: DataFrame, least: int) -> DataFrame:
    """l_id, cut: beginnings of the longer texts, as long as those shorter ones that share their first ``least`` code points."""
    start = F.left("text", F.lit(least)).alias("start")
    lengths = shorter.groupBy(start).agg(F.collect_set(F.length("text")).alias("lengths"))  # as many as the longest title has characters, at most
    cuts = longer.select("id", "text", start).join(lengths, "start").select("id", "text", F.explode(F.filter("lengths", lambda n: n <= F.length("text"))).alias("n"))
    return cuts.select(F.col("id").alias("l_id"), F.left("text", F.col("n")).alias("cut"))


def begins(shorter: DataFrame, longer: DataFrame, least: int) -> DataFrame:
    """s_id, l_id: texts (id, text) of ``least`` code points or more with those that begin with them.

    Beginnings of a longer text are looked up among the whole shorter ones, so only pairs
    that are wanted meet, however many texts begin alike; no beginning is made that no
    shorter text can be.
    """
    shorter, longer = shorter.where(F.length("text") >= least), longer.where(F.length("text") >= least)
    whole = shorter.select(F.col("id").alias("s_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit("low"), "text").alias("l"))
    keyed = _cuts(shorter, longer, least).select("l_id", F.xxhash64("cut").alias("h"), F.xxhash64(F.lit("low"), "cut").alias("l"))
    return whole.join(keyed, ["h", "l"]).select("s_id", "l_id")
