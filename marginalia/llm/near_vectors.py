"""Near duplicates among embeddings by counting collisions of one-dimensional projections.

Unit vectors of a label are projected on ``PROJECTIONS`` random directions. Each projection
is sorted; round every vector lies a window of 1.5 times the distance that the least cosine
allows, and whatever falls into it collides with the vector. Differences of two vectors'
projections are normal with their distance as deviation, so the collisions of a pair are
binomial. A pair at the greatest distance that counts reaches ``least_count`` collisions but
for one case in two million; pairs that reach it are verified by their cosine.

All pairs of a label would meet in one window or another of a very large label, so labels
beyond some tens of thousands are first cut into cells of ``depth`` further projections,
``repetitions`` times with other directions. Both numbers follow from the size of the
largest label: they minimise the work, and a pair that counts lies in no common cell but for
one case in two million. Where repetitions show a pair again, its first one counts. Cells
that are large all the same (copies of one vector that differ a little) are dealt in blocks,
and blocks meet two by two in tasks of their own. Tasks send links as numbers per vector and
as edges to the least vector connected, never as pairs.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .grouped import flat, run_starts
from .jaccard import components

COSINE = 0.98
PROJECTIONS = 24
#: Of pairs at the greatest distance, so many may be missed: half by cells, half by counts.
MISSED = 1e-6
#: Widths of windows (to either side) and of cells, in greatest distances.
WINDOW, CELL = 1.5, 5.0
#: What it costs to send a vector once more, in compared pairs.
SEND = 2_000
#: Vectors of a block, vectors held by a group of a task, collisions at once.
BLOCK, HELD, EVENTS = 2_048, 6_144, 1_000_000
#: Most projections that make a cell.
DEEPEST = 40

_SPREAD = "high bigint, low bigint, copies bigint, label string, v array<double>, cells array<bigint>"
_FOUND = "high bigint, low bigint, links bigint, root_high bigint, root_low bigint"


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def in_window(distance: float, width: float) -> float:
    """The chance that a projection of two vectors at a distance differs by ``width`` at most."""
    return 2 * _phi(width / distance) - 1


def in_cell(distance: float, width: float) -> float:
    """The chance that a projection puts two vectors at a distance into one cell of a width."""
    t = width / distance
    return 1 - 2 * _phi(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def least_count(cosine: float = COSINE) -> int:
    """The most collisions that a pair with this cosine reaches with a chance of 1 - MISSED / 2."""
    p, below = in_window(math.sqrt(2 - 2 * cosine), WINDOW * math.sqrt(2 - 2 * cosine)), 0.0
    for count in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > MISSED / 2:
            return count
    return PROJECTIONS


def depth_and_repetitions(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections of a cell, and how often cells are made, for labels of so many vectors at most."""
    distance = math.sqrt(2 - 2 * cosine)
    near, far = in_cell(distance, CELL * distance), in_cell(math.sqrt(2), CELL * distance)

    def repetitions(depth: int) -> int:
        return 1 if depth == 0 else math.ceil(math.log(MISSED / 2) / math.log1p(-(near**depth)))

    depth = min(range(DEEPEST + 1), key=lambda d: repetitions(d) * (largest * far**d + SEND))
    return depth, repetitions(depth)


@cache
def _directions(dimension: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, number))


def _with_cells(depth: int, repetitions: int, width: float):
    """Unit vectors with the number of their cell in each repetition."""

    def run(batches):
        offsets = np.random.default_rng(3).random(depth * repetitions) * width
        factors = np.random.default_rng(4).integers(1 << 62, size=max(depth, 1), dtype=np.int64) | 1
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            values = batch.column("v").flatten().to_numpy()
            begins = np.cumsum(sizes) - sizes
            units, cells = np.zeros(len(values)), np.zeros((batch.num_rows, repetitions), np.int64)
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                at = begins[of][:, None] + np.arange(size)
                x = values[at]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                units[at] = x
                if depth:
                    steps = np.floor((x @ _directions(int(size), depth * repetitions, 2) + offsets) / width).astype(np.int64)
                    cells[of] = (steps.reshape(len(of), repetitions, depth) * factors).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(units))
            of_rows = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * repetitions).astype(np.int32)), pa.array(cells.ravel()))
            columns = [batch.column(n) for n in ("high", "low", "copies", "label")]
            yield pa.RecordBatch.from_arrays([*columns, lists, of_rows], ["high", "low", "copies", "label", "v", "cells"])

    return run


def collision_counts(p: np.ndarray, q: np.ndarray | None, width: float) -> np.ndarray:
    """How often projections of rows of p and of q collide: a matrix. Without q, of p with itself, above the diagonal."""
    n, m = len(p), len(p if q is None else q)
    counts = np.zeros(n * m, np.uint8)
    for j in range(p.shape[1]):
        if q is None:
            order = np.argsort(p[:, j], kind="stable")
            centre = p[order, j]
            query, sought = order, order
            begin = np.arange(1, n + 1)
        else:
            query, order = np.arange(n), np.argsort(q[:, j], kind="stable")
            centre, sought = p[:, j], order
            begin = np.searchsorted(q[order, j], centre - width)
        end = np.searchsorted((p if q is None else q)[order, j], centre + width, side="right")
        hits = np.maximum(end - begin, 0)
        upto = np.cumsum(hits)
        a = 0
        while a < n:  # queries whose windows hold a bounded number together
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + EVENTS, side="right")))
            of, own = hits[a:b], np.repeat(query[a:b], hits[a:b])
            other = sought[np.arange(len(own)) - np.repeat(np.cumsum(of) - of, of) + np.repeat(begin[a:b], of)]
            codes = np.minimum(own, other) * m + np.maximum(own, other) if q is None else own * m + other
            counts[codes] += 1  # a pair collides once at most in a projection
            a = b
    return counts.reshape(n, m)


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node that edges a, b connect it with."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    step = max(1, EVENTS // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a[i : i + step]], y[b[i : i + step]]) >= cosine for i in range(0, len(a), step))])


def _linked(cosine: float):
    distance = math.sqrt(2 - 2 * cosine)
    least = least_count(cosine)

    def of_bucket(x: np.ndarray, first: np.ndarray, cells: np.ndarray, repetition: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows a, b; rows of the first of two blocks are told by ``first``."""
        p = x @ _directions(x.shape[1], PROJECTIONS, 1)
        left = np.flatnonzero(first)
        right = np.flatnonzero(~first) if not first.all() else left
        counts = collision_counts(p[left], None if first.all() else p[right], WINDOW * distance)
        a, b = np.nonzero(counts >= least)
        a, b = left[a], right[b]
        ok = _verified(x, x, a, b, cosine)
        a, b = a[ok], b[ok]
        before = (cells[a, :repetition] == cells[b, :repetition]).any(axis=1)
        return a[~before], b[~before]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        high, low, copies, bucket, second, lo, hi, rep = (table.column(n).to_numpy() for n in ("high", "low", "copies", "bucket", "second", "lo", "hi", "rep"))
        vectors, cells = flat(table, "v"), flat(table, "cells").reshape(table.num_rows, -1)
        sizes = table.column("v").combine_chunks().value_lengths().to_numpy()
        begins = np.cumsum(sizes) - sizes
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((low, high, hi, lo, rep, bucket, sizes, label))
        key = np.stack([x[order] for x in (label, sizes, bucket, rep, lo, hi)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(order)]]) if len(order) else [0]
        out = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            of = order[i:j]
            first = ~second[of]
            if j - i < 2 or (not first.any()) or (lo[of[0]] != hi[of[0]] and first.all()):
                continue
            x = vectors[begins[of][:, None] + np.arange(sizes[of[0]])]
            a, b = of_bucket(x, first, cells[of], int(rep[of[0]]))
            links = np.bincount(a, copies[of][b], len(of)) + np.bincount(b, copies[of][a], len(of))
            some, root = np.flatnonzero(links), of[least_connected(len(of), a, b)]
            out.append((of[some], links[some].astype(np.int64), root[some]))
        of, links, root = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(x) for x in (high[of], low[of], links, high[root], low[root])], ["high", "low", "links", "root_high", "root_low"])

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    * Rows link when their labels are equal and not null, their vectors have equal lengths,
      and the vectors' cosine in double precision is ``cosine`` or more. Vectors that are
      null, empty, zero or hold null or non-finite components link with nothing.
    * Rows with equal vectors and rows that repeat a vec_id are rows of their own. Rows
      without an id link as others do; component_id is the least id of the component, null
      if it has none. ``kept`` says whether it is the row's own.
    * An empty table gives an empty result. Other columns are not read. There is no text,
      and ties (equal vectors, cosines equal to the limit) all count.
    """
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.when(usable, F.struct(F.xxhash64("label", "v").alias("high"), F.xxhash64(F.lit("low"), "v", "label").alias("low")))
    named = rows.withColumn("node", node)
    nodes = stored(
        named.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors"
    )
    largest = nodes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    depth, repetitions = depth_and_repetitions(largest, cosine)
    celled = nodes.select("node.high", "node.low", "copies", "label", "v").mapInArrow(_with_cells(depth, repetitions, CELL * math.sqrt(2 - 2 * cosine)), _SPREAD)
    spread = celled.select("*", F.posexplode("cells").alias("rep", "cell")).withColumn("bucket", F.xxhash64("label", F.size("v"), "rep", "cell")).drop("cell")
    large = stored(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")), "cells")
    total = large.select(F.sum(F.col("members") * F.ceil(F.col("members") / BLOCK))).first()[0] or 0
    large = large.where(F.col("members") > BLOCK).select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    dealt = spread.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("high", "low"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("second", F.col("block") > F.col("other"))
    part = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(int(total // HELD) + 1)).alias("part")
    groups = dealt.select(part, "high", "low", "copies", "label", "v", "cells", "rep", "bucket", "lo", "hi", "second")
    found = stored(groups.groupBy("part").applyInArrow(_linked(cosine), _FOUND), "links")
    linked = found.select(F.struct("high", "low").alias("node"), F.struct(F.col("root_high").alias("high"), F.col("root_low").alias("low")).alias("root"), "links")
    roots = components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = told.groupBy("root").agg(F.min("least").alias("component"))
    told = told.join(of_root, "root").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = named.select("vec_id", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
