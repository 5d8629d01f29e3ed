"""Whitening of embeddings by principal components.

Vectors become integers x = floor(64 c) + 1,000,000. Every partition computes its number of
vectors, their mean and the scatter about that mean, batch by batch; two such moments merge
by Chan's formula, and a tree of merges (``treeReduce``) leaves one, of d x d numbers, for
the driver, which takes its eigenvectors. Sums of x are kept as integers besides. A second
pass whitens all vectors, merges their moments in the same way and so finds how far the
covariance of the result is from the identity. A third one returns the components.

No pass shuffles rows, and what the driver holds depends on the dimension alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Vectors that are centred and multiplied at once.
ROWS = 4_096
#: Levels of the tree of merges.
DEPTH = 3
#: Eigenvalues below this share of the largest are those of a direction without variance.
NO_VARIANCE = 1e-12
LARGEST = (1 << 63) - 1

_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Number, mean and scatter about the mean of vectors, with the exact sums of integer ones."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: tuple[int, ...]

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        base = x.min(axis=0)  # integers far from zero lose nothing once their least is taken off
        offset = _minus(x, base)
        mean = offset.mean(axis=0)
        centred = offset - mean
        sums = tuple(int(s) for s in (x.astype(object) if _wide(x) else x).sum(axis=0)) if x.dtype.kind == "i" else ()
        return cls(len(x), base + mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        """Those of both sets of vectors, by Chan's formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        if self.sums:  # the integers' own means, to the last bit
            apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, tuple(a + b for a, b in zip(self.sums, other.sums)))


NONE = Moments(0, np.zeros(0), np.zeros((0, 0)), ())


def _wide(x: np.ndarray) -> bool:
    """Whether sums or differences of these could pass 64 bits."""
    return x.dtype.kind == "i" and bool(len(x)) and max(abs(int(x.max())), abs(int(x.min()))) > LARGEST // (4 * len(x))


def _minus(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    return ((x.astype(object) if _wide(x) else x) - base).astype(np.float64)


def _vectors(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dimension)


def moments(whole: DataFrame, dimension: int, of: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """Those of all rows' vectors x, as ``of`` gives them."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = NONE
        for batch in batches:
            x = _vectors(batch, dimension)
            for at in range(0, len(x), ROWS):
                found = found.merged(Moments.of(of(x[at : at + ROWS])))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["moments"])

    parts = whole.select("x").mapInArrow(of_partition, "moments binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeReduce(Moments.merged, DEPTH) if parts.getNumPartitions() else NONE


def principal(found: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    return np.maximum(values[::-1], 0), vectors[:, ::-1]


def _projector(found: Moments, values: np.ndarray, vectors: np.ndarray):
    """x whitened on the components that have variance."""
    base = np.array([s // found.n for s in found.sums], dtype=object)
    rest = np.array([(s - int(b) * found.n) / found.n for s, b in zip(found.sums, base)])
    base, scaled = base.astype(np.int64), vectors / np.sqrt(values)
    return lambda x: (_minus(x, base) - rest) @ scaled


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    if not len(x):
        return []
    at_most = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.max(axis=0), x.min(axis=0), sums))
    if at_most**2 * len(sums) < LARGEST:  # every step is within 64 bits, n x and S too once the mean's whole part is off both
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s - n * (s // n) for s in sums], np.int64)
        apart = n * (x - whole) - rest
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, dtype=object)
    return [d if d <= LARGEST else None for d in (apart * apart).sum(axis=1)]


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    * Rows whose vector is null, empty or holds null or non-finite entries are left out, and
      so are those whose length isn't the most frequent one (of equally frequent lengths the
      least). Entries whose x no long holds count as the nearest long.
    * Rows that repeat a vec_id or a vector, and rows without an id, each count and are returned.
    * ``explained`` is a component's share of all variance. A component without variance has
      a null ``whitened`` (all of them where all vectors are equal; ``explained`` is then
      null too) and stays out of ``identity_error``, which is null where none has any.
    * ``deviation`` is null where no long holds it. Eigenvalues that are equal leave the
      choice among their eigenvectors open. An empty table gives an empty result. Other
      columns are not read; there are no texts.
    """
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], _OUT)
    dimension = int(usual["size"])
    whole = rows.where(F.size("v") == dimension).select("vec_id", F.transform("v", lambda c: F.least(F.floor(c * SCALE), F.lit(LARGEST - SHIFT)) + SHIFT).alias("x"))
    found = moments(whole, dimension, lambda x: x)
    values, axes = principal(found)
    number = min(components, dimension)
    some = int((values[:number] > NO_VARIANCE * max(values[0], 1e-300)).sum())
    project = _projector(found, values[:some], axes[:, :some])
    error = None
    if some:
        again = moments(whole, dimension, project)
        error = float(np.abs(again.scatter / again.n - np.eye(some)).max())
    n, sums = found.n, found.sums
    explained = (values[:number] / values.sum()).tolist() if values.sum() > 0 else [None] * number

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = _vectors(piece, dimension)
                of_rows = pa.array(np.repeat(np.arange(len(x)), number))
                scores = np.full((len(x), number), np.nan)
                scores[:, :some] = project(x)
                columns = [
                    piece.column("vec_id").take(of_rows),
                    pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(of_rows), n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(of_rows),
                    pa.array(scores.ravel(), pa.float64(), mask=np.tile(np.arange(number) >= some, len(x))),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * len(of_rows), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])

    return whole.mapInArrow(out, _OUT)
