"""Folds over all rows in order of time, in parallel: exact, with states that depend on every row before.

Rows are cut by ranges of time into chunks of bounded size. Each chunk is first folded from
the empty state, as if nothing came before; where nothing lies within reach before it, that
is already right. The other chunks are then folded again from the state in which the chunk
before ended, beside the fold that they had: as soon as the two states are equal, what
follows stays as it was, and so does the chunk's last state. Chunks whose first state has
changed go on in the next round, all in parallel. States that soon forget (a window of time,
the last entries of a cache) need a round or two. After ``SPECULATED`` such rounds a chunk
waits until the chunk before it can't change any more, so that no chunk is folded more than
``SPECULATED`` + 2 times: a state that never forgets needs as many rounds as there are
chunks, each over one chunk, and rounds read nothing but their own chunks.
"""

from __future__ import annotations

import pickle
import uuid
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marginalia.storage import shared_folder

#: Rows of a chunk, after how many rows two folds are compared at first, and rounds in which chunks are folded after others that may still change.
CHUNK, COMPARED, SPECULATED = 200_000, 64, 2
#: The number under which chunks lie before they are folded.
PLACED = 1 << 30


class Fold(Protocol):
    """What a fold does. States are pickled between chunks, by their ``normal`` form."""

    def empty(self) -> Any: ...

    def step(self, state: Any, now: int, key: str, failed: bool) -> bool:
        """The outcome of a row at ``now`` microseconds; changes the state."""

    def normal(self, state: Any, now: int) -> Any:
        """A form of the state that is equal for states that rows from ``now`` on can't tell apart."""

    def restored(self, normal: Any) -> Any: ...

    def reach(self) -> int | None:
        """After so many microseconds without a row a state is as good as empty; None for never."""


@dataclass(frozen=True)
class WindowLimit:
    """Rejects a row where ``limit`` accepted ones lie less than a window before."""

    limit: int
    window: int

    def empty(self):
        return deque()

    def step(self, state, now, key, failed):
        while state and now - state[0] >= self.window:
            state.popleft()
        if len(state) >= self.limit:
            return True
        state.append(now)
        return False

    def normal(self, state, now):
        return [t for t in state if now - t < self.window]

    def restored(self, normal):
        return deque(normal)

    def reach(self):
        return self.window


@dataclass(frozen=True)
class CappedCache:
    """Whether a key's value is there and younger than the time to live, in a cache of so many entries.

    A value that is too old is made again and keeps its place; beyond the cap the entry
    first inserted goes. A failed lookup leaves no entry.
    """

    ttl: int
    cap: int

    def empty(self):
        return {}

    def step(self, state, now, key, failed):
        made = state.get(key)
        if made is not None and now - made < self.ttl:
            return True
        state[key] = now
        if len(state) > self.cap:
            del state[next(iter(state))]
        if failed:
            state.pop(key, None)
        return False

    def normal(self, state, now):
        # entries too old to hit still have their places
        return [(k, made if now - made < self.ttl else None) for k, made in state.items()]

    def restored(self, normal):
        return {k: made if made is not None else -(1 << 62) for k, made in normal}

    def reach(self):
        return None


@dataclass(frozen=True)
class ClientLimit:
    """A window limit for each client; once more than ``cap`` clients are known, an accepted request makes all of them unknown."""

    limit: int
    window: int
    cap: int

    def empty(self):
        return {}

    def step(self, state, now, key, failed):
        recent = [t for t in state.get(key, ()) if now - t < self.window]
        rejected = len(recent) >= self.limit
        if not rejected:
            recent.append(now)
        state[key] = recent
        if not rejected and len(state) > self.cap:
            state.clear()
        return rejected

    def normal(self, state, now):
        return sorted((k, [t for t in times if now - t < self.window]) for k, times in state.items())

    def restored(self, normal):
        return {k: list(times) for k, times in normal}

    def reach(self):
        return None


def _folded(fold: Fold, next_first: dict[int, int], order: str, failed: str | None):
    """Of a chunk's rows and its states (old: with which its outcomes were made, new): the rows with outcomes, and a row with the last state."""

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("_now", "ascending"), (order, "ascending")]))
        chunk = rows.column("_chunk")[0].as_py()
        times, keys = rows.column("_now").to_pylist(), rows.column("_key").to_pylist()
        bad = rows.column(failed).to_pylist() if failed else [False] * len(times)
        new, old = (states.column(n)[0].as_py() for n in ("_new", "_old"))
        state = fold.restored(pickle.loads(new)) if new is not None else fold.empty()
        outcomes = []
        if old is None and new is None:  # the first time
            outcomes = [fold.step(state, *x) for x in zip(times, keys, bad)]
        else:
            before = rows.column("_outcome").to_pylist()
            other = fold.restored(pickle.loads(old)) if old is not None else fold.empty()
            at, upto = 0, COMPARED
            while at < len(times):
                if fold.normal(state, times[at]) == fold.normal(other, times[at]):
                    outcomes += before[at:]
                    for x in zip(times[at:], keys[at:], bad[at:]):
                        fold.step(state, *x)
                    break
                for x in zip(times[at:upto], keys[at:upto], bad[at:upto]):
                    outcomes.append(fold.step(state, *x))
                    fold.step(other, *x)
                at, upto = upto, 2 * upto
        last = pickle.dumps(fold.normal(state, next_first.get(chunk, times[-1])))
        names = [n for n in rows.column_names if n not in ("_outcome", "_last")]
        n = rows.num_rows
        columns = [pa.concat_arrays([rows.column(c).combine_chunks(), pa.nulls(1, rows.schema.field(c).type)]) if c != "_chunk" else pa.array([chunk] * (n + 1), pa.int32()) for c in names]
        columns += [pa.array([*outcomes, None], pa.bool_()), pa.array([None] * n + [last], pa.binary())]
        return pa.table(columns, [*names, "_outcome", "_last"])

    return run


def chained(rows: DataFrame, fold: Fold, ts: str, order: str, outcome: str, key: str | None = None, failed: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Adds ``outcome``, a boolean that the fold gives for each row, rows being taken in order of ``ts`` and ``order``.

    ``order`` must tell rows with one time apart. A null key is 'unknown', a null time comes
    first. An empty table gives an empty result. Columns whose names begin with _chunk, _key,
    _now, _outcome, _last, _new, _old or _round are lost.
    """
    spark = rows.sparkSession
    names = rows.columns
    now = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 61)))
    given = rows.withColumns({"_now": now, "_key": F.coalesce(F.col(key).cast("string"), F.lit("unknown")) if key else F.lit("")})
    parts = max(1, -(-given.count() // (chunk_rows or CHUNK)))
    placed = given.repartitionByRange(parts, "_now", order).withColumn("_chunk", F.spark_partition_id())
    placed = placed.withColumns({"_outcome": F.lit(None).cast("boolean"), "_last": F.lit(None).cast("binary")})
    schema = StructType([StructField(f.name, f.dataType) for f in placed.schema])
    folder = f"{shared_folder(spark)}/chained-{uuid.uuid4().hex[:12]}"
    stored = StructType([*(f for f in schema if f.name != "_chunk"), schema["_chunk"], StructField("_round", IntegerType())])

    def write(rows: DataFrame, number: int) -> None:
        rows.write.option("compression", "zstd").partitionBy("_chunk").parquet(f"{folder}/_round={number}")

    def read(wanted: Iterable[tuple[int, int]]) -> DataFrame:
        """Only the given rounds' chunks (round, chunk), whatever else lies there."""
        paths = sorted({f"{folder}/_round={number}/_chunk={chunk}" for number, chunk in wanted})
        return spark.read.schema(stored).option("basePath", folder).parquet(*paths)

    write(placed, PLACED)
    # one row for each chunk
    at_first = spark.read.schema(stored).option("basePath", folder).parquet(f"{folder}/_round={PLACED}")
    bounds = sorted(tuple(r) for r in at_first.groupBy("_chunk").agg(F.min("_now"), F.max("_now")).collect())
    order_of = [c for c, _, _ in bounds]
    if not order_of:
        return rows.withColumn(outcome, F.lit(None).cast("boolean"))
    next_first = {c: first for (c, _, _), (_, first, _) in zip(bounds, bounds[1:])}
    linked = {c: before for (before, _, last), (c, first, _) in zip(bounds, bounds[1:]) if fold.reach() is None or first - last < fold.reach()}
    run = _folded(fold, next_first, order, failed)

    def folded(source: DataFrame, states: DataFrame, number: int, chunks: list[int]) -> dict[int, int]:
        """Writes a round and gives its chunks' last states by their hashes."""
        write(source.select(schema.names).groupBy("_chunk").cogroup(states.groupBy("_chunk")).applyInArrow(run, schema), number)
        ends = read((number, c) for c in chunks).where("_last IS NOT NULL")
        return {r["_chunk"]: r.h for r in ends.select("_chunk", F.xxhash64("_last").alias("h")).collect()}

    nothing = spark.createDataFrame([(c, None, None) for c in order_of], "_chunk int, _new binary, _old binary")
    last = folded(at_first, nothing, 0, order_of)
    latest, number = dict.fromkeys(order_of, 0), 0
    empty = spark.createDataFrame([(bytearray(pickle.dumps(fold.normal(fold.empty(), 0))),)], "x binary").select(F.xxhash64("x")).first()[0]
    assumed: dict[int, tuple[int, int] | None] = dict.fromkeys(order_of)  # chunk before and round of the state with which a chunk was folded
    seen = dict.fromkeys(order_of, empty)
    while pending := [c for c, before in linked.items() if last[before] != seen[c]]:
        number += 1
        if number > SPECULATED:  # a chunk after one that may still change waits for it
            changing = set(pending)
            for c, before in linked.items():  # in order
                if before in changing:
                    changing.add(c)
            pending = [c for c in pending if linked[c] not in changing]
        wanted = [(c, linked[c], latest[linked[c]], *(assumed[c] or (-1, -1))) for c in pending]
        asked = spark.createDataFrame(wanted, "_chunk int, _b int, _r int, _ob int, _or int")
        ends = [(r, c) for _, b, b_round, old, old_round in wanted for r, c in ((b_round, b), (old_round, old)) if c >= 0]
        states = read(ends).where("_last IS NOT NULL").select(F.col("_chunk").alias("c"), F.col("_round").alias("r"), "_last")
        pairs = asked.join(states, (F.col("_b") == F.col("c")) & (F.col("_r") == F.col("r"))).select("_chunk", F.col("_last").alias("_new"), "_ob", "_or")
        pairs = pairs.join(states, (F.col("_ob") == F.col("c")) & (F.col("_or") == F.col("r")), "left").select("_chunk", "_new", F.col("_last").alias("_old"))
        source = read((latest[c], c) for c in pending).where("_last IS NULL")
        for c in pending:
            assumed[c], seen[c] = (linked[c], latest[linked[c]]), last[linked[c]]
        last |= folded(source, pairs, number, pending)
        latest |= dict.fromkeys(pending, number)
    return read((r, c) for c, r in latest.items()).where("_last IS NULL").select(*names, F.col("_outcome").alias(outcome))
