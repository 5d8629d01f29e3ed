"""Line deduplication over levelled sorted runs of line hashes.

The documents come in batches. A batch becomes a run: its line hashes, each with the
number of documents that have it, bucketed and sorted by hash. Before that, the batch is
merge-anti-joined with the settled run, which holds the hashes already known to be
frequent; they need no further counting. When a level holds ``fan_in`` runs, a compaction
merges them into one run of the next level and moves the hashes that have become frequent
to the settled run. The last compaction merges what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, new_path, released, shuffles_released, small_batches, stored, text_of, written

MIN_DOCS = 10
MIN_LENGTH = 1
BATCHES = 4
FAN_IN = 2
#: Up to so many frequent keys, of 16 bytes each, go to every task.
BROADCAST_KEYS = 200_000

_OCCURRENCES = "doc_id bigint, row_hash bigint, batch int, key binary, positions array<int>"


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _occurrences(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, rows, parts, texts = (batch.column(i).to_pylist() for i in range(4))
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, row, part, text in zip(ids, rows, parts, texts):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_length and (min_length <= 1 or len(key.decode()) >= min_length):
                        found.setdefault(md5(key).digest(), []).append(at)
                for key, positions in found.items():
                    for column, value in zip(out, (doc, row, part, key, positions)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "row_hash", "batch", "key", "positions"])

    return run


class LineRuns:
    """Runs of (key, n_docs) by level, and the settled run of frequent keys.

    Runs are tables in the shared folder, bucketed and sorted by key, so that merges and
    anti-joins between them need no shuffle.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.tables: dict[int, tuple[DataFrame, str, str]] = {}

    def _run(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, name)
        with shuffles_released(self.spark):
            df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        self.tables[id(run)] = (run, name, path)
        return run

    def _drop(self, run: DataFrame) -> None:
        """A run that has been merged goes, table and files."""
        _, name, path = self.tables.pop(id(run))
        self.spark.sql(f"DROP TABLE {name}")
        released(self.spark, [path])

    def add(self, batch: DataFrame) -> None:
        """batch: key and doc_id; each pair counts once."""
        for settled in self.settled:
            batch = batch.join(settled, "key", "left_anti")
        counts = batch.groupBy("key").agg(F.count_distinct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))).alias("n_docs"))
        self._push(0, self._run(counts))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(runs))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        merged = reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        merged = stored(merged, "line-merge")
        self.settled.append(self._run(merged.where(F.col("n_docs") >= self.min_docs).select("key")))
        rest = self._run(merged.where(F.col("n_docs") < self.min_docs))
        released(self.spark, [written.pop()])
        for run in runs:
            self._drop(run)
        return rest

    def close(self) -> DataFrame:
        """Compacts all levels and returns the frequent keys; the runs are gone then."""
        if runs := [run for level in self.levels for run in level]:
            self.levels = [[self._merged(runs)]]
        frequent = stored(reduce(DataFrame.unionByName, self.settled), "frequent-lines")
        for run, _, _ in list(self.tables.values()):
            self._drop(run)
        self.levels, self.settled = [], []
        return frequent


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts, drops = batch.column("_text").to_pylist(), batch.column("_drop").to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, drops):
            lines = text.split("\n")
            gone = {at for positions in drop or () for at in positions}
            kept.append("\n".join([x for at, x in enumerate(lines) if at not in gone]) if gone else text)
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
        columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("_text", "_drop")]
        names = [n for n in batch.schema.names if n not in ("_text", "_drop")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            [*names, "_kept", "n_lines", "n_dropped"],
        )


def line_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, kept_text, n_lines, n_dropped.

    * Lines whose key (see ``line_key``) has ``min_length`` code points or more and occurs
      in ``min_docs`` documents or more are lost in every document; the others stay,
      joined by a line feed.
    * A null or empty text is one empty line; an empty key is never dropped. Very long
      texts are split whole, by the task that reads them.
    * Rows that repeat a doc_id are one document when documents are counted, and so are
      all rows with a null doc_id; each row loses its own lines.
    * If all lines go, kept_text is empty. An empty table gives an empty result.
    * Columns not named are not read; a column in ``keep`` may have any name but those above.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))
    ).withColumn("row_hash", F.xxhash64("_text"))
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(batches)).cast("int")
    seen = stored(rows.select("doc_id", "row_hash", part.alias("batch"), "_text").mapInArrow(_occurrences(min_length), _OCCURRENCES), "lines", "batch")
    runs = LineRuns(spark, min_docs, fan_in)
    for at in range(batches):
        runs.add(seen.where(F.col("batch") == at).select("key", "doc_id"))
    frequent = runs.close()
    if frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)  # all other lines go where they are read
    drops = (
        seen.join(frequent, "key")
        .groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
        .agg(F.collect_set("positions").alias("_drop"))
    )
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    wide = joined.select("doc_id", *(f"_k{i}" for i in range(len(keep))), "_text", "_drop")
    schema = wide.drop("_text", "_drop").withColumns({"_kept": F.lit(""), "n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")}).schema
    out = wide.mapInArrow(_removed, schema)
    return out.select("doc_id", *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_kept").alias("kept_text"), "n_lines", "n_dropped")
