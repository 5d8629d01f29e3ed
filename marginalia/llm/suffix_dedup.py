"""Removal of repeated passages by prefix-free parsing.

A rolling hash sets triggers: the grams whose hash is least among those of some 50 bytes.
Every 50-byte string has one, at the same place wherever it occurs. Around its triggers a
text is cut into overlapping phrases, each holding the 50-byte strings that belong to one
trigger. The corpus is then a dictionary of distinct phrases and a parse, the list of
phrases of each document.

1. Triggers meet by hash. One that no two documents share belongs to no repeated string,
   so its phrase is left out of the dictionary; in ordinary text these are most.
2. Phrases of shared triggers meet by trigger. Each task builds the dictionary of its
   triggers, with the first document of each phrase, and sorts its suffixes of 50 bytes or
   more. Neighbours in the suffix array that share 50 bytes are occurrences of one string,
   whose first document is the least of its phrases' first documents. The parse carries
   this back to all occurrences.
3. The removed spans join their documents.

A trigger with ``HOT_LEAST`` occurrences that holds ``HOT_SHARE`` of all is hot. Its phrases
are split into single 50-byte strings that meet by their own hash, and of equal ones a task
sends the first document's alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .grouped import by_value, flat, list_batch, run_starts, sizes_of
from .rolling import gram_hashes, mixed, triggers

LENGTH = 50
GRAM = 16
HOT_SHARE = 1e-5
#: And no trigger with less occurrences than this is hot: a task can well hold so many.
HOT_LEAST = 50_000
#: Bytes of text for each of the groups in which triggers and phrases meet.
GROUP_BYTES = 32_000_000
#: Bytes that a task holds before it sends what it has found.
HELD_BYTES = 8_000_000
PHRASE_BYTES = 2_000_000
_SLICE = 1_000_000
_NULL_ID = np.iinfo(np.int64).max

_SEEN = "part int, kind int, keys array<bigint>, at array<int>, doc array<int>, ids array<bigint>, rows array<bigint>, count array<int>"
_PHRASES = "part int, kind int, keys array<bigint>, at array<int>, size array<int>, doc array<int>, ids array<bigint>, rows array<bigint>, data binary"
_PLACES = "part int, kind int, ids array<bigint>, rows array<bigint>, at array<int>, size array<int>"


def _documents(batches: Iterator[pa.RecordBatch], most: int, *more: str) -> Iterator[list[tuple]]:
    """Lists of (id, row hash, bytes, ...) with ``most`` bytes of text or one document more."""
    held, size = [], 0
    for big in batches:
        for begin in range(0, big.num_rows, 512):
            batch = big.slice(begin, 512)
            for doc, row, text, *rest in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row_hash", "text", *more))):
                data = text.encode()
                held.append((_NULL_ID if doc is None else doc, row, data, *rest))
                size += len(data)
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triggers of all texts: (text, position, hash), about ``_SLICE`` bytes at a time."""
    margin = 2 * LENGTH
    group: list[tuple[int, bytes]] = []
    size = 0

    def of_group() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for _, t in group])
        starts = np.cumsum(lengths) - lengths
        at, keys = triggers(np.frombuffer(b"".join(t for _, t in group), np.uint8), GRAM, LENGTH)
        which = np.searchsorted(starts, at, "right") - 1
        at -= starts[which]
        fits = at + GRAM <= lengths[which]
        return np.array([i for i, _ in group])[which[fits]], at[fits], keys[fits]

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > 2 * _SLICE:
            for begin in range(0, len(text), _SLICE):
                low = max(0, begin - margin)
                at, keys = triggers(np.frombuffer(text[low : begin + _SLICE + margin], np.uint8), GRAM, LENGTH)
                at += low
                own = (at >= begin) & (at < begin + _SLICE)
                yield np.full(own.sum(), i), at[own], keys[own]
            continue
        group.append((i, text))
        size += len(text)
        if size >= _SLICE:
            yield of_group()
            group, size = [], 0
    if group:
        yield of_group()


def _seen(groups: int):
    """kind 0: triggers for the group of their hash. kind 1: places of triggers that two documents of this task share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches, HELD_BYTES):
            found = list(_pieces([d[2] for d in docs]))
            if not found:
                continue
            which, at, keys = (np.concatenate(x) for x in zip(*found))
            ids, rows = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
            order = np.argsort(keys, kind="stable")
            which, at, keys = which[order], at[order], keys[order]
            begins = run_starts(keys)
            counts = np.diff([*begins, len(keys)])
            shared = np.minimum.reduceat(ids[which], begins) != np.maximum.reduceat(ids[which], begins)
            of_shared = np.repeat(shared, counts)
            # of a shared trigger one entry goes to its group, to tell the others
            sent = ~of_shared
            sent[begins] = True
            count = np.where(of_shared, np.repeat(counts, counts), 1)[sent]
            out = [{"part": p, "kind": 0} | _entries(sent.nonzero()[0][i], keys, which, at, ids, rows) | {"count": count[i]} for p, i in by_value((keys[sent] % np.uint64(groups)).astype(np.int64))]
            here = of_shared.nonzero()[0]
            out += [{"part": p, "kind": 1} | _entries(here[i], keys, which, at, ids, rows) for p, i in by_value(_part_of(ids[which[here]], rows[which[here]], groups))]
            yield list_batch(_SEEN, out)

    return run


def _part_of(ids: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """By id and text, so that copies of one text don't meet in one part."""
    return (mixed((ids ^ rows).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _entries(chosen: np.ndarray, keys: np.ndarray, which: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> dict:
    used, doc = np.unique(which[chosen], return_inverse=True)
    return {"keys": keys[chosen].view(np.int64), "at": at[chosen], "doc": doc, "ids": ids[used], "rows": rows[used]}


def _whole(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """Entries of all rows of a group: ids and row hashes for each, then the named columns."""
    sizes, docs = sizes_of(table, "doc"), sizes_of(table, "ids")
    doc = flat(table, "doc") + np.repeat(np.cumsum(docs) - docs, sizes)
    return (flat(table, "ids")[doc], flat(table, "rows")[doc], *(flat(table, n) for n in names))


def _places(groups: int, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[dict]:
    return [{"part": p, "kind": 1, "ids": ids[i], "rows": rows[i], "at": at[i], "size": size[i]} for p, i in by_value(_part_of(ids, rows, groups))]


def _shared(groups: int):
    """From triggers of one group: places of those that two documents share (kind 1), and their counts (kind 2: hash, count)."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out: list[dict] = []
        passed = table.filter(pa.array(kinds == 1))
        if passed.num_rows:
            ids, rows, at = _whole(passed, "at")
            out += _places(groups, ids, rows, at, np.zeros(len(at)))
        table = table.filter(pa.array(kinds == 0))
        if table.num_rows:
            ids, rows, keys, at, count = _whole(table, "keys", "at", "count")
            order = np.argsort(keys, kind="stable")
            ids, rows, keys, at, count = ids[order], rows[order], keys[order], at[order], count[order]
            begins = run_starts(keys)
            least, most, total = np.minimum.reduceat(ids, begins), np.maximum.reduceat(ids, begins), np.add.reduceat(count, begins)
            # a count above 1 stands for several documents
            shared = (least != most) | (np.maximum.reduceat(count, begins) > 1)
            chosen = np.repeat(shared, np.diff([*begins, len(keys)]))
            out += _places(groups, ids[chosen], rows[chosen], at[chosen], np.zeros(chosen.sum()))
            large = total >= HOT_LEAST
            out.append({"part": -1, "kind": 2, "ids": keys[begins[large]], "rows": total[large]})
        return pa.Table.from_batches([list_batch(_PLACES, out)])

    return run


_ROW_PLACES = "doc_id bigint, row_hash bigint, at array<int>, size array<int>"


def _by_row(table: pa.Table) -> pa.Table:
    """One row for each document, its places in order and each once."""
    ids, rows, at, size = (flat(table, n) for n in ("ids", "rows", "at", "size"))
    order = np.lexsort((size, at, rows, ids))
    ids, rows, at, size = ids[order], rows[order], at[order], size[order]
    if len(ids):
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (at[1:] != at[:-1]) | (size[1:] != size[:-1])])
        ids, rows, at, size = ids[new], rows[new], at[new], size[new]
        begins = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]))
    else:
        begins = np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([begins, [len(ids)]]).astype(np.int32))
    names = pa.array(ids[begins], pa.int64(), mask=(ids[begins] == _NULL_ID) & (rows[begins] & 1 == 1))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32), pa.int32())) for x in (at, size)]
    return pa.table([names, pa.array(rows[begins], pa.int64()), *lists], ["doc_id", "row_hash", "at", "size"])


def owned(at: np.ndarray, keys: np.ndarray, doc: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that belong to each trigger: those in which its hash is least, then leftmost.

    Triggers come in order of document and position; ``length`` is that of the document.
    """
    reach = LENGTH - GRAM
    low, high = np.maximum(at - reach, 0), np.minimum(at, length - LENGTH)
    for step in range(1, reach + 1):
        if step >= len(at):
            break
        near = (doc[step:] == doc[:-step]) & (at[step:] - at[:-step] <= reach)
        if not near.any():
            break
        before = near & (keys[:-step] <= keys[step:])
        low[step:][before] = np.maximum(low[step:][before], at[:-step][before] + 1)
        after = near & (keys[step:] < keys[:-step])
        high[:-step][after] = np.minimum(high[:-step][after], at[step:][after] - reach - 1)
    return low, high


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... ``count`` times, for each."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def _phrases(groups: int, hot):
    """kind 0: phrases for the group of their trigger, or of themselves if it is hot. kind 1: spans already decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, pack = hot.value, zstandard.ZstdCompressor(1)
        for docs in _documents(batches, PHRASE_BYTES, "at"):
            lengths = np.array([len(d[2]) for d in docs], np.int64)
            starts = np.cumsum(lengths) - lengths
            data = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
            doc = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
            at = np.array([x for d in docs for x in d[3]], np.int64)
            if not len(at):
                continue
            keys = gram_hashes(data, GRAM)[starts[doc] + at]
            low, high = owned(at, keys, doc, lengths[doc])
            some = low <= high
            doc, keys, low, high = doc[some], keys[some], low[some], high[some]
            ids, rows = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
            is_hot = np.isin(keys, hot_keys)
            out = []
            if is_hot.any():
                single, owner = _spread(low[is_hot], (high - low + 1)[is_hot]), np.repeat(doc[is_hot], (high - low + 1)[is_hot])
                begin = starts[owner] + single
                own = gram_hashes(data, LENGTH)[begin]
                order = np.lexsort((ids[owner], own))
                sorted_content = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin[order]]).view(f"V{LENGTH}").ravel()
                first = np.concatenate([[True], sorted_content[1:] != sorted_content[:-1]])
                begins = np.flatnonzero(first)
                least = np.repeat(ids[owner[order]][begins], np.diff([*begins, len(order)]))
                later = ids[owner[order]] > least
                gone, left = order[later], order[~later]
                out += _places(groups, ids[owner[gone]], rows[owner[gone]], single[gone], np.full(len(gone), LENGTH))
                doc, keys, low, high = (np.concatenate([a[~is_hot], b]) for a, b in ((doc, owner[left]), (keys, own[left]), (low, single[left]), (high, single[left])))
            size = high - low + LENGTH
            for part, i in by_value((keys % np.uint64(groups)).astype(np.int64)):
                used, local = np.unique(doc[i], return_inverse=True)
                text = data[_spread(starts[doc[i]] + low[i], size[i])].tobytes()
                out.append({"part": part, "kind": 0, "keys": keys[i].view(np.int64), "at": low[i], "size": size[i], "doc": local, "ids": ids[used], "rows": rows[used], "data": pack.compress(text)})
            spans = [o for o in out if o["kind"] == 1]
            for o in spans:  # the same form as phrases
                o |= {"doc": np.arange(len(o["ids"]))}
            yield list_batch(_PHRASES, out)

    return run


def suffix_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For suffixes of ``LENGTH`` bytes or more, in the order of their sorted array: equal numbers where the first ``LENGTH`` are equal.

    Returns (order, class of each in that order).
    """
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel()
    offsets = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    columns = [words[starts + o] for o in offsets]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(starts), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new)


def first_documents(phrases: list[bytes], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of each phrase, one phrase after the other: the first document; and where each phrase's begin."""
    data = np.frombuffer(b"".join(phrases), np.uint8)
    size = np.array([len(p) for p in phrases], np.int64)
    count = size - LENGTH + 1
    starts = _spread(np.cumsum(size) - size, count)
    order, classes = suffix_classes(data, starts)
    of_string = np.repeat(firsts, count)[order]
    begins = run_starts(classes)
    least = np.repeat(np.minimum.reduceat(of_string, begins), np.diff([*begins, len(order)]))
    out = np.empty(len(order), np.int64)
    out[order] = least
    return out, np.cumsum(count) - count


def _decided(groups: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out: list[dict] = []
        passed = table.filter(pa.array(kinds == 1))
        if passed.num_rows:
            ids, rows, at, size = _whole(passed, "at", "size")
            out += _places(groups, ids, rows, at, size)
        table = table.filter(pa.array(kinds == 0))
        if table.num_rows:
            ids, rows, keys, at, size = _whole(table, "keys", "at", "size")
            unpack = zstandard.ZstdDecompressor()
            text = b"".join([unpack.decompress(x) for x in table.column("data").to_pylist()])
            begin = np.cumsum(size) - size
            order = np.argsort(keys, kind="stable")
            begins = run_starts(keys[order])
            # whole triggers, about as many strings at a time as a task can well sort
            weight = np.cumsum((size - LENGTH + 1)[order])
            groups_of = np.searchsorted(np.arange(0, weight[-1] + 400_000, 400_000), weight[np.concatenate([begins[1:], [len(order)]]) - 1])
            for a, b in zip(begins[run_starts(groups_of)], [*begins[run_starts(groups_of)][1:], len(order)]):
                i = order[a:b]
                out += _places(groups, *_removed(text, ids[i], rows[i], at[i], size[i], begin[i]))
        return pa.Table.from_batches([list_batch(_PLACES, out)])

    return run


def _removed(text: bytes, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray):
    """Spans of the strings whose first document is another."""
    numbers: dict[bytes, int] = {}
    phrase = np.array([numbers.setdefault(text[b : b + s], len(numbers)) for b, s in zip(begin.tolist(), size.tolist())])
    firsts = np.full(len(numbers), _NULL_ID)
    np.minimum.at(firsts, phrase, ids)
    least, where = first_documents(list(numbers), firsts)
    count = size - LENGTH + 1
    gone = least[_spread(where[phrase], count)] < np.repeat(ids, count)
    owner = np.repeat(np.arange(len(ids)), count)
    start = _spread(at, count)
    begins = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (owner[1:] != owner[:-1])]))
    ends = np.flatnonzero(gone & np.concatenate([~gone[1:] | (owner[1:] != owner[:-1]), [True]]))
    o = owner[begins]
    return ids[o], rows[o], start[begins], start[ends] - start[begins] + LENGTH


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for offset in range(0, big.num_rows, 512):
            batch = big.slice(offset, 512)
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, at, size in zip(*(batch.column(n).to_pylist() for n in ("text", "at", "size"))):
                data = text.encode()
                left, upto, spans = [], 0, 0
                end = -1
                for a, s in zip(at or (), size or ()):  # in order of start
                    if a > end:
                        spans += 1
                        left.append(data[upto:a])
                    end = max(end, a + s)
                    upto = end
                left.append(data[upto:])
                whole = b"".join(left)
                kept.append(whole)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(whole))
                n_spans.append(spans)
            values = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    * A byte of a text in UTF-8 is removed if a 50-byte string that covers it also starts
      in a document with a smaller doc_id; strings are judged on the input, overlaps
      count, and no string crosses documents. kept may cut characters in two.
    * A null text counts as empty. A null doc_id comes after all others, but for the
      largest id there is: to that it loses nothing, nor that to it. Rows that repeat
      a doc_id are one document: they lose nothing to each other.
    * Texts of less than 50 bytes stay. An empty table gives an empty result. Other
      columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    # the last bit tells null from the id that stands for it
    rows = rows.withColumn("row_hash", F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("bigint")))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    groups = int(total // GROUP_BYTES) + int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.mapInArrow(_seen(groups), _SEEN)
    places = stored(seen.groupBy("part").applyInArrow(_shared(groups), _PLACES), "triggers")
    counts = places.where("kind = 2").select(F.explode(F.arrays_zip("ids", "rows")).alias("x")).select("x.ids", "x.rows")
    # at most 1 / HOT_SHARE triggers can hold that share
    n_triggers = stored_total(places)
    hot = counts.where(F.col("rows") >= max(float(HOT_LEAST), HOT_SHARE * n_triggers)).orderBy(F.desc("rows")).limit(int(1 / HOT_SHARE) + 1).collect()
    shared_hot = spark.sparkContext.broadcast(np.array([x.ids for x in hot], np.int64).view(np.uint64))
    by_row = places.where("kind = 1").groupBy("part").applyInArrow(_by_row, _ROW_PLACES).drop("size").withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
    with_places = rows.join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))).select("doc_id", "row_hash", "text", "at")
    decided = with_places.mapInArrow(_phrases(groups, shared_hot), _PHRASES).groupBy("part").applyInArrow(_decided(groups), _PLACES)
    spans = stored(decided, "spans")
    spans = spans.groupBy("part").applyInArrow(_by_row, _ROW_PLACES).withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left").select("doc_id", "text", "at", "size")
    return joined.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def stored_total(places: DataFrame) -> int:
    """Places of shared triggers: no less than any trigger's own count can sum to."""
    return places.where("kind = 1").agg(F.sum(F.size("at").cast("bigint"))).first()[0] or 0
