"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of hashed word shingles; equal sets are one. Sets fall into bands of
size, so that similar sets lie in one band or in neighbours; each set signs in its own band
and in the next, and a pair meets in the band of the larger. A band cuts the feature domain
into first-level parts and each part into ``cells``. A signature is the hash of a set's
features in all but ``off`` cells of one part; all such subsets of cells are enumerated.

Why no pair is lost. Let A and B be similar and differ in d features; d is at most a third
of either's size. No more than d // (off + 1) parts hold more than ``off`` differences. In
every other part some subset of cells is free of them, so A and B share its signature. A
signature without features isn't sent; that can cost a part only where all features of the
set lie in ``off`` cells. Each set signs in the first parts up to the one with which
d // (off + 1) + 1 + spare parts have features in more cells than that, with the set's own
bound of d. Of the parts in which both sign, then, ``spare`` + 1 give a common signature. A set with too few such parts
in all signs in every one of them, and also by single features (the first of them in hash
order, as many as it may lose and ``spare`` + 1 more), by which two such sets meet.

Signatures that are one set's alone are dropped where they meet. Of the others each set
leaves out its ``spare`` most frequent, which are those of passages that many documents
share; of the spare + 1 that a pair has in common, the rarest is left out by neither.

Sets that share a signature are candidates. Signatures with the same sets count once. A
small parity sketch of each set bounds the symmetric difference of two from below and
spares most of the comparisons that would fail. First each set is compared with one other,
by which large families of copies are connected. Then, of signatures whose sets are not yet
all connected, every two that aren't are compared by sketches, in blocks of bounded size,
and what the sketches leave by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .grouped import by_value, flat, list_batch, run_starts, sizes_of
from .rolling import mixed

WORDS = 5
#: Sets are similar where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bytes of text for each of the groups in which signatures meet.
GROUP_BYTES = 6_000_000
HELD_BYTES = 4_000_000
#: So many signatures are held while they meet; those of more than ``FREQUENT`` sets pass at once.
HELD_SIGNATURES = 1_000_000
SIGNED_AT_ONCE = 100_000
FREQUENT = 4096
#: Bytes of a set's name in signatures; names that two sets have are told apart before the comparison.
NAME_BYTES = 5
_SLICE = 250_000
#: Sets of one signature that a task compares with each other or with as many more.
BLOCK = 2048
#: Places of sets in signatures that a task holds to compare.
HELD_SETS = 60_000
#: Of what the sketches leave, a set is first compared with so many, then with all.
NEAREST = (4, None)
#: Pairs of signatures with so many sets at most are told apart before they are compared.
SMALL_BUCKET = 64
PAIRS_AT_ONCE = 400_000
#: Words of the sketches that go with each signature.
BLOCK_WORDS = 16

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SENT = "part int, kind int, data binary, ids array<bigint>, rows array<bigint>, high array<bigint>, low array<bigint>, size array<int>, level array<int>"
_MET = "kind int, key bigint, level int, count int, name bigint, id bigint, row bigint, high bigint, low bigint, size int"


# -- sets of shingles --------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
#: Powers of the base and of its inverse modulo 2 ** 64, for all places of a slice.
_UP, _DOWN = _powers(_BASE, 2 * _SLICE + 1), _powers(pow(_BASE, -1, 1 << 64), 2 * _SLICE + 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, in order: words are runs of bytes that aren't white, A-Z in lower case."""
    x = np.frombuffer(data.lower(), np.uint8)
    if len(x) > 2 * _SLICE:  # a single word may be longer than a slice
        up, down = _powers(_BASE, len(x)), _powers(pow(_BASE, -1, 1 << 64), len(x))
    else:
        up, down = _UP, _DOWN
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~_WHITE[x]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    # sums of (byte + 1) * base ** place from the text's beginning, carried back to each word's own
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins] ^ ((ends - begins).astype(np.uint64) << np.uint64(40)))


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of about ``_SLICE`` bytes, cut at white space."""
    at = 0
    while len(data) - at > 2 * _SLICE:
        cut = at + _SLICE
        while cut < len(data) and not _WHITE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingles_of_words(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of ``WORDS`` words in a row; of fewer words, one hash of all."""
    n = min(len(words), WORDS)
    if n == 0:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    factor = np.uint64(0xA0761D6478BD642F)
    for i in range(n):
        total = total * factor + words[i : len(words) - n + 1 + i]
    return np.unique(mixed(total))


def shingles(data: bytes) -> np.ndarray:
    return shingles_of_words(np.concatenate([word_hashes(x) for x in _slices(data)]))


def set_id(features: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    salted = mixed(features ^ np.uint64(0x2545F4914F6CDD1D))
    return int(mixed(features).sum().view(np.int64)), int((salted + np.uint64(len(features))).sum().view(np.int64))


# -- signatures --------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    level: int
    k: int  #: bound on the symmetric difference of similar sets whose larger lies in the band
    parts: int  #: of the first level
    cells: int  #: of each part
    off: int  #: a signature leaves out so many cells
    spare: int

    @property
    def salt(self) -> np.uint64:
        return np.uint64((self.level + 1) * 0x9FB21C651E98DF25 % (1 << 64))


def bands(up_to: int = 1 << 31) -> tuple[list[int], list[Band]]:
    """Least sizes of the bands, and the bands."""
    bounds, out, low = [], [], 1
    while low <= up_to:
        high = low * 100 // PERCENT
        # |A ^ B| <= (1 - j) / (1 + j) * (|A| + |B|) for sets of Jaccard similarity j
        k = (100 - PERCENT) * 2 * high // (100 + PERCENT)
        bounds.append(low)
        if k <= 3:
            out.append(Band(len(out), k, 1, k + 3 if k else 1, k, 0))
        else:
            least = k // 2 + 1
            spare = max(1, least // 16)
            out.append(Band(len(out), k, (least + spare) * 5 // 4 + 1, 3, 1, spare))
        low = high + 1
    return bounds, out


BOUNDS, BANDS = bands()
#: Stands for the signatures of single features.
SINGLE = Band(len(BANDS), 0, 0, 1, 0, 1)


def may_lose(size: np.ndarray) -> np.ndarray:
    """The most features by which a similar set can differ."""
    return size * (100 - PERCENT) // PERCENT


def signatures(features: np.ndarray, size: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets in a band, one after the other: signatures, the set of each, and for each set whether they are enough to meet every similar set."""
    sets, cells = len(size), band.parts * band.cells
    hashes = mixed(features ^ band.salt)
    slot = (((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(sets) * cells, size)
    shape = (sets, band.parts, band.cells)
    filled = (np.bincount(slot, minlength=sets * cells) > 0).reshape(shape)
    sums = np.zeros(sets * cells, np.uint64)
    np.add.at(sums, slot, mixed(hashes))
    sums = sums.reshape(shape)
    most = np.minimum(band.k, may_lose(size))
    good = np.cumsum(np.count_nonzero(filled, axis=2) > np.minimum(band.off, most)[:, None], axis=1)
    wanted = most // (band.off + 1) + 1 + band.spare
    enough = good[:, -1] >= wanted
    used = np.concatenate([np.ones((sets, 1), bool), good[:, :-1] < wanted[:, None]], axis=1)
    if band.off == 1 and band.parts > 1:  # the subsets leave out one cell each
        kept = np.count_nonzero(filled, axis=2)[:, :, None] > filled
        totals = sums.sum(axis=2)[:, :, None] - sums
    else:
        subsets = np.array(list(combinations(range(band.cells), band.cells - band.off)))
        kept, totals = filled[:, :, subsets].any(axis=3), sums[:, :, subsets].sum(axis=3)
    kept &= used[:, :, None]
    numbers = (np.arange(band.parts, dtype=np.uint64) << np.uint64(8))[:, None] + np.arange(kept.shape[2], dtype=np.uint64)
    return mixed(totals ^ numbers * np.uint64(0xD1342543DE82EF95) ^ band.salt)[kept], np.nonzero(kept)[0], enough


def single_signatures(features: np.ndarray) -> np.ndarray:
    keys, wanted = mixed(features ^ SINGLE.salt), may_lose(len(features)) + 1 + SINGLE.spare
    return np.partition(keys, wanted - 1)[:wanted] if len(keys) > wanted else keys


def all_signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, levels and set numbers of sets that have features."""
    size = np.array([len(x) for x in sets])
    own = np.searchsorted(BOUNDS, size, "right") - 1
    few = np.zeros(len(sets), bool)
    out = []
    for level in np.unique([own, own + 1]):
        of = np.flatnonzero((own == level) | (own + 1 == level))
        # as many sets at a time as have about SIGNED_AT_ONCE features
        for part in np.split(of, np.flatnonzero(np.diff(np.cumsum(size[of]) // SIGNED_AT_ONCE)) + 1):
            keys, number, enough = signatures(np.concatenate([sets[i] for i in part]), size[part], BANDS[level])
            few[part[~enough]] = True
            out.append((keys, np.full(len(keys), level, np.uint8), part[number]))
    for i in np.flatnonzero(few):
        keys = single_signatures(sets[i])
        out.append((keys, np.full(len(keys), SINGLE.level, np.uint8), np.full(len(keys), i)))
    keys, levels, numbers = (np.concatenate(x) for x in zip(*out))
    return keys, levels, numbers


def _packed(keys: np.ndarray, levels: np.ndarray, names: np.ndarray) -> bytes:
    """Signatures of one group: the number of them, then the upper halves of their hashes, levels and names."""
    upper = (keys >> np.uint64(32)).astype("<u4")
    cut = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
    return len(keys).to_bytes(4, "little") + upper.tobytes() + levels.astype(np.uint8).tobytes() + cut.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    names = np.zeros((n, 8), np.uint8)
    names[:, :NAME_BYTES] = np.frombuffer(data, np.uint8, offset=4 + 5 * n).reshape(n, NAME_BYTES)
    return np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, np.uint8, n, 4 + 4 * n), names.view("<u8").ravel()


def name_of(high: Column) -> Column:
    return high.bitwiseAND(F.lit((1 << 8 * NAME_BYTES) - 1))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, int, bytes]]]:
    held, size = [], 0
    for big in batches:
        for at in range(0, big.num_rows, 256):
            batch = big.slice(at, 256)
            for doc, row, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row_hash", "text"))):
                data = text.encode()
                held.append((doc, row, data))
                size += len(data)
                if size >= HELD_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _signed(groups: int):
    """kind 0: packed signatures for their group. kind 1: documents with their sets; level is 1 for those without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            signed: dict[tuple[int, int], np.ndarray] = {}
            sets = []
            for _, _, data in docs:
                features = shingles(data)
                name = set_id(features)
                sets.append((*name, len(features)))
                if len(features):
                    signed[name] = features
            out = []
            if signed:
                key, level, number = all_signatures(list(signed.values()))
                name = np.array([x[0] for x in signed], np.int64)[number]
                for part, i in by_value((key % np.uint64(groups)).astype(np.int64)):
                    out.append({"part": part, "kind": 0, "data": _packed(key[i], level[i], name[i])})
            high, low, size = (np.array([x[i] for x in sets], np.int64) for i in range(3))
            ids, rows = np.array([d[0] or 0 for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
            without = np.array([d[0] is None for d in docs])
            for part, i in by_value((mixed((ids ^ rows).view(np.uint64)) % np.uint64(groups)).astype(np.int64)):
                out.append({"part": part, "kind": 1, "ids": ids[i], "rows": rows[i], "high": high[i], "low": low[i], "size": size[i], "level": without[i]})
            yield list_batch(_SENT, out)

    return run


def _met_batch(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"kind": pa.int32(), "level": pa.int32(), "count": pa.int32(), "size": pa.int32()}
    names = [x.split()[0] for x in _MET.split(", ")]
    values = [pa.array(columns[x], types.get(x, pa.int64())) if x in columns else pa.nulls(n, types.get(x, pa.int64())) for x in names]
    return pa.RecordBatch.from_arrays(values, names)


def _met(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: signatures that two sets share, with the number of sets, ``FREQUENT`` at most. kind 1: documents pass.

    A signature's sets are let go as soon as it is known to be frequent, so what is held does not grow with a hot one.
    """
    upper_half = int(group[0].as_py()) << 32
    frequent = np.zeros(0, np.uint32)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def shared(keys: np.ndarray, levels: np.ndarray, names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return _met_batch(kind=np.zeros(len(keys), np.int32), key=keys.astype(np.int64) | upper_half, level=levels, count=counts, name=names.view(np.int64))

    def settled(last: bool) -> pa.RecordBatch:
        nonlocal frequent
        keys, levels, names = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((names, keys))
        keys, levels, names = keys[order], levels[order], names[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])
        keys, levels, names = keys[new], levels[new], names[new]
        begins = run_starts(keys)
        sizes = np.diff([*begins, len(keys)])
        count = np.minimum(np.repeat(sizes, sizes), FREQUENT)
        frequent = np.union1d(frequent, keys[begins[sizes >= FREQUENT]])
        known = (count > 1) if last else (count == FREQUENT)
        waiting[:] = [(keys[~known], levels[~known], names[~known])]
        return shared(keys[known], levels[known], names[known], count[known])

    for batch in batches:
        kinds = batch.column(1).to_numpy()
        for kind in (0, 1):
            rows = batch.filter(pa.array(kinds == kind))
            if kind == 1 and rows.num_rows:
                table = pa.Table.from_batches([rows])
                ids, without = flat(table, "ids"), flat(table, "level") == 1
                high = flat(table, "high")
                own = {"row": flat(table, "rows"), "high": high, "low": flat(table, "low"), "size": flat(table, "size")}
                yield _met_batch(kind=np.ones(len(ids), np.int32), id=pa.array(ids, mask=without), name=high & ((1 << 8 * NAME_BYTES) - 1), **own)
            elif rows.num_rows:
                keys, levels, names = (np.concatenate(x) for x in zip(*map(_unpacked, rows.column(2).to_pylist())))
                if len(frequent) and (hot := np.isin(keys, frequent)).any():
                    yield shared(keys[hot], levels[hot], names[hot], np.full(hot.sum(), FREQUENT))
                    keys, levels, names = keys[~hot], levels[~hot], names[~hot]
                waiting.append((keys, levels, names))
                if sum(len(x[0]) for x in waiting) >= HELD_SIGNATURES:
                    yield settled(False)
    if waiting:
        yield settled(True)


def _rarest(shared: DataFrame) -> DataFrame:
    """key, name: of each set and level, the shared signatures less the ``spare`` most frequent."""
    spare = F.element_at(F.array(*[F.lit(x.spare) for x in (*BANDS, SINGLE)]), F.col("level") + 1)
    by_frequency = Window.partitionBy("name", "level").orderBy(F.desc("count"), "key")
    return shared.select("key", "name", "level", F.dense_rank().over(by_frequency).alias("at")).where(F.col("at") > spare).select("key", "name")


# -- comparison --------------------------------------------------------------------------

_ELEMENTS = "name bigint, set struct<high:bigint,low:bigint>, n int, words array<bigint>, sketch array<bigint>, features array<bigint>"


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of how many features fall on each of about twice as many bits; a power of two of them."""
    bits = max(64, 1 << int(2 * len(features) - 1).bit_length())
    odd = np.bincount((features >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shortened(words: np.ndarray) -> np.ndarray:
    """A sketch of ``BLOCK_WORDS`` words at most."""
    return np.bitwise_xor.reduce(words.reshape(-1, BLOCK_WORDS), axis=0) if len(words) > BLOCK_WORDS else words


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 256):
            batch = big.slice(at, 256)
            found = [shingles(x.encode()) for x in batch.column(2).to_pylist()]
            sketches = [sketch(x) for x in found]
            lists = (pa.array(x, pa.list_(pa.int64())) for x in ([shortened(x) for x in sketches], sketches, [x.view(np.int64) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int32()), *lists], ["name", "set", "n", "words", "sketch", "features"])


def _folded(x: Column, size: Column) -> Column:
    """A sketch as one of half as many bits, where it has more words than ``size``."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def _may_be_similar(na: Column, nb: Column, a: Column, b: Column) -> Column:
    """Never false for similar sets: their sizes are near, and odd bits of the joint sketch are no more than their difference."""
    words = F.least(F.size(a), F.size(b))
    odd = F.aggregate(F.zip_with(_folded(a, words), _folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT
    return near & ((100 + PERCENT) * odd <= (100 - PERCENT) * (na + nb))


def _similar(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.lit(100) * common >= F.lit(PERCENT) * (F.size(a) + F.size(b) - common)


def _links(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """pairs: a, b. Those whose sets are similar."""

    def side(name: str, *columns: str) -> DataFrame:
        return elements.select(F.col("set").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    near = stored(near.where(_may_be_similar(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"))).select("a", "b"), "near")
    return near.join(side("a", "features"), "a").join(side("b", "features"), "b").where(_similar(F.col("features_a"), F.col("features_b"))).select("a", "b")


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """Of signatures (key, name) with the same sets, one; sets are told by three sums of hashes and their number."""
    sums = [F.sum(F.shiftright(F.xxhash64("name", F.lit(i)), 20)).alias(f"h{i}") for i in range(3)]
    members = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums)
    keys = members.groupBy("n", "h0", "h1", "h2").agg(F.min("key").alias("key")).where("n > 1").select("key")
    # sets by how many signatures they share: an original before its edited copies
    degree = shared.groupBy("name").agg((-F.count(F.lit(1))).alias("d"))
    return shared.join(keys, "key", "left_semi").join(degree, "name").select("key", "name", "d")


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node of an edge (a, b) the least node that it is connected with.

    Every step takes the least root among neighbours and then that root's own root, so paths
    halve and few steps are needed.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("mid"))
        jumped = lower.join(roots.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid").select("node", "root", F.least("mid", "far").alias("new"))
        step = stored(jumped, "roots")
        changed = step.where(F.col("new") != F.col("root")).limit(1).count()
        roots = step.select("node", F.col("new").alias("root"))
        if not changed:
            return roots


def _several_roots(buckets: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of a bucket that have different roots, in pieces of bounded size; those of small buckets once."""
    n = len(root)
    sizes = np.array([len(x) for x in buckets])
    codes = np.zeros(0, np.int64)
    for size in np.unique(sizes[sizes <= SMALL_BUCKET]):
        i, j = np.triu_indices(size, 1)
        rows = np.stack([buckets[x] for x in np.flatnonzero(sizes == size)])
        step = max(1, PAIRS_AT_ONCE // len(i)) if len(i) else len(rows)
        for at in range(0, len(rows), step):
            a, b = rows[at : at + step, i].ravel(), rows[at : at + step, j].ravel()
            differ = root[a] != root[b]
            a, b = a[differ], b[differ]
            codes = np.union1d(codes, np.minimum(a, b) * n + np.maximum(a, b))
            if len(codes) > PAIRS_AT_ONCE:
                yield codes // n, codes % n
                codes = codes[:0]
    yield codes // n, codes % n
    done: set[bytes] = set()
    for x in np.flatnonzero(sizes > SMALL_BUCKET):
        members = buckets[x]
        if (name := members.tobytes()) in done:
            continue
        done.add(name)
        # the sets of the largest root come last and so are never compared with each other
        _, own, count = np.unique(root[members], return_inverse=True, return_counts=True)
        order = np.lexsort((own, count[own]))
        members, own = members[order], own[order]
        begins = run_starts(own)
        end = np.repeat([*begins[1:], len(own)], np.diff([*begins, len(own)]))
        at = 0
        while at < begins[-1]:
            upto = at + 1
            while upto < begins[-1] and (upto + 1 - at) * (len(own) - at) <= PAIRS_AT_ONCE:
                upto += 1
            left = len(own) - end[at:upto]
            a = np.repeat(np.arange(at, upto), left)
            b = np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left) + np.repeat(end[at:upto], left)
            yield members[a], members[b]
            at = upto


def _left(a: np.ndarray, b: np.ndarray, size: np.ndarray, folded: dict[int, np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs those that the sketches leave, with the odd bits of the two."""
    near = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * PERCENT
    a, b = a[near], b[near]
    odd = np.zeros(len(a), np.int64)
    common = np.minimum(length[a], length[b])
    for n, words in folded.items():
        of = np.flatnonzero(common == n)
        for at in range(0, len(of), PAIRS_AT_ONCE // 16):
            i = of[at : at + PAIRS_AT_ONCE // 16]
            odd[i] = np.bitwise_count(words[a[i]] ^ words[b[i]]).sum(axis=1, dtype=np.int64)
    left = (100 + PERCENT) * odd <= (100 - PERCENT) * (size[a] + size[b])
    return a[left], b[left], odd[left]


def _folded_words(words: np.ndarray, length: np.ndarray) -> dict[int, np.ndarray]:
    """For each length of a sketch, all sketches as long or longer, folded to it."""
    begin, lengths = np.cumsum(length) - length, np.unique(length)
    out = {}
    for n in lengths:
        out[int(n)] = np.zeros((len(length), n), np.uint64)
        for longer in lengths[lengths >= n]:
            x = np.flatnonzero(length == longer)
            out[int(n)][x] = np.bitwise_xor.reduce(words[begin[x][:, None] + np.arange(longer)].reshape(len(x), -1, n), axis=1)
    return out


def _nearest(a: np.ndarray, b: np.ndarray, odd: np.ndarray, nearest: int) -> np.ndarray:
    """Whether a pair is among the ``nearest`` of one of its two."""
    kept = np.zeros(len(a), bool)
    for side, other in ((a, b), (b, a)):
        order = np.lexsort((other, odd, side))
        begins = run_starts(side[order])
        kept[order] |= np.arange(len(a)) - np.repeat(begins, np.diff([*begins, len(a)])) < nearest
    return kept


def _compared(nearest: int | None):
    """Of sets with the buckets they are in, pairs a, b that the sketches leave, and whether there are more."""

    def run(table: pa.Table) -> pa.Table:
        high, low, root_high, root_low, size = (table.column(n).to_numpy() for n in ("high", "low", "root_high", "root_low", "n"))
        _, root = np.unique(np.stack([root_high, root_low], axis=1), axis=0, return_inverse=True)
        keys, sets = flat(table, "buckets"), np.repeat(np.arange(table.num_rows), sizes_of(table, "buckets"))
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        buckets = np.split(sets, run_starts(keys)[1:]) if len(keys) else []
        length = sizes_of(table, "words")
        folded = _folded_words(flat(table, "words").view(np.uint64), length)
        found = [_left(a, b, size.astype(np.int64), folded, length) for a, b in _several_roots(buckets, root.ravel())]
        a, b, odd = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        codes, first = np.unique(np.minimum(a, b) * table.num_rows + np.maximum(a, b), return_index=True)
        a, b, odd = a[first], b[first], odd[first]
        cut = False
        if nearest is not None and len(a):
            kept = _nearest(a, b, odd, nearest)
            cut = not kept.all()
            a, b = a[kept], b[kept]
        # the greater set first
        swap = (high[a] < high[b]) | ((high[a] == high[b]) & (low[a] < low[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table([pa.array(high[a]), pa.array(low[a]), pa.array(high[b]), pa.array(low[b]), pa.array(np.full(len(a), cut))], ["a_high", "a_low", "b_high", "b_low", "cut"])

    return run


def _left_by_sketches(labelled: DataFrame, elements: DataFrame, nearest: int | None) -> DataFrame:
    """a, b, cut: pairs to compare, of signatures (key, set, by, root) with several roots.

    Signatures with the same first set lie in one part, or in a few where they are many, so
    that pairs of a family meet once or a few times, not for each of their signatures.
    """
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members"), F.min("by").alias("first"))
    open_keys = open_keys.where("x <> y").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    families = open_keys.groupBy("first").agg(F.sum(F.col("members") * F.col("blocks")).alias("family"))
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("family") / HELD_SETS)).cast("int")
    dealt = stored(open_keys.join(families, "first").select("key", "blocks", "members", F.xxhash64("first", salt).alias("part")), "open")
    parts = (dealt.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0) // HELD_SETS + 1
    rows = labelled.join(dealt, "key").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    part = F.when(F.col("blocks") > 1, bucket).otherwise(F.col("part"))
    of_sets = rows.groupBy(F.pmod(part, F.lit(parts)).alias("part"), "set").agg(F.first("root").alias("root"), F.collect_list(bucket).alias("buckets"))
    blocks = of_sets.join(elements.select("set", "n", "words"), "set")
    blocks = blocks.select("part", "set.high", "set.low", F.col("root.high").alias("root_high"), F.col("root.low").alias("root_low"), "n", "words", "buckets")
    found = blocks.groupBy("part").applyInArrow(_compared(nearest), "a_high bigint, a_low bigint, b_high bigint, b_low bigint, cut boolean")
    sides = [F.struct(F.col(f"{x}_high").alias("high"), F.col(f"{x}_low").alias("low")).alias(x) for x in "ab"]
    return found.select(*sides, "cut").groupBy("a", "b").agg(F.max("cut").alias("cut"))


def _connected(shared: DataFrame, elements: DataFrame) -> DataFrame:
    """set, root: the components of all sets that share signatures (key, set) and have a link."""
    least = shared.groupBy("key").agg(F.min("by").alias("first"))
    first = shared.join(least, "key").where(F.col("by") > F.col("first")).groupBy(F.col("set").alias("x")).agg(F.min("first").alias("first"))
    first = first.select("x", F.col("first.set").alias("y"))
    compared = stored(first.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs")
    links = stored(_links(compared, elements), "links")
    for nearest in NEAREST:
        roots = components(links).withColumnsRenamed({"node": "set"})
        labelled = shared.join(roots, "set", "left").select("key", "set", "by", F.coalesce("root", "set").alias("root"))
        pairs = stored(_left_by_sketches(labelled, elements, nearest), "pairs")
        cut = pairs.where("cut").limit(1).count()
        pairs = pairs.select("a", "b").join(compared, ["a", "b"], "left_anti")
        links = stored(links.unionByName(_links(pairs, elements)), "links")
        compared = compared.unionByName(pairs)
        if not cut:
            break
    return components(links).withColumnsRenamed({"node": "set"})


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, representative, row_hash (xxhash64 of the text).

    * component_id is the least doc_id that links reach; representative is true for the
      rows with it. A document without words has no shingles and no link.
    * Rows that repeat a doc_id are documents of their own, and so are rows without one;
      their component_id is the least id in their component, null if none has one.
    * A null text counts as empty. An empty table gives an empty result. Other columns are
      not read. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    groups = int(total // GROUP_BYTES) + int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.select("doc_id", "row_hash", "text").mapInArrow(_signed(groups), _SENT)
    met = stored(signed.groupBy("part").applyInArrow(_met, _MET), "signatures", "kind")
    found = met.where("kind = 1").select("id", "row", "name", F.struct("high", "low").alias("set"), "size")
    shared = stored(_rarest(met.where("kind = 0")), "shared")
    groups_of_names = stored(_distinct_groups(shared), "groups")
    wanted = groups_of_names.select("name").distinct()
    first_rows = found.where("size > 0").join(wanted, "name").groupBy("name", "set").agg(F.min(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "row")).alias("first"))
    first_rows = first_rows.select("name", "set", F.col("first.id").alias("_id"), F.col("first.row").alias("_row"))
    texts = rows.join(first_rows, (F.coalesce("doc_id", F.lit(0)) == F.col("_id")) & (F.col("row_hash") == F.col("_row"))).select("name", "set", "text")
    elements = stored(texts.mapInArrow(_features, _ELEMENTS).dropDuplicates(["set"]), "elements")
    sets_of_names = groups_of_names.join(elements.select("name", "set"), "name")
    roots = _connected(stored(sets_of_names.select("key", "set", F.struct("d", "set").alias("by")), "groups"), elements)
    sets = found.groupBy("set").agg(F.min("id").alias("least")).join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    of_root = sets.groupBy("root").agg(F.min("least").alias("component"))
    of_set = sets.join(of_root, "root").select("set", "component")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    out = found.join(of_set, "set").select(F.col("id").alias("doc_id"), F.col("size").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col("row").alias("row_hash"))
    return out.withColumn("representative", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their components, with all their columns."""
    kept = jaccard_components(docs, doc_id, text).where("representative").select(F.col("doc_id").alias("_kept_id"), F.col("row_hash").alias("_kept_hash")).distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_of(text)) == F.col("_kept_hash")), "left_semi")
