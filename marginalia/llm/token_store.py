"""A content-addressed store of token ids.

Layout of a store at ``path``:

* ``objects/kind=chunk``: unique chunks (digest, n, payload), each stored once. A payload
  is the chunk's ids as little-endian unsigned integers of ``width`` bytes, compressed by
  zstandard; the digest is BLAKE2b over the ids before compression.
* ``recipes``: one row per document in ascending doc_id order, with ``start``, the
  document's chunk digests and the Merkle root over them.
* ``manifest``: a Merkle root and counts for each recipe partition, in order.

Chunks are cut where a rolling hash over the last ``WINDOW`` ids hits a mask, so equal
passages give equal chunks wherever they start. Documents never share a chunk boundary.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytelevel import WORD_AND_SIGNS, written_part
from .common import shuffles_released, stored, text_of

WINDOW = 16
MEAN_CHUNK = 1024
MAX_CHUNK = 8192
CACHE_SIZE = 600_000
END_ID = 0
_DIGEST = 16
_PACK_LEVEL = 1
_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD = 1 << 64
_ADJACENT_WHITE = re.compile(r"\s\s")

_encoders: dict[tuple, "_Encoder"] = {}


class _Encoder:
    """Ids of whole texts as bytes, with a bounded cache of what stands between spaces.

    Byte-level pre-tokenizers cut before each single space or line feed that follows
    another character, so these pieces encode alone as they do in the text. Where two
    white characters meet, or a special string occurs, the whole text is encoded at once.
    """

    def __init__(self, path: str, cache_size: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.line_feed = self._plain(["\n"])[0]
        self.cache_size = cache_size

    def _plain(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        out = []
        for at in range(0, len(texts), 4096):
            out += [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Letters and the signs after them are pre-tokens of their own, so words are merged once, whatever follows them."""
        code = "H" if self.width == 2 else "I"
        known, cache, merged, fits = self.words, self.cache, self.tokenizer.model.tokenize, WORD_AND_SIGNS.fullmatch
        others, asked_others = [], []

        def ids(part: str) -> bytes:
            out = known.get(part)
            if out is None:
                out = known[part] = array(code, [x.id for x in merged(written_part(part))]).tobytes()
            return out

        for piece in pieces:
            first = piece[:1]
            line, asked = first == "\n", piece[1:] if first in ("\n", "\r") else " " + piece
            found = fits(asked)
            if found is None:
                others.append(piece)
                asked_others.append("\n" + asked if line else asked)
                continue
            word, signs = found.groups()
            out = ids(word) + ids(signs) if signs else ids(word)
            cache[piece] = self.line_feed + out if line else out
        cache.update(zip(others, self._plain(asked_others)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        for kept in (self.cache, self.words):
            if len(kept) > self.cache_size:
                kept.clear()
        split: list[list[str] | None] = []
        for text in texts:
            if _ADJACENT_WHITE.search(text) or any([x in text for x in self.special]):
                split.append(None)
            else:
                # the first piece has nothing before it: \r stands for that in the cache's keys
                pieces = text.replace("\n", " \n").split(" ")
                pieces[0] = "\r" + pieces[0]
                split.append(pieces)
        if missing := set().union(*[pieces for pieces in split if pieces]).difference(self.cache):
            self._learn(list(missing))
        whole = iter(self._plain([t for t, pieces in zip(texts, split) if pieces is None]))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) if pieces is not None else next(whole) for pieces in split]


def _encoder(path: str, cache_size: int) -> _Encoder:
    if (path, cache_size) not in _encoders:
        _encoders[path, cache_size] = _Encoder(path, cache_size)
    return _encoders[path, cache_size]


def cut_points(ids: np.ndarray, ends: np.ndarray, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[list[int]]:
    """For each document (it ends at ``ends``, exclusive, in ``ids``) the ends of its chunks.

    A cut depends only on the ``WINDOW`` ids before it, all of the same document, and on
    ``most`` where no cut comes earlier.
    """
    n = len(ids)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found = np.empty(0, np.int64)
    if n >= WINDOW:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        mixed ^= mixed >> np.uint64(29)
        rolling = mixed[WINDOW - 1 :].copy()
        factor = 1
        for back in range(1, WINDOW):
            factor = factor * 0xD6E8FEB86659FD93 % _WORD
            rolling += mixed[WINDOW - 1 - back : n - back] * np.uint64(factor)
        rolling ^= rolling >> np.uint64(32)
        rolling *= np.uint64(_MULTIPLIER)
        found = np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(mean) == 0) + WINDOW
    first = np.searchsorted(found, starts + WINDOW)
    last = np.searchsorted(found, ends, "left")
    out = []
    for start, end, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        cuts, at = [], start
        for cut in [*found[i:j].tolist(), end]:
            while cut - at > most:
                at += most
                cuts.append(at)
            if cut > at:
                at = cut
                cuts.append(cut)
        out.append(cuts)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last one moves up as it is."""
    if not digests:
        return blake2b(b"", digest_size=_DIGEST).digest()
    while len(digests) > 1:
        paired = [blake2b(a + b, digest_size=_DIGEST, person=b"node").digest() for a, b in zip(digests[::2], digests[1::2])]
        digests = paired + digests[len(digests) & ~1 :]
    return digests[0]


def chunk_digest(ids: bytes) -> bytes:
    return blake2b(ids, digest_size=_DIGEST, person=b"chunk").digest()


def _route(doc: int | None, root: bytes) -> int:
    return int.from_bytes(blake2b(f"{doc}".encode() + root, digest_size=8).digest(), "little", signed=True)


_MANIFEST = "part int, n_docs bigint, n_ids bigint, root binary"
_OBJECTS = "kind string, route bigint, digest binary, n bigint, payload binary, doc_id bigint, recipe binary, root binary"
_COLUMNS = ("kind", "route", "digest", "n", "payload", "doc_id", "recipe", "root")
_TYPES = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], list(_COLUMNS))


def _objects(path: str, mean: int, most: int, cache_size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = _encoder(path, cache_size), set()
        kind, end = f"<u{encoder.width}", end_id.to_bytes(encoder.width, "little")
        pack = zstandard.ZstdCompressor(_PACK_LEVEL)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                encoded = [x + end for x in encoder(batch.column(1).to_pylist())]
                whole = b"".join(encoded)
                ids = np.frombuffer(whole, kind)
                ends = np.cumsum([len(x) // encoder.width for x in encoded])
                rows, start = [], 0
                for doc, cuts in zip(batch.column(0).to_pylist(), cut_points(ids, ends, mean, most)):
                    digests, n, begin = [], cuts[-1] - start, start
                    for cut in cuts:
                        chunk = whole[begin * encoder.width : cut * encoder.width]
                        digest = chunk_digest(chunk)
                        digests.append(digest)
                        if digest not in sent:
                            sent.add(digest)
                            rows.append(("chunk", int.from_bytes(digest[:8], "little", signed=True), digest, cut - begin, pack.compress(chunk), None, None, None))
                        begin = cut
                    root = merkle_root(digests)
                    rows.append(("doc", _route(doc, root), None, n, None, doc, b"".join(digests), root))
                    start = cuts[-1]
                if len(sent) > 1_000_000:
                    sent.clear()
                yield _rows(rows)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, the first of each digest; rows without one pass."""
    last = None
    for batch in batches:
        keep = []
        for digest in batch.column(2).to_pylist():
            keep.append(digest is None or digest != last)
            last = digest if digest is not None else last
        yield batch.filter(pa.array(keep))


def _partition_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, roots, n = None, [], 0
    for batch in batches:
        for part, root, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != last and roots:
                yield _manifest(last, roots, n)
                roots, n = [], 0
            last = part
            roots.append(root)
            n += size
    if roots:
        yield _manifest(last, roots, n)


def _manifest(part: int, roots: list[bytes], n: int) -> pa.RecordBatch:
    values = (pa.array([part], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([n], pa.int64()), pa.array([merkle_root(roots)], pa.binary()))
    return pa.RecordBatch.from_arrays(list(values), ["part", "n_docs", "n_ids", "root"])


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    mean_chunk: int = MEAN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    cache_size: int = CACHE_SIZE,
) -> None:
    """Writes the ids of every text, ``end_id`` after each, as a store at ``path``.

    * A null or empty text has the end id alone. Null ids come first; rows that repeat an
      id follow each other, ordered by content, and each has its own recipe.
    * An empty table gives a store without chunks and recipes. Other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    objects = rows.mapInArrow(_objects(tokenizer_path, mean_chunk, max_chunk, cache_size, end_id), _OBJECTS)
    with shuffles_released(spark):
        # chunks meet by digest, recipes are dealt evenly; all in one shuffle
        objects.repartition(n, "route").sortWithinPartitions("kind", "digest").mapInArrow(_once, _OBJECTS).write.partitionBy("kind").parquet(f"{path}/objects")
        recipes = _objects_at(spark, path).where("kind = 'doc'").select("doc_id", "n", "recipe", "root")
        ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
        ordered.select("*", F.spark_partition_id().alias("part")).write.parquet(f"{path}/ordered")
        ordered = spark.read.parquet(f"{path}/ordered")
        totals = ordered.groupBy("part").agg(F.sum("n").alias("n_part"))
        # one row for each partition of the recipes
        before = totals.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))
        within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ordered.withColumn("upto", F.sum("n").over(within)).join(before, "part")
        placed = placed.select("part", "doc_id", (F.col("before") + F.col("upto") - F.col("n")).alias("start"), "n", "recipe", "root")
        placed.repartitionByRange(n, "part", "start").sortWithinPartitions("part", "start").write.parquet(f"{path}/recipes")
        spark.read.parquet(f"{path}/recipes").select("part", "root", "n", "start").repartition(n, "part").sortWithinPartitions("part", "start").drop("start").mapInArrow(
            _partition_roots, _MANIFEST
        ).write.parquet(f"{path}/manifest")


def _objects_at(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(x for x in _OBJECTS.split(", ") if not x.startswith("kind")) + ", kind string"
    return spark.read.schema(schema).parquet(f"{path}/objects")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _objects_at(spark, path).where("kind = 'chunk'").select("digest", "n", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start, n, recipe, root."""
    return spark.read.parquet(f"{path}/recipes")


def _references(found: DataFrame) -> DataFrame:
    """start, at, digest: one row for each chunk of each recipe."""
    number = F.ceil(F.length("recipe") / _DIGEST).cast("int")
    digests = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.substring("recipe", i * _DIGEST + 1, F.lit(_DIGEST)))
    return found.where(number > 0).select("start", F.posexplode(digests).alias("at", "digest"))


def _opened(width: int, with_ids: bool):
    """From chunks as they lie in the files: digest, n, whether the digest is right, CRC of the ids as 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sound, crcs, out = [], [], []
            for digest, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = unpack.decompress(payload)
                sound.append(chunk_digest(ids) == digest and len(ids) == n * width)
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(wide.tobytes()))
                out.append(wide.tobytes() if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sound, pa.bool_()), pa.array(crcs, pa.int64()), pa.array(out, pa.binary())],
                ["digest", "n_ids", "sound", "crc", "ids"],
            )

    return run


def _width(tokenizer_path: str) -> int:
    return _encoder(tokenizer_path, CACHE_SIZE).width


def read_documents(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """doc_id, start, ids (array of long): every document rebuilt from its recipe."""
    found = recipes(spark, path)
    opened = chunks(spark, path).mapInArrow(_opened(_width(tokenizer_path), True), "digest binary, n_ids bigint, sound boolean, crc bigint, ids binary")
    parts = _references(found).join(opened, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    ids = F.pandas_udf(lambda s: s.map(lambda x: np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int64)), "array<bigint>")
    return found.join(parts, "start").select("doc_id", "start", ids("parts").alias("ids"))


# CRC-32 of a sequence from the CRCs of its parts: the first part's remainder is carried
# over the second part's length, a product of polynomials modulo the CRC's.
_CRC_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = (b >> 1) ^ _CRC_POLY if b & 1 else b >> 1
        bit >>= 1
    return product


@lru_cache(100_000)
def _carry(n_bytes: int) -> int:
    power, base, bits = 1 << 31, 1 << 30, 8 * n_bytes
    while bits:
        if bits & 1:
            power = _times(base, power)
        base = _times(base, base)
        bits >>= 1
    return power


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """parts: (crc, bytes) in order."""
    total = 0
    for crc, n_bytes in parts:
        total = _times(_carry(n_bytes), total) ^ crc if total else crc
    return total


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("parts")
        number = lists.value_lengths().fill_null(0).to_numpy()
        parts, ends = lists.flatten(), np.cumsum(number)
        digests = parts.field("digest").to_pylist()
        crc, sound, n_ids, at = (parts.field(n).to_numpy(zero_copy_only=False) for n in ("crc", "sound", "n_ids", "at"))
        order = np.lexsort((at, np.repeat(np.arange(len(number)), number)))
        crc, sound, n_ids = crc[order].tolist(), sound[order], n_ids[order]
        sums = np.concatenate([[0], np.cumsum(n_ids)])
        whole = np.concatenate([[0], np.cumsum(sound)])
        begins = ends - number
        good = (whole[ends] - whole[begins] == number) & (sums[ends] - sums[begins] == batch.column("n_tokens").to_numpy())
        order, sizes = order.tolist(), n_ids.tolist()
        crcs, ok = [], []
        for i, j, fine, root in zip(begins.tolist(), ends.tolist(), good.tolist(), batch.column("root").to_pylist()):
            crcs.append(crc[i] if j - i == 1 else joined_crc([(crc[k], 4 * sizes[k]) for k in range(i, j)]))
            ok.append(fine and merkle_root([digests[order[k]] for k in range(i, j)]) == root)
        columns = [batch.column(x) for x in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64()), pa.array(ok, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])


def partition_checks(spark: SparkSession, path: str) -> DataFrame:
    """part, missing, altered: for each partition of the recipes, how many the manifest has more than there are, and whether they are others.

    ``altered`` holds where there are as many recipes as the manifest says or more, and
    their Merkle root or number of ids isn't the manifest's.
    """
    found = recipes(spark, path).select("part", "root", "n", "start").repartition("part").sortWithinPartitions("part", "start").drop("start")
    found = found.mapInArrow(_partition_roots, _MANIFEST).select("part", *(F.col(c).alias(f"_{c}") for c in ("n_docs", "n_ids", "root")))
    stated = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    there, wanted = F.coalesce("_n_docs", F.lit(0)), F.coalesce("n_docs", F.lit(0))
    same = F.col("root").eqNullSafe(F.col("_root")) & F.col("n_ids").eqNullSafe(F.col("_n_ids"))
    return stated.join(found, "part", "full").select("part", F.greatest(wanted - there, F.lit(0)).alias("missing"), ((there >= wanted) & ~same).alias("altered"))


def read_digests(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified: every stored chunk is read once and checked.

    ``verified`` holds if the digests of the chunks as read give the recipe's Merkle root,
    and the recipes of its partition the manifest's. Each recipe that the manifest counts
    and that isn't there gives a row of nulls, not verified. Only checksums move to the
    recipes, the ids stay where they lie.
    """
    checks = stored(partition_checks(spark, path), "partition-checks")  # one row for each partition of the recipes
    found = recipes(spark, path).join(F.broadcast(checks.where("altered").select("part", "altered")), "part", "left")
    opened = chunks(spark, path).mapInArrow(_opened(_width(tokenizer_path), False), "digest binary, n_ids bigint, sound boolean, crc bigint, ids binary").drop("ids")
    parts = _references(found).join(opened, "digest").groupBy("start").agg(F.collect_list(F.struct("at", "digest", "n_ids", "sound", "crc")).alias("parts"))
    joined = found.select("doc_id", "start", F.col("n").alias("n_tokens"), F.when(F.col("altered").isNull(), F.col("root")).alias("root")).join(parts, "start", "left")
    told = joined.mapInArrow(_verified, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean")
    lost = checks.where("missing > 0").select(F.explode(F.sequence(F.lit(1), "missing")))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    return told.unionByName(lost.select(*none, F.lit(False).alias("verified")))
