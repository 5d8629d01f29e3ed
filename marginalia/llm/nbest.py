"""N-best SentencePiece segmentation, and decoding.

A text is a lattice whose edges are the model's pieces, and a segmentation is a path; its
score is the sum of its pieces' scores. A forward Viterbi pass gives each position the best
score of any path that reaches it. These scores are exact heuristics for an A* search from
the end backwards: it finishes paths in order of their whole scores, so the first N that
finish are the N best.

No piece of the model goes on past a space, touches a line feed, or joins a letter to
another sign, so each lattice falls into parts there, and the N best paths of a text are
the N best combinations of paths of its parts. A part's loss, by which its second best path
falls behind, comes from the forward pass and its mirror image; only the N - 1 parts that
lose least can differ from the best in any of the N best, so only they are searched.
Workers keep what they know of parts in bounded caches.

A unigram model's pieces score their log probabilities. The pieces of a BPE model have no
probabilities, only the ranks of their merges; they get those of Zipf's law, by which a
piece is as likely as its rank is low. The best path is then that of a unigram model with
such probabilities, not the sequence of merges that the library applies.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

N_BEST = 4
CACHE_SIZE = 800_000
#: An unknown character's score lies so much below the least score of a piece.
UNKNOWN_PENALTY = 10.0
#: Added to ranks in Zipf's law (Mandelbrot's form), so that the first few differ less.
ZIPF_OFFSET = 2.7

_models: dict[str, "Pieces"] = {}
_INNER_SPACE = re.compile(r"[^ ] ")
_MIXED = regex.compile(r"\p{L}[^\p{L} ]|[^\p{L} ]\p{L}")
_SMALLEST = regex.compile(r" *(?:\p{L}+|[^\p{L} ]+)| +")

_SCORE, _LOSS, _IDS = itemgetter(0), itemgetter(1), itemgetter(2)

Path = tuple[float, tuple[int, ...]]
#: Of a part: best score, loss of the second best path (infinite without one), its best ids as bytes.
Known = tuple[float, float, bytes]


def log_probabilities(scores: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """Scores of a unigram model as they are; those of a BPE model, whole numbers that fall by one, as log probabilities by Zipf's law."""
    ranks = sorted({-score for score, _ in scores.values()})
    if not all(float(r).is_integer() for r in ranks):
        return scores
    total = np.log(sum(1 / (r + ZIPF_OFFSET) for r in ranks))
    return {piece: (float(-np.log(ZIPF_OFFSET - score) - total), i) for piece, (score, i) in scores.items()}


class Pieces:
    """The pieces of a SentencePiece model, and the segmentation of texts into them."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(n):
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                self.scores[piece] = (model.get_score(i), i)
                self.bytes_of[i] = piece.encode()
        self.scores = log_probabilities(self.scores)
        if any(_INNER_SPACE.search(p) or "\n" in p or _MIXED.search(p) for p in self.scores):
            raise ValueError(f"{path}: a piece goes on past a space, holds a line feed or joins letters to other signs")
        #: Pieces as in ``scores``, and with None every beginning of one.
        self.beginnings: dict[str, tuple[float, int] | None] = {p[:i]: None for p in self.scores for i in range(1, len(p))}
        self.beginnings.update(self.scores)
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.chunks: dict[str, Known] = {}
        self.parts: dict[str, Known] = {}
        self.searched: dict[str, list[Path]] = {}
        self.cache_size = cache_size

    # -- one part ------------------------------------------------------------------

    def lattice(self, part: str) -> tuple[list[tuple[int, int, float, tuple[int, ...]]], list[float]]:
        """Edges (start, end, score, ids) in order of start, and the forward Viterbi scores of all positions."""
        beginnings, scores, size = self.beginnings, self.scores, len(part)
        edges = []
        forward = [float("-inf")] * (size + 1)
        forward[0] = 0.0
        for start in range(size):
            here = forward[start]
            for end in range(start + 1, size + 1):
                piece = part[start:end]
                if piece not in beginnings:
                    break
                if found := beginnings[piece]:
                    score = found[0]
                    edges.append((start, end, score, found[1:]))
                    if here + score > forward[end]:
                        forward[end] = here + score
            if part[start] not in scores:
                edges.append((start, start + 1, self.unknown, tuple([self.byte_ids[b] for b in part[start].encode()])))
                forward[start + 1] = max(forward[start + 1], here + self.unknown)
        return edges, forward

    def best_paths(self, part: str, n: int) -> list[Path]:
        """The n best segmentations in order; of equal ones always the same come first."""
        edges, forward = self.lattice(part)
        into: list[list[tuple[int, int, float, tuple[int, ...]]]] = [[] for _ in forward]
        for edge in edges:
            into[edge[1]].append(edge)
        # heap of (- best whole score through here, order of entry, position, score behind, rest of the path)
        order, out = 0, []
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], 0, len(part), 0.0, None)]
        while heap and len(out) < n:
            _, _, at, behind, rest = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while rest is not None:
                    ids += rest[0]
                    rest = rest[1]
                out.append((behind, tuple(ids)))
                continue
            for start, _, score, ids in into[at]:
                order += 1
                heapq.heappush(heap, (-(forward[start] + score + behind), order, start, score + behind, (ids, rest)))
        return out

    def _known(self, part: str) -> Known:
        """A path other than the best has an edge off it, so the best path through such an edge is the second."""
        edges, forward = self.lattice(part)
        if len(edges) == 1:
            return forward[-1], float("inf"), array("I", edges[0][3]).tobytes()
        backward = [float("-inf")] * len(forward)
        backward[-1] = 0.0
        step: list[tuple | None] = [None] * len(forward)
        for edge in reversed(edges):
            start, end, score, _ = edge
            score += backward[end]
            if score > backward[start]:
                backward[start] = score
                step[start] = edge
        best, at, ids, on_path = forward[-1], 0, array("I"), set()
        while at < len(part):
            on_path.add(step[at])
            ids.extend(step[at][3])
            at = step[at][1]
        second = max([forward[start] + score + backward[end] for start, end, score, i in edges if (start, end, score, i) not in on_path], default=float("-inf"))
        return best, best - second, ids.tobytes()

    def _chunk(self, key: str) -> Known:
        known = []
        for part in _SMALLEST.findall(_text(key)):
            if part not in self.parts:
                self.parts[part] = self._known(part)
            known.append(self.parts[part])
        return sum([x[0] for x in known]), min([x[1] for x in known]), b"".join([x[2] for x in known])

    def _search(self, part: str, n: int) -> list[Path]:
        found = self.searched.get(part)
        if found is None or len(found) < n:
            found = self.best_paths(part, n)
            # of equally good paths the one that stands for the part comes first
            own = tuple(np.frombuffer(self.parts[part][2], "<u4").tolist())
            found = self.searched[part] = [(found[0][0], own), *(p for p in found if p[1] != own)]
        return found[:n]

    # -- whole texts ---------------------------------------------------------------

    def encode(self, text: str, n: int) -> tuple[list[bytes], list[float], list[dict[tuple[int, int], tuple[int, ...]]], list[str]]:
        """Best ids of each chunk as bytes, the n best scores, for each of them the parts that differ from the best, and the chunks."""
        keys = _keys(text)
        chunks = self.chunks
        for cache in (chunks, self.parts, self.searched):
            if len(cache) > self.cache_size:
                cache.clear()
        try:
            found = list(map(chunks.__getitem__, keys))
        except KeyError:
            for key in keys:
                if key not in chunks:
                    chunks[key] = self._chunk(key)
            found = list(map(chunks.__getitem__, keys))
        best = sum(map(_SCORE, found))
        combined: list[tuple[float, dict]] = [(0.0, {})]
        for _, at, i, part in self._near(list(map(_LOSS, found)), keys, n - 1):
            paths = self._search(part, n)
            longer = [(loss + paths[0][0] - score, changed | ({(at, i): ids} if j else {})) for loss, changed in combined for j, (score, ids) in enumerate(paths)]
            combined = sorted(longer, key=lambda x: x[0])[:n]
        return list(map(_IDS, found)), [best - loss for loss, _ in combined], [changed for _, changed in combined], keys

    def _near(self, losses: list[float], keys: list[str], n: int) -> list[tuple[float, int, int, str]]:
        """The n parts that lose least: (loss, chunk, part of the chunk, text)."""
        if n < 1:
            return []
        limit = sorted(losses)[:n][-1]
        # the n chunks up to the limit hold n parts, so no more than n that lose just as much as it can matter
        near = [at for at, loss in enumerate(losses) if loss < limit]
        if limit < float("inf"):
            near += [at for at, loss in enumerate(losses) if loss == limit][:n]
        parts = []
        for at in near:
            for i, part in enumerate(_SMALLEST.findall(_text(keys[at]))):
                if part not in self.parts:
                    self.parts[part] = self._known(part)
                if self.parts[part][1] <= limit:
                    parts.append((self.parts[part][1], at, i, part))
        return sorted(parts)[:n]

    def packed(self, chunks: list[bytes], changed: dict[tuple[int, int], tuple[int, ...]], keys: list[str]) -> bytes:
        """Ids of a segmentation as bytes: the best of each chunk but for the parts that are changed."""
        if changed:
            chunks = chunks.copy()
            for at in {at for at, _ in changed}:
                parts = enumerate(_SMALLEST.findall(_text(keys[at])))
                own = [array("I", changed[at, i]).tobytes() if (at, i) in changed else (self.parts.get(part) or self._known(part))[2] for i, part in parts]
                chunks[at] = b"".join(own)
        return b"".join(chunks)

    def n_best(self, text: str, n: int) -> list[Path]:
        """The n best segmentations of a whole text."""
        chunks, scores, changes, keys = self.encode(text, n)
        return [(score, tuple(np.frombuffer(self.packed(chunks, changed, keys), "<u4").tolist())) for score, changed in zip(scores, changes)]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def _keys(text: str) -> list[str]:
    """Keys of the chunks, in order. A key is its chunk less the leading space, but for those that begin with a line feed."""
    lines = text.replace("\n", " \n")
    if "  " not in lines and not lines.startswith(" "):
        return lines.split(" ")
    # runs of spaces stay with what follows; a line feed is a chunk's first character
    return [x[1:] if x[0] == " " else x for x in re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)]


def _text(key: str) -> str:
    return key if key[:1] == "\n" else " " + key


def loaded(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


_ENCODED = "doc_id bigint, n_pieces bigint, score double, n_best_scores array<double>, ids_crc32 bigint, n_best_crc32 array<bigint>, round_trip boolean, ids array<int>"


def _encoded(path: str, n: int, with_ids: bool, cache_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        model.cache_size = cache_size
        for big in batches:
            for begin in range(0, big.num_rows, 256):
                batch = big.slice(begin, 256)
                columns: tuple[list, ...] = ([], [], [], [], [], [], [])
                for text in batch.column(1).to_pylist():
                    chunks, scores, changes, keys = model.encode(text, n)
                    packed = [model.packed(chunks, changed, keys) for changed in changes]
                    ids, crcs = np.frombuffer(packed[0], "<u4"), list(map(zlib.crc32, packed))
                    row = (len(ids), scores[0], scores, crcs[0], crcs, model.decode(ids.tolist()) == text, ids if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
                types = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in _ENCODED.split(", ")])

    return run


def encoded(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", n_best: int = N_BEST, with_ids: bool = True, cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, score, n_best_scores, ids_crc32, n_best_crc32, round_trip, ids.

    * ids is the best segmentation of a space and the text; n_best_scores holds the scores
      of the ``n_best`` best, fewer where the lattice has fewer paths. Characters without a
      piece of their own become byte pieces. ids_crc32 is over little-endian 32-bit ids,
      n_best_crc32 over those of each of the ``n_best`` (``Pieces.n_best`` gives the ids
      themselves), round_trip whether decoding gives the text again.
    * Of segmentations with equal scores some come first, always the same ones. Very long
      texts are encoded whole; what is held grows with a text's length and its chunks.
    * A null text counts as empty and has the pieces of a single space. Repeated rows and
      null ids give a row each; an empty table gives an empty result. Other columns are
      not read. ids is left out unless ``with_ids``.
    * A worker keeps what it has found of ``cache_size`` parts, also when it goes on to other
      work; less of it costs time and changes nothing else.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    out = rows.mapInArrow(_encoded(model_path, n_best, with_ids, cache_size), _ENCODED)
    return out if with_ids else out.drop("ids")


def decoded(encodings: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text: from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
