"""Token counts by a two-tier lookup on the map side.

A pre-token here is what stands between spaces and line feeds. The first tier is a compact
table of the most frequent pre-tokens of the whole corpus with their token counts; its
size has a fixed bound, so it is broadcast, and workers never drop it. The second tier is
each worker's own bounded cache: what both lack is encoded by the tokenizers library and kept. Pre-tokens are never
shuffled; the frequent ones are found by Misra-Gries summaries of the tasks, of bounded
size, which are all that moves.

Splitting at spaces and line feeds changes no count if the tokenizer drops white space
before it merges and its special strings hold none; ``checked_tokenizer`` tests that.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import WORD_AND_SIGNS, written
from .common import text_of

TABLE_SIZE = 20_000
SUMMARY_SIZE = 4_096
CACHE_SIZE = 300_000
LIMIT = 2048
_ROWS = 256
_MISSES = 4_096

_tokenizers: dict[str, object] = {}
_caches: dict[str, dict[str, int]] = {}


def checked_tokenizer(path: str):
    """The tokenizer at ``path``, once for each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        tokenizer.no_truncation()
        tokenizer.no_padding()
        def length(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)

        if any(length(x) != sum(map(length, x.split())) for x in ("a b", "a\nb", " a", "b\n", "a  \n b")):
            raise ValueError(f"{path}: this tokenizer keeps white space")
        if any(length(x) != len(tokenizer.model.tokenize(written(x.lower()))) for x in ("Word", "Fenêtre", "?!")):
            raise ValueError(f"{path}: this tokenizer isn't byte-level, or cuts words otherwise")
        if any(" " in x or "\n" in x for x in special):
            raise ValueError(f"{path}: a special string holds white space")
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def pre_tokens(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def _encoded_lengths(path: str, words: list[str]) -> list[int]:
    """Token counts of pre-tokens; plain words and signs go straight to the tokenizer's model."""
    tokenizer = checked_tokenizer(path)
    merged = tokenizer.model.tokenize
    out, others = [0] * len(words), []
    for at, word in enumerate(words):
        found = WORD_AND_SIGNS.fullmatch(word)
        if found is None:
            others.append(at)
        else:
            # the normalizer changes nothing in Latin-1 letters but their case
            out[at] = len(merged(written(found[1].lower()))) + (len(merged(written(found[2]))) if found[2] else 0)
    for at in range(0, len(others), _MISSES):
        part = others[at : at + _MISSES]
        for i, x in zip(part, tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
            out[i] = len(x.ids)
    return out


def pruned(counts: Counter, size: int) -> Counter:
    """Misra and Gries: what is left of the ``size`` largest when the next count is taken from all."""
    if len(counts) <= size:
        return counts
    largest = counts.most_common(size + 1)
    less = largest[-1][1]
    return Counter({k: v - less for k, v in largest if v > less})


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(pre_tokens(text))
                if len(counts) > 16 * size:
                    counts = pruned(counts, 4 * size)
        counts = pruned(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def frequent_lengths(texts: DataFrame, path: str, table_size: int = TABLE_SIZE, summary_size: int = SUMMARY_SIZE) -> dict[str, int]:
    """Token counts of the pre-tokens that are most frequent in all of ``texts``; ``table_size`` at most."""
    top = (
        texts.mapInArrow(_summaries(summary_size), "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(table_size)
        .collect()
    )
    words = [x.word for x in top]
    return dict(zip(words, _encoded_lengths(path, words))) if words else {}


def _counts(path: str, frequent: Broadcast, cache_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cache = frequent.value, _caches.setdefault(path, {})
        cache.update(first)
        get = cache.__getitem__
        for big in batches:
            for start in range(0, big.num_rows, _ROWS):
                batch = big.slice(start, _ROWS)
                split = [pre_tokens(x) for x in batch.column(1).to_pylist()]
                if len(cache) > cache_size:
                    cache.clear()
                    cache.update(first)
                misses = list(set().union(*split).difference(cache))
                cache.update(zip(misses, _encoded_lengths(path, misses)))
                n_tokens = [sum(map(get, words)) for words in split]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    table_size: int = TABLE_SIZE,
    summary_size: int = SUMMARY_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are those of the tokenizers library without special tokens added, special
    strings inside texts as its default has them. A null or empty text has no tokens;
    repeated rows and null ids give a row each; other columns are not read.
    """
    checked_tokenizer(tokenizer_path)
    texts = docs.select(text_of(text).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, tokenizer_path, table_size, summary_size))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return rows.mapInArrow(_counts(tokenizer_path, frequent, cache_size), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
