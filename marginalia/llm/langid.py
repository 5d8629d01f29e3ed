"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into ``BUCKETS`` rows;
a linear layer and a softmax give the languages. Stochastic gradient descent in numpy
trains embeddings and layer on a bounded sample of labelled rows. A part of the sample is
held back to fit a temperature, so that scores are calibrated, and to choose the score
below which a prediction is rejected. After training, embeddings times layer is one small
table, so a prediction is one lookup for each n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample.
TRAIN_ROWS = 3_000
BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
UNDETERMINED = "und"
#: Of the predictions that are kept, so many are right on the held-back part.
PRECISION = 0.99

_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20


def subword_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often the n-grams of the lower-cased UTF-8 bytes fall into each bucket; slice by slice, over all of the text."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    total = np.zeros(buckets, np.int64)
    most = max(SIZES)
    for at in range(0, len(data), _SLICE):
        part = data[at : at + _SLICE + most - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, most + 1):
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :]
            if n in SIZES:
                mixed = (code[:_SLICE] ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
                total += np.bincount(mixed >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return total


def averaged(text: str, buckets: int = BUCKETS) -> np.ndarray:
    counts = subword_counts(text, buckets)
    return (counts / counts.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        logits = (features @ self.table + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        indices, values = [], []
        for text in batch.column(1).to_pylist():
            x = averaged(text)
            at = np.flatnonzero(x)
            indices.append(at.astype("<u2").tobytes())
            values.append(x[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(indices, pa.binary()), pa.array(values, pa.binary())], ["lang", "at", "value"])


def labelled_sample(labelled: DataFrame, rows: int) -> tuple[list[str], np.ndarray]:
    """labelled: id, lang, text. The ``rows`` rows that a hash of the id puts first, as labels and features."""
    order = F.xxhash64(F.col("id").cast("string"))
    nth = labelled.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if nth is None:
        return [], np.zeros((0, BUCKETS), np.float32)
    # one row for each id, so the bound holds however many rows repeat an id
    chosen = labelled.where(order <= nth).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.lang", "x.text")
    chosen = chosen.mapInArrow(_features, "lang string, at binary, value binary")
    found = sorted(chosen.collect(), key=lambda x: (x["lang"], bytes(x["at"]), bytes(x["value"])))
    features = np.zeros((len(found), BUCKETS), np.float32)
    for row, x in zip(features, found):
        row[np.frombuffer(x["at"], "<u2")] = np.frombuffer(x["value"], "<f4")
    return [x.lang for x in found], features


def train(labels: list[str], features: np.ndarray, seed: int = 7) -> Model:
    """Without any labelled row the model knows no language and predicts ``und`` alone."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    wanted = np.searchsorted(languages, labels)
    order = rng.permutation(len(labels))
    back, fit = order[: len(order) // 5], order[len(order) // 5 :]
    # inputs are averages, so the embeddings take larger steps than the layer
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            x = features[rows]
            hidden = x @ embedding
            logits = hidden @ layer + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), wanted[rows]] -= 1
            p /= len(rows)
            used = np.flatnonzero(x.any(axis=0))
            embedding[used] -= rate * 100 * (x[:, used].T @ (p @ layer.T))
            layer -= rate * (hidden.T @ p)
            bias -= rate * p.sum(axis=0)
    model = Model(languages, embedding @ layer, bias)
    return calibrated(model, features[back], wanted[back])


def calibrated(model: Model, features: np.ndarray, wanted: np.ndarray) -> Model:
    """Temperature by log likelihood; the rejection score by precision on the same held-back rows."""
    if len(wanted):
        grid = np.geomspace(0.05, 20, 61)

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.probabilities(features)[np.arange(len(wanted)), wanted], 1e-12)).mean())

        model.temperature = float(min(grid, key=loss))
        p = model.probabilities(features)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = (p.argmax(axis=1) == wanted)[order]
        precise = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION)
        model.reject_below = float(p.max(axis=1)[order][precise[-1]]) if len(precise) and precise[-1] + 1 < len(right) else 0.0
    return model


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                texts = batch.column(2).to_pylist()
                known = [i for i, x in enumerate(texts) if model.languages and has_letter(x)]
                languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if known:
                    p = model.probabilities(np.stack([averaged(texts[i]) for i in known]))
                    for i, best, score in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                        languages[i], scores[i] = model.languages[best], min(1.0, score)
                accepted = [x != UNDETERMINED and y >= model.reject_below for x, y in zip(languages, scores)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                    ["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    return run


def language_id(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted.

    * The model learns from text and lang of a sample of ``train_rows`` rows that are not
      held out, have a lang and at least one letter; ids only choose the sample.
    * lang_pred is a learned language, or ``und`` with score 0 where the text is null or
      has no letter, or where nothing could be learned. ``accepted`` is false where the
      calibrated score is below the rejection score; lang_pred is given all the same.
    * A null ``held_out`` counts as held out. Equal texts get equal predictions; an empty
      table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    labelled = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").alias("id"), "lang", "text")
    model = train(*labelled_sample(labelled, train_rows))
    # its size is fixed by the number of buckets and languages
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predictions(shared), schema)
