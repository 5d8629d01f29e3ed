"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over the form of a text gives each document's evidence. Sites give
the rest: documents belong to a host and, below it, to a path. The rates of good documents
of hosts are drawn from a beta prior around the global rate, those of paths from one around
their host's rate; the strengths of both priors are estimated from the spread of the rates
by moments. Sparse hosts and paths thus shrink towards the level above. A document's
posterior joins its own evidence with its path's rate, from which its own share is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

#: Bound of the labelled sample.
TRAIN_ROWS = 6_000
THRESHOLD = 0.5
#: The evidence of one document is held within this many nats.
MOST_EVIDENCE = 12.0

_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_CLASSES = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 white, 5 sentence marks, 6 other ASCII signs, 0 the rest
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
for _sign in range(33, 127):
    if _CLASSES[_sign] == 0:
        _CLASSES[_sign] = 5 if chr(_sign) in ".,;:!?'\"()-" else 6
FEATURES = 14


def form(text: str) -> list[float]:
    """Features of the whole text; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    data = text.encode()
    kinds = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=7) / len(data)
    n, distinct = len(words), len(set(words))
    lines = text.split("\n")
    signed = sum([w[-1] in "#$%&*@^~|<>=+_" for w in words])
    return [
        1.0,
        float(np.log1p(n)),
        min(len(text) / n, 60.0) / 10,
        *(float(kinds[i]) for i in (1, 3, 4, 5, 6)),
        float(np.log(distinct / n)),
        signed / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        text.count("!") / n,
        len(set(lines)) / len(lines),
        len(_SENTENCE.findall(text)) / n,
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float  #: log odds of the training labels

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        x = (features - self.mean) / self.scale
        logits = np.hstack([x, x**2, np.ones((len(x), 1))]) @ self.weights
        return np.clip(logits - self.prior, -MOST_EVIDENCE, MOST_EVIDENCE)


def train(features: np.ndarray, good: np.ndarray) -> Classifier:
    """Logistic regression by Newton steps with a ridge; without both labels the evidence is always zero."""
    width = 2 * FEATURES + 1
    if len(good) == 0 or good.min() == good.max():
        return Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(width), 0.0)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1
    x = np.clip((features - mean) / scale, -20, 20)
    x = np.hstack([x, x**2, np.ones((len(x), 1))])
    ridge = np.full(width, 1.0)
    ridge[-1] = 1e-6
    weights = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (good - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    rate = good.mean()
    return Classifier(mean, scale, weights, float(np.log(rate / (1 - rate))))


def _form_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [form(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["quality", "form"])


def learned(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, train_rows: int) -> tuple[Classifier, float]:
    """The classifier, and the global rate of good documents among the labels."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = rows.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("_text"))
    # the sample has train_rows ids at most, and one text for each
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min("_text").alias("_text"))
    found = sample.select("quality", "_text").mapInArrow(_form_rows, "quality int, form array<double>").collect()
    features = np.array([x.form for x in found], float).reshape(len(found), FEATURES)
    good = np.array([x.quality > 0 for x in found], float)
    order = np.lexsort((*features.T, good))
    return train(features[order], good[order]), 0.5 if rate is None else min(max(rate, 1e-3), 1 - 1e-3)


def _evidence(shared):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Classifier = shared.value
        for text in texts:
            found = [form(x) for at in range(0, len(text), 256) for x in text.slice(at, 256).to_pylist()]
            yield pa.array(model.evidence(np.array(found, float).reshape(len(text), FEATURES)))

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rate: float, spread: float, noise: float) -> float:
    """Of a beta prior: from the variance of the rates less what their sizes explain."""
    between = max(spread - noise, 1e-6)
    return min(max(rate * (1 - rate) / between - 1, 1.0), 1e6)


def site_rates(evidence: DataFrame, rate: float) -> DataFrame:
    """evidence: host, path, p. One row per host and path: good, n, host_rate, strength."""
    paths = stored(evidence.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    r = F.col("host_good") / F.col("host_n")
    m = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("g"), F.sum(F.col("host_n") * (r - rate) ** 2).alias("d"), F.sum(r * (1 - r)).alias("e")).first()
    if not m.n:
        return paths.select("host", "path", "good", "n", F.lit(rate).alias("host_rate"), F.lit(1.0).alias("strength"))
    overall = min(max(m.g / m.n, 1e-3), 1 - 1e-3)
    of_hosts = _strength(overall, m.d / m.n, m.e / m.n)
    shrunk = hosts.select(F.col("host").alias("_h"), ((F.col("host_good") + of_hosts * overall) / (F.col("host_n") + of_hosts)).alias("host_rate"))
    joined = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", "good", "n", "host_rate")
    r = F.col("good") / F.col("n")
    w = joined.agg(F.sum(F.col("n") * (r - F.col("host_rate")) ** 2).alias("d"), F.sum(r * (1 - r)).alias("e")).first()
    return joined.withColumn("strength", F.lit(_strength(overall, w.d / m.n, w.e / m.n)))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, evidence, site_rate, quality, kept.

    * quality is the posterior probability that the document is good; kept holds where it
      is ``threshold`` or more. evidence is the text's own log likelihood ratio, site_rate
      the shrunk rate of its path without it.
    * ``labels`` has doc_id and quality (above 0: good); of repeated ids the least counts.
      The classifier learns from ``train_rows`` labelled documents at most.
    * Null or empty texts, and texts without words, have the features zero; very long texts
      are measured whole. A null host or
      path is a site of its own. Repeated rows each count. An empty table gives an empty
      result; without labels of both kinds all evidence is zero.
    """
    model, rate = learned(docs, labels, doc_id, text, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), host.alias("host"), path.alias("path"), *named, text_of(text).alias("_text"))
    prior = float(np.log(rate / (1 - rate)))

    # only the text goes to Python; each is read and scored once
    scored = stored(rows.withColumn("_evidence", _evidence(shared)("_text")).drop("_text"), "evidence")
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("_evidence") - prior)))
    sites = site_rates(scored.select("host", "path", "p"), rate).withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    others = (F.col("good") - F.col("p") + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    site = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-F.col("_evidence") - _log_odds(F.col("site_rate"))))
    out = joined.withColumn("site_rate", site).withColumn("quality", posterior)
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select("doc_id", *kept, F.col("_evidence").alias("evidence"), "site_rate", "quality", (F.col("quality") >= threshold).alias("kept"))
