"""Toxicity from class-conditional Kneser-Ney models: length-normalised log-likelihoods of toxic and ordinary text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import ngrams
from waymark.llm.text import documents, fold, map_slices
from waymark.session import cut

SAMPLE_ROWS = 10_000  # labelled rows of each class that teach the models, about; fewer where there are fewer
TUNING_ROWS = 3_000  # rows of each class that place the scale of the scores, about
CLIP, STRONG = 6.0, 2.0  # natural-log units that a token moves a text by at most, and from which it is a strong sign
FEATURES = 6


@dataclass
class Model:
    toxic: ngrams.Model
    ordinary: ngrams.Model
    weights: tuple[float, ...] = ()  # of the features and the constant; without them every text gets ``constant``
    constant: float = 0.0


class _Words:
    """What one class knows of the distinct words of a slice."""

    def __init__(self, model: ngrams.Model, distinct: np.ndarray):
        self.model, self.ids = model, model.word_ids(distinct)
        self.count = model.word_values(self.ids, "c", np.int64)
        self.n1, self.n2, self.n3, self.cont = (model.word_values(self.ids, f"{k}_", np.uint32).astype(float) for k in ngrams.STATS)

    def logs(self, shared: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probability of every token after the one before it, and without that: the class's bigrams back off to its words,
        these to the words of both classes."""
        m = self.model
        low = np.maximum(self.cont - ngrams.discount(self.cont, m.low_discounts), 0) / max(m.continuations, 1) + m.low_backoff * shared
        backoff = (m.discounts[0] * self.n1 + m.discounts[1] * self.n2 + m.discounts[2] * self.n3) / np.maximum(self.count, 1)
        total, weight = np.roll(self.count[at], 1).astype(float), np.roll(backoff[at], 1)
        total[starts] = m.documents
        weight[starts] = sum(d * n for d, n in zip(m.discounts, m.start, strict=True)) / max(m.documents, 1)
        keys, back = np.unique(ngrams.mix(ngrams.pairs(self.ids[at], starts)), return_inverse=True)
        seen = m.pair_counts(keys)[back].astype(float)
        high = np.maximum(seen - ngrams.discount(seen, m.discounts), 0) / np.maximum(total, 1) + weight * low[at]
        return np.log(np.where(total > 0, high, low[at])), np.log(low[at])


def features(model: Model, bodies: pa.Array) -> np.ndarray:
    """Per text, by bigrams and by words: the difference of the classes' log-likelihoods over the length, and that of its strong
    signs, each word once, over the length and over the length's root."""
    hashes, starts = ngrams.with_ends(bodies)
    distinct, at = np.unique(hashes, return_inverse=True)
    classes = [_Words(m, distinct) for m in (model.toxic, model.ordinary)]
    types = sum(c.model.continuations for c in classes) + sum(c.model.distinct for c in classes)
    shared = (sum(c.cont for c in classes) + 1) / (types + 1)
    n = np.diff([*starts, len(at)])
    _, first = np.unique(np.repeat(np.arange(len(n)), n) * len(distinct) + at, return_index=True)
    out = []
    for toxic, ordinary in zip(*(c.logs(shared, at, starts) for c in classes), strict=True):
        ratio = np.clip(toxic - ordinary, -CLIP, CLIP)
        strong = np.zeros(len(at))
        strong[first] = np.maximum(ratio[first] - STRONG, 0)
        signs = np.add.reduceat(strong, starts)
        out += [np.add.reduceat(ratio, starts) / n, 10 * signs / n, signs / np.sqrt(n)]
    return np.column_stack(out)


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each class, by a hash of the id: all where there are fewer."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = lambda c: F.lit(int(min(1.0, most / max(n.get(c, 0), 1)) * 2**20))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0))).withColumn(
        "of", F.when(F.col("toxic") == 1, F.lit(float(n.get(1, 0)))).otherwise(F.lit(float(n.get(0, 0))))
    )


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, tuning_rows: int = TUNING_ROWS) -> Model:
    """Learn from labelled documents outside the fold ``held_out`` of ``parts``; labels other than 0 and 1, and null ids, teach nothing.

    A bounded sample teaches, ``sample_rows`` of each class, and other rows of the next fold, ``tuning_rows`` of each, place the scale. An id labelled
    more than once is toxic if any label says so. Without toxic rows every score is 0, without ordinary ones only it is 1.
    """
    tuning = (held_out + parts - 1) % parts
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.withColumn("fold", fold("doc_id", parts)).where(F.col("fold") != held_out)
    chosen = _sampled(marked.where(F.col("fold") != tuning), sample_rows).unionByName(_sampled(marked.where(F.col("fold") == tuning), tuning_rows))
    # bounded by the two parameters, so small enough for every task
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    taught = sample.where(F.col("fold") != tuning)
    model = Model(*(ngrams.fit(taught.where(F.col("toxic") == c)) for c in (1, 0)))
    if not model.toxic.documents or not model.ordinary.documents:
        model.constant = float(model.toxic.documents > 0)
        return model
    told = sample.where(F.col("fold") == tuning).select(F.col("text").cast("binary").alias("body"), "toxic", "of")

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = features(model, batch.column(0))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, found.T)], ["toxic", "of", *names])

    names = [f"f{i}" for i in range(FEATURES)]
    rows = map_slices(told, "toxic int, of double, " + ", ".join(f"{c} double" for c in names), lambda: look).toPandas()  # a bounded sample
    model.weights = _logistic(rows[names].to_numpy(), rows["toxic"].to_numpy(float), rows["of"].to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, of: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method; each class counts as many rows as it has outside the sample."""
    x = np.column_stack([x, np.ones(len(x))])
    count = np.where(y == 1, max((y == 1).sum(), 1), max((y == 0).sum(), 1))
    weight = of / count
    weight = weight / max(weight.sum(), 1e-9) * len(y)
    w = np.array([0.0, 0.0, 0.0, 0.0, 1.0, 1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the chance that a label says toxic, 0 to 1.

    A null text is an empty one, and is scored as such. Rows are answered each.
    """

    def make():
        opened = Model(ngrams.opened(model.toxic), ngrams.opened(model.ordinary), model.weights, model.constant)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if model.weights:
                x = features(opened, batch.column(1)) @ np.array(model.weights[:-1]) + model.weights[-1]
                found = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            else:
                found = np.full(batch.num_rows, model.constant)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

        return run

    return map_slices(documents(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, score double", make)
