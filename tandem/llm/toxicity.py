"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_digest
from .words import U64, in_chunks, mix, segment

#: Hashed features; feature 0 is the bias.
CELLS = 1 << 22
#: Labelled rows learnt from, at most: those of the smallest xxhash64(doc_id).
MAX_TRAIN = 30_000
#: L1 is large enough that a cell of few rows never gets a weight.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 3.0, 1.0
#: What names a row to learn from.
KEYS = ["doc_id", "digest", "toxic"]


def features(texts: list) -> list[np.ndarray]:
    """Each text's distinct cells: words, neighbouring pairs, and pairs one word apart."""
    out = []
    for begin, end in in_chunks(texts):
        words = segment(texts[begin:end], "letters")
        h = words.hashes()
        pair = mix(h[:-1] * U64(3) + h[1:] * U64(5))
        skip = mix(h[:-2] * U64(7) + h[2:] * U64(11))
        for a, b in zip(words.first, words.first[1:]):
            own = np.concatenate([h[a:b], pair[a : max(a, b - 1)], skip[a : max(a, b - 2)]])
            out.append(np.concatenate([[0], np.unique((own % U64(CELLS - 1)).astype(np.int64)) + 1]))
    return out


class Ftrl:
    """Per-coordinate rates; a coordinate stays 0 until its gradient sum passes L1."""

    def __init__(self):
        self.z, self.n = np.zeros(CELLS), np.zeros(CELLS)

    def weights(self, at):
        z = self.z[at]
        over = np.abs(z) - np.where(at == 0, 0, L1)
        return np.where(over > 0, -np.sign(z) * over / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def learn(self, at, label):
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def digest_of(text: Column) -> Column:
    return F.coalesce(text_digest(text), F.lit(b""))


def chosen_rows(marked: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """At most ``max_train`` different rows of ``doc_id, digest, toxic``."""
    return marked.where("toxic is not null").select(*KEYS).distinct().orderBy(F.xxhash64("doc_id"), *KEYS).limit(max_train)


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """``doc_id, text, toxic`` -> the cells with a weight, and the weights."""
    return fit_chosen(labelled, chosen_rows(labelled.withColumn("digest", digest_of(F.col("text"))), max_train))


def fit_chosen(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Learn from the rows of ``docs(doc_id, text)`` that ``chosen(doc_id, digest, toxic)`` names, each row of it once.

    ``chosen`` is broadcast, so texts stay where they lie. Online learning is
    sequential, so its rows meet in one task, as features. Each epoch takes
    them in another order.
    """
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest"), "text")
    rows = rows.join(F.broadcast(chosen), ["doc_id", "digest"]).select(*KEYS, "text")  # as many keys as are learnt from

    def extract(batches):
        told = set()  # at most the keys chosen
        for batch in batches:
            own = list(zip(*[c.to_pylist() for c in batch.columns[:3]]))
            batch = batch.filter(pa.array([k not in told and not told.add(k) for k in own], pa.bool_()))
            found = [x.astype("<i4").tobytes() for x in features(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=[*KEYS, "cells"])

    def learn(batches):
        model, seen, last = Ftrl(), [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != last:  # rows come sorted, so repeats from several tasks stand together
                    seen.append(row[2:])
                last = row[:3]
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(seen)):
                model.learn(np.frombuffer(seen[i][1], "<i4"), seen[i][0])
        w = model.weights(np.arange(CELLS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["cell", "weight"])

    found = rows.mapInArrow(extract, "doc_id long, digest binary, toxic int, cells binary")
    # The chosen rows meet here; sorted, so that the weights do not depend on the partitioning.
    one = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), *KEYS)
    table = one.mapInArrow(learn, "cell long, weight double").toPandas()
    return table["cell"].to_numpy(np.int64), table["weight"].to_numpy(float)


def score(docs: DataFrame, cells: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` for every whole text; a null or empty text scores by the bias alone.

    The weights are the few that L1 left over: they are broadcast, and CELLS
    bounds them. Without any, all scores are 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast((cells, weights.astype(np.float32)))

    def run(batches):
        at, w = shared.value
        dense = np.zeros(CELLS, np.float32)
        dense[at] = w
        for batch in batches:
            sums = np.array([dense[x].sum(dtype=np.float64) for x in features(batch.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents that are not held out, score all documents.

    One row for each row of ``docs``, repeated ones too. A doc_id labelled both
    ways counts as toxic; without labels all scores are 0.5. Other columns are
    not looked at; an empty table gives an empty result.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Rows are chosen by their keys alone: no text is moved to meet its label.
    train = docs.where(~held_out("doc_id")).select("doc_id", "text")
    chosen = chosen_rows(train.select("doc_id", digest_of(F.col("text")).alias("digest")).join(known, "doc_id"))
    cells, weights = fit_chosen(train, chosen)
    return score(docs, cells, weights).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
