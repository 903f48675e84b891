"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its different words, pairs of adjacent words and pairs with one word between,
each hashed to one of 2^20 places (a word is a run of digits, letters and non-ASCII characters,
lower-cased in A-Z).  FTRL-proximal learns a weight for each place with its own rate, and its L1 term keeps
most of them at zero, so the model that is broadcast is a short list of (place, weight).

The fit uses a bounded sample: ``SAMPLE_ROWS`` labelled texts of at most
``labelled.MAX_SAMPLE_ROW_BYTES`` bytes, passed over ``PASSES`` times in the order of a hash of the id.
Every text is scored whole.

Defined results: a null or empty text has no features and gets the score of the intercept.  Without
labels every score is 0.5.  Repeated rows are scored alike; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow, small_batches, whole_text
from touchline.llm.decontaminate import words_of
from touchline.llm.labelled import held_out, sample
from touchline.llm.words import MULTIPLIERS, numbers

BITS = 20
SAMPLE_ROWS = 12_000
PASSES = 4
ALPHA, BETA, L2 = 0.6, 1.0, 1.0
#: The L1 term grows with the noise of the summed gradients, the root of the number of rows.
L1_PER_ROOT_ROW = 0.1
THRESHOLD = 0.3


def features(text: str) -> np.ndarray:
    """Places of all n-grams and skip-grams of a text, repeats included."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    x = numbers(words)[0]
    parts = [x]
    for gap in (1, 2):
        if len(x) > gap:
            parts.append((x[:-gap] * np.uint64(MULTIPLIERS[0]) + x[gap:]) * np.uint64(2 * gap + 1) + np.uint64(gap))
    return ((np.concatenate(parts) * np.uint64(MULTIPLIERS[1])) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Weights:
    place: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.place] = self.weight
        return out

    def score(self, places: np.ndarray, dense: np.ndarray) -> float:
        heavy = np.unique(places[dense[places] != 0])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, float(dense[heavy].sum()) + self.intercept))))


def fit(rows: list[tuple[str, int]]) -> Weights:
    """From (text, label) rows."""
    if not rows:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    examples = [(np.unique(features(t)).astype(np.int32), y) for t, y in rows]
    l1 = L1_PER_ROOT_ROW * math.sqrt(len(rows))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0

    def weights(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, (np.sign(z_) * l1 - z_) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(PASSES):
        for places, y in examples:
            zf, nf = z[places], n[places]
            w, w0 = weights(zf, nf), -z0 / ((BETA + math.sqrt(n0)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + w0)))) - y
            z[places] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
            n[places] = nf + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / ALPHA * w0
            n0 += g * g
    w = weights(z, n)
    place = np.flatnonzero(w)
    return Weights(place, w[place], -z0 / ((BETA + math.sqrt(n0)) / ALPHA))


def scores(docs: DataFrame, model: Weights, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        dense = model_.dense()
        for batch in small_batches(batches):
            found = [model_.score(features(t.as_py()), dense) for t in batch.column("_text")]
            yield arrow([*keep, "score"], [*(batch.column(c) for c in keep), pa.array(found, pa.float64())])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{types}, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; learned only from labels that are not held out."""
    model = fit(sample(docs, labels, "toxic", ~held_out("doc_id", modulus, remainder), SAMPLE_ROWS, by_class=False))
    return scores(docs, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
