"""A quality classifier by compression: dictionaries of good and of bad text.

Two Zstandard dictionaries are built from labelled good and bad texts.  A text is compressed in pieces
of 512 bytes (its whole length, so that the dictionary and not the text's own past matters) with each;
the difference of the two sizes over the text's bytes says which kind of text it resembles.  A
logistic curve, fitted on labelled texts that are in neither dictionary, makes it a calibrated score.

The fit uses a bounded sample, ``SAMPLE_ROWS`` texts of each class of at most
``labelled.MAX_SAMPLE_ROW_BYTES`` bytes; every text is scored whole.  What is broadcast are two
dictionaries of ``DICTIONARY_BYTES`` and two numbers.

Defined results: null and empty texts have difference 0.  If one class has no labelled text, every score
is the share of good labels in the sample (0.5 without any).  Repeated rows are scored alike; other
columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow, small_batches, whole_text
from touchline.llm.labelled import held_out, sample

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Labelled texts of each class; half of them fill the dictionary, the others calibrate.
SAMPLE_ROWS = 1200
SMOOTHING = 1e-3


def pieces(raw: bytes) -> list[bytes]:
    return [raw[at:at + PIECE] for at in range(0, len(raw), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    parts = [p for t in texts for p in pieces(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(parts)[:DICTIONARY_BYTES]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)]

    def score(self, difference: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * difference + self.offset))))


def difference(text: str, compressors) -> float:
    """(size with the bad dictionary - size with the good one) / bytes of the text."""
    raw = text.encode()
    good, bad = (sum(len(c.compress(p)) for p in pieces(raw)) for c in compressors)
    return (bad - good) / len(raw) if raw else 0.0


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly ridged logistic regression, by Newton steps."""
    scale = max(float(np.std(x)), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    ridge = np.diag([SMOOTHING * len(x), 0.0])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ w
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows; label 1 is good."""
    good, bad = ([t for t, y in rows if y == k and t] for k in (1, 0))
    if not good or not bad:
        share = min(max(sum(y for _, y in rows) / len(rows), 1e-6), 1 - 1e-6) if rows else 0.5
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    model = Model(dictionary(good[:(len(good) + 1) // 2]), dictionary(bad[:(len(bad) + 1) // 2]))
    rest = [(t, 1) for t in good[(len(good) + 1) // 2:] or good] + [(t, 0) for t in bad[(len(bad) + 1) // 2:] or bad]
    compressors = model.compressors()
    model.slope, model.offset = calibrate(np.array([difference(t, compressors) for t, _ in rest]), np.array([y for _, y in rest], float))
    return model


def scores(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, size_difference and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        compressors = model_.compressors() if model_.slope else None
        for batch in small_batches(batches):
            found = [difference(t.as_py(), compressors) if compressors else 0.0 for t in batch.column("_text")]
            yield arrow([*keep, "size_difference", "score"], [*(batch.column(c) for c in keep), pa.array(found, pa.float64()), pa.array([model_.score(x) for x in found], pa.float64())])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{types}, size_difference double, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; learned only from labels that are not held out."""
    model = fit(sample(docs, labels, "quality", ~held_out("doc_id", modulus, remainder), SAMPLE_ROWS, by_class=True))
    return scores(docs, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "size_difference")
