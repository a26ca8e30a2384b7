"""Compression classifier: zstandard dictionaries of good and of bad text decide what reads as good.

A text is compressed window by window with the dictionary of good and with that of bad text. The
difference of the compressed sizes, normalised by the text's length and drawn towards the neutral
difference where a text is short, is the only input of a logistic curve. The neutral difference is
the one at which the curve gives the share of label 1 among all training rows, so a text that says
nothing scores that share.

Labels are learned from rows outside the held-out fold, from a bounded sample: the ``per_class``
rows of each label with the lowest hash of their id among texts of at most ``sample_bytes``. Half
of it makes the dictionaries, half the curve, which then takes the share of labels among all
training rows as prior. Nothing but the text enters a score.

Defined results: a null or empty text gets the share of label 1 as its score; texts of any length
count whole; a document with contradicting labels is not learned
from; null labels and ids are not learned from (a null id is not held out); repeated rows are
scored as often as they stand; without labels of both kinds every score is (n1 + 1) / (n0 + n1 + 1);
an empty table gives no row; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a window, of a dictionary, and the weight of the neutral difference in bytes of text.
WINDOW, DICTIONARY, SHRINK, LEVEL = 512, 256 << 10, 200, 3
#: Bounds of the labelled sample that reaches the driver: 2 * PER_CLASS texts of SAMPLE_BYTES at most.
PER_CLASS, SAMPLE_BYTES = 4000, 16384
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    neutral: float
    slope: float
    offset: float


def windows(raw: bytes) -> list[bytes]:
    return [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [w for t in texts for w in windows(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY]


class Scorer:
    """Sizes and scores of one model; made once in each task."""

    def __init__(self, model: Model):
        self.model = model
        self.sizes = [self._compressor(d) for d in (model.good, model.bad)]

    @staticmethod
    def _compressor(raw: bytes):
        shared = zstandard.ZstdCompressionDict(raw)
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False).compress

    def difference(self, text: str | None) -> tuple[int, int]:
        """Compressed bytes with the bad less those with the good dictionary; bytes of the text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (sum(len(size(w)) for w in windows(raw)) for size in self.sizes)
        return bad - good, len(raw)

    def score(self, text: str | None) -> float:
        d, n = self.difference(text)
        x = (d + SHRINK * self.model.neutral) / (n + SHRINK)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.slope * x + self.model.offset))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps on the standardised input."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * w * (1, 0)
        hess = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.diag((1.0, 1e-6))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Model | None, int, int]:
    """The model, or None where one kind of label is missing; rows of label 0 and 1 that it may learn from."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in each.groupBy("quality").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return None, n0, n1
    # Twice as many ids as wanted, as some texts are longer than a sample's may be.
    chosen = [each.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class) for q in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 4 * per_class rows: bounded, so it may be broadcast
    scratch = Scratch(docs.sparkSession, "quality")
    texts = scratch.keep(docs.select("doc_id", "text").where(F.octet_length("text").between(1, sample_bytes)).join(F.broadcast(ids), "doc_id"))
    picked: dict[int, list[bytes]] = {0: [], 1: []}
    for q in (0, 1):
        own = texts.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class).select("text")
        picked[q] = [t.encode("utf-8", "surrogatepass") for t in own.toArrow()["text"].to_pylist()]
    scratch.clear()
    if not picked[0] or not picked[1]:
        return None, n0, n1
    # Alternate rows make the dictionaries; a lone row serves for both.
    made = {q: own[::2] for q, own in picked.items()}
    drawn = {q: own[1::2] or own for q, own in picked.items()}
    rough = Model(dictionary(made[1]), dictionary(made[0]), 0.0, 0.0, 0.0)
    scorer = Scorer(rough)
    found = {q: np.array([scorer.difference(t.decode("utf-8", "surrogatepass")) for t in own], dtype=float) for q, own in drawn.items()}
    share = {0: n0 / (n0 + n1), 1: n1 / (n0 + n1)}
    weight = np.concatenate([np.full(len(found[q]), share[q] / len(found[q])) for q in (0, 1)]) * (len(found[0]) + len(found[1]))
    truth = np.repeat([0.0, 1.0], [len(found[0]), len(found[1])])
    d, n = np.concatenate([found[0], found[1]]).T
    # The neutral difference follows from the curve, and the curve from it; few rounds settle both.
    neutral = float(np.median(d / n))
    for _ in range(20):
        slope, offset = logistic((d + SHRINK * neutral) / (n + SHRINK), truth, weight)
        before, neutral = neutral, (math.log(share[1] / share[0]) - offset) / slope if slope > 0 else neutral
        if abs(neutral - before) < 1e-6:
            break
    else:
        slope, offset = logistic((d + SHRINK * neutral) / (n + SHRINK), truth, weight)
    offset = math.log(share[1] / share[0]) - slope * neutral  # exact for a text that says nothing
    return Model(rough.good, rough.bad, neutral, slope, offset), n0, n1


def score(docs: DataFrame, fitted: tuple[Model | None, int, int], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of docs (the id by default) and ``score``."""
    model, n0, n1 = fitted
    kept = ["doc_id"] if keep is None else keep
    if model is None:
        return docs.select(*kept, F.lit((n1 + 1) / (n0 + n1 + 1)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    # Columns travel under names of our own, so that none can clash; the text travels once.
    names = [f"c{k}" for k in range(len(kept))]
    sent = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), *([] if "text" in kept else [F.col("text").alias("t")]))
    at = kept.index("text") if "text" in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], [*names, "score"])

    schema = ", ".join([*(f"{n} {sent.schema[n].dataType.simpleString()}" for n in names), "score double"])
    return sent.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)), "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
