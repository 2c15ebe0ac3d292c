"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is a sparse vector: its words and word pairs, the shapes of words (case, digits, marks) and their pairs, and the
shape of a word said twice running, hashed into ``DIMENSIONS`` slots.  A slot weighs one plus the log of its count, and
the vector has length one.  FTRL-proximal passes over the training rows one at a time; a score is the logistic of a
sparse dot product.

The rows it learns from are bounded: of the labelled ones those ``SAMPLE`` whose ids hash lowest, the two classes
apart.  Scoring has no bound and reads every text whole.

Defined cases: a null or empty text has the bias alone and is scored like any other.  Null labels, and labels other
than 0 and 1, are not learnt from; several labels of one document count each.  Without a label of both classes every
score is one half.  Repeated rows are scored row by row; columns beside id and text are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, raw, to_arrow

DIMENSIONS = 1 << 18
SAMPLE = 6_000           # training rows of each class at most
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 1e-6, 1e-5
BIAS = DIMENSIONS        # the slot after the hashed ones
KNOWN = 1 << 17          # words whose slots a worker keeps

_slots: dict[bytes, tuple[int, int]] = {}


def shape(word: bytes) -> bytes:
    """A word with letters as a or A, digits as 0 and runs as one; other signs stay."""
    out = bytearray()
    for b in word:
        kind = 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out)


def forget() -> None:
    """Drop the slots kept by this worker."""
    _slots.clear()


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and their values, without the bias."""
    words = data.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    kept, own = _slots, []
    for word in words:
        if (slots := kept.get(word)) is None:
            if len(kept) >= KNOWN:
                kept.clear()
            slots = kept[word] = (xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(word), 1))
        own.append(slots)
    values = np.array(own, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    pairs = values[:-1] * step + values[1:]
    twice = values[:-1, 1][values[:-1, 0] == values[1:, 0]] * step + np.uint64(1)
    slots, counts = np.unique(np.concatenate([values.ravel(), pairs.ravel(), twice]) >> np.uint64(46), return_counts=True)
    x = 1 + np.log(counts)
    return slots.astype(np.int64), x / np.sqrt(x @ x)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights by FTRL-proximal over (slots, values, label) rows, in an order drawn from ``seed``."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    if len({label for *_, label in rows}) < 2:
        return z

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            slots, values, label = rows[i]
            at, x = np.append(slots, BIAS), np.append(values, 0.3)
            w = weights(at)
            g = (logistic(float(w @ x)) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def logistic(x: float) -> float:
    """Logistic function without overflow."""
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


def dot(slots: np.ndarray, values: np.ndarray, weights: np.ndarray) -> float:
    """Sparse dot product of a text with the weights."""
    return float(weights[slots] @ values) + 0.3 * float(weights[BIAS])


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows of each class.

    The rows are drawn by the hash of their ids, and one task learns from them; only weights reach the driver.  Equal rows count
    once, and of the texts that go by the drawn ids at most ``2 * sample`` are learnt from, those of the lowest hashes.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    drawn = None
    for label in (0, 1):
        own = marked.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "quality", "text"])
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))

    def slots(batch: pa.RecordBatch) -> dict:
        found = [features(x) for x in raw(batch)]
        return {"h": batch.column("h"), "doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "slots": [s for s, _ in found], "values": [v for _, v in found]}

    form = to_arrow("weights binary")

    def learn(batches):
        got = sorted((r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("quality").to_pylist(),
                                                     (np.asarray(x.values) for x in b.column("slots")), (np.asarray(x.values) for x in b.column("values")), strict=True)), key=lambda r: (r[0], r[1], len(r[2])))
        weights = train([(s, v, q) for _, q, s, v in got], epochs).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], schema=form)

    taken = mapped(rows, slots, "h long, doc_id long, quality int, slots array<int>, values array<double>", forget)
    found = taken.orderBy("h", "doc_id", "quality").limit(2 * sample).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros(DIMENSIONS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)      # of fixed size: one float for each slot

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        own = held.value
        return pd.Series([logistic(dot(*features((t or "").encode()), own)) for t in text], dtype="float64")

    return docs.withColumn("score", scored("text"))


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with a score of one half or more, with their own columns."""
    held = docs.sparkSession.sparkContext.broadcast(weights)      # of fixed size

    def run(batches):
        try:
            for batch in batches:
                own = held.value
                yield batch.filter(pa.array([logistic(dot(*features(x), own)) >= 0.5 for x in raw(batch)], pa.bool_()))
        finally:
            forget()

    return docs.mapInArrow(run, docs.schema)
