"""Exact de-duplication by composable polynomial fingerprints.

A text is a polynomial over its bytes, taken modulo two primes.  Chunks are hashed apart and combine by
length-shifted arithmetic, ``H(xy) = H(x) * B^|y| + H(y)``, so that the pieces of a huge document are spread
over tasks and meet in a plain sum.  Texts with equal fingerprints are then compared chunk by chunk.

Defined cases: null is the empty text, and all empty texts are one group.  The largest ``doc_id`` of a group
stays; null ids count as smallest.  If one document is listed several times, one row of it stays.  Letters
other than A-Z keep their case.  Columns beside the id and the text are neither read nor lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWERED, ascii_lower, mapped, raw, unused, written

PRIMES = (2147483647, 2147483629)      # below 2^31, so a product with a byte leaves room for long sums
BASES = (911382323, 972663749)
PIECE = 1 << 16                        # bytes of one chunk
HUGE = 8 << 20                         # texts beyond this many bytes are hashed by several tasks
KEY = ["fp_length", "fp_a", "fp_b"]
SALTS = 8                              # tasks over which the texts of one hot group are spread

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, length: int = PIECE) -> np.ndarray:
    """``base ** (length - 1 - i) mod prime`` for every position of a chunk."""
    if (base, prime) not in _powers:
        row = np.ones(1, np.uint64)
        while len(row) < length:
            row = np.concatenate([row, row * np.uint64(pow(base, len(row), prime)) % np.uint64(prime)])
        _powers[base, prime] = row[:length][::-1].copy()
    return _powers[base, prime]


def fingerprint(data: bytes, primes: tuple[int, ...] = PRIMES) -> tuple[int, ...]:
    """Fingerprints of ``data``, one for each prime, combined from those of its chunks."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = []
    for base, prime in zip(BASES, primes, strict=True):
        row, total = powers(base, prime), 0
        for at in range(0, len(values), PIECE):
            chunk = values[at:at + PIECE]
            own = int(np.dot(chunk, row[PIECE - len(chunk):]) % np.uint64(prime))
            total = (total * pow(base, len(chunk), prime) + own) % prime
        out.append(total)
    return tuple(out)


def _marks(batch: pa.RecordBatch, primes: tuple[int, ...]) -> tuple[list, list, list, list]:
    data = [x.translate(LOWERED) for x in raw(batch)]
    marks = [fingerprint(x, primes) for x in data]
    return data, [len(x) for x in data], [m[0] for m in marks], [m[1] for m in marks]


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> DataFrame:
    """doc_id, fingerprint and SHA-256 of the normalised text of every row."""
    docs = docs.select("doc_id", "text")

    def whole(batch: pa.RecordBatch) -> dict:
        data, size, a, b = _marks(batch, primes)
        return {"doc_id": batch.column("doc_id"), "fp_length": size, "fp_a": a, "fp_b": b,
                "sha": [hashlib.sha256(x).digest() for x in data]}

    def piece(batch: pa.RecordBatch) -> dict:
        _, size, a, b = _marks(batch, primes)
        rest = [r.as_py() for r in batch.column("rest")]
        shift = lambda marks, i: [m * pow(BASES[i], r, primes[i]) % primes[i] for m, r in zip(marks, rest, strict=True)]
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "sha": batch.column("sha"),
                "fp_length": size, "fp_a": shift(a, 0), "fp_b": shift(b, 1)}

    kind = "doc_id long, fp_length long, fp_a long, fp_b long, sha binary"
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = mapped(docs.where(size <= huge), whole, kind)
    data = F.col("text").cast("binary")
    large = (docs.where(size > huge)
             .select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("sha"),
                     data.alias("data"), F.octet_length("text").alias("size"))
             .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(huge))))
             .select("row", "doc_id", "sha", F.expr(f"substring(data, at + 1, {huge})").alias("text"),
                     F.greatest(F.col("size") - F.col("at") - huge, F.lit(0)).alias("rest"))
             .repartition(F.col("row"), F.col("rest")))
    parts = mapped(large, piece, "row long, doc_id long, sha binary, fp_length long, fp_a long, fp_b long")
    joined = (parts.groupBy("row", "doc_id", "sha")
              .agg(F.sum("fp_length").alias("fp_length"), (F.sum("fp_a") % primes[0]).alias("fp_a"), (F.sum("fp_b") % primes[1]).alias("fp_b")))
    return small.unionByName(joined.select("doc_id", "fp_length", "fp_a", "fp_b", "sha"))


def unequal(docs: DataFrame, repeated: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Fingerprints among ``repeated`` whose texts are not all equal.

    The texts of a group are compared chunk by chunk: a chunk is the same in all of them if the smallest
    and the largest are equal, and both are combined inside each task before anything is shuffled.
    """
    turn = [0]          # goes on over the batches of a task, which may be of one row

    def chunks(batch: pa.RecordBatch) -> dict:
        data, size, a, b = _marks(batch, primes)
        turn[0] += batch.num_rows
        return {"salt": [(turn[0] + i) % SALTS for i in range(batch.num_rows)], "fp_length": size, "fp_a": a, "fp_b": b,
                "chunks": [[x[i:i + PIECE] for i in range(0, len(x), PIECE)] for x in data]}

    rows = mapped(docs.select("text"), chunks, "salt int, fp_length long, fp_a long, fp_b long, chunks array<binary>")
    salted = repeated.select(*KEY).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return (rows.join(salted, [*KEY, "salt"], "left_semi")
            .select(*KEY, F.posexplode("chunks").alias("at", "chunk"))
            .groupBy(*KEY, "at").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
            .where(F.col("low") != F.col("high")).select(*KEY).distinct())


def decisions(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> DataFrame:
    """One row per document: its key, keep_id, group_size, kept, text_sha256, and how often its id and text occur.

    ``part`` tells texts of one fingerprint apart that the comparison found to differ; it is 0 elsewhere.
    """
    marks = written(fingerprints(docs, primes, huge))
    repeated = marks.groupBy(*KEY).count().where("count > 1")
    bad = written(unequal(docs, repeated, primes))
    if bad.isEmpty():
        marks = marks.withColumn("part", F.lit(b""))
    else:       # the digest of the text is what tells such texts apart
        marks = (marks.join(bad.withColumn("bad", F.lit(True)), KEY, "left")
                 .withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise(F.lit(b""))).drop("bad"))
    rows = marks.groupBy(*KEY, "part", "doc_id").agg(F.count("*").alias("copies"), F.first("sha").alias("sha"))
    groups = rows.groupBy(*KEY, "part").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (rows.join(groups, [*KEY, "part"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", *KEY, "part", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "copies"))


def kept_documents(docs: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    id_, sha, own_sha, row = (unused(docs.columns, n) for n in ("_id", "_sha", "_own", "_row"))
    stay = written(decisions(docs, primes).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), F.col("copies").alias("many")))
    own = docs.withColumn(own_sha, F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    kept = own.join(stay.select(id_, sha), own["doc_id"].eqNullSafe(F.col(id_)) & (own[own_sha] == F.col(sha)), "left_semi")
    if not stay.where("many > 1").isEmpty():          # rows of one document that is listed several times
        one = Window.partitionBy("doc_id", own_sha).orderBy(F.lit(1))
        kept = kept.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).drop(row)
    return kept.drop(own_sha)
