"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is predicted from the tokens on both sides of it, itself masked; the conditional log-probabilities are
summed over a document.  The words are counted over the whole corpus; the most frequent have a token of their own, the
rest share tokens by hash, and a word of a shared token has that token's probability times the word's share of the
token's count, so every counted word has a probability of its own.  The network (embeddings of the window, one hidden layer, a softmax over groups of tokens and
one within each group) is trained in numpy by all tasks on all documents: in each round tasks start from the same
weights, train on their share of the positions of their texts, and the results are averaged by number of positions.  The
rounds take turns in the positions of a text, so together they train on every position once.

Defined cases: null and empty texts have no tokens, a sum of 0 and no mean.  A text of one token is predicted from the
edge marks alone.  Repeated rows count as often as they occur and are scored row by row.  Without any word the weights
stay as they were drawn.  Long texts are scored in slices and never cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, mapped, raw, to_arrow, written

GROUPS, WITHIN = 32, 32
TOKENS = GROUPS * WITHIN
SHARED = 128                 # tokens that rarer words share
EDGE = TOKENS                # stands before and after a text
SIDE, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE = 2, 2048, 0.3
FAN_IN = 64                  # sets of weights averaged by one task
SLICE = 1 << 14              # positions scored at once
LISTED = 1 << 16             # words whose counts tasks hold; those of the other words are joined
MET = 1 << 17                # words whose tokens a task keeps
KEPT = 1 << 19               # distinct words counted by a task before it hands them on

Weights = dict[str, np.ndarray]


def drawn(seed: int = 5) -> Weights:
    """Initial weights."""
    draw = np.random.default_rng(seed)
    some = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {"words": some(TOKENS + 1, WIDTH), "hidden": some(2 * SIDE * WIDTH, HIDDEN), "hidden_bias": zero(HIDDEN), "group": some(HIDDEN, GROUPS),
            "group_bias": zero(GROUPS), "within": some(GROUPS, HIDDEN, WITHIN), "within_bias": zero(GROUPS, WITHIN)}


def packed(weights: Weights) -> bytes:
    """Weights as bytes."""
    return b"".join(w.astype(np.float32).tobytes() for w in weights.values())


def unpacked(data: bytes) -> Weights:
    """Undo ``packed``."""
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for name, w in drawn().items():
        out[name] = flat[at:at + w.size].reshape(w.shape).copy()
        at += w.size
    return out


def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where the words of each text end, the words by number, and the distinct words; A-Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    if b"" in words:            # before, behind or without words
        empty = words.index(b"")
        real = codes != empty
        ends, codes = np.append(0, np.cumsum(real))[ends], codes[real]
        codes = codes - (codes > empty)
        del words[empty]
    return ends, codes, words


def word_counts(docs: DataFrame) -> DataFrame:
    """word and count over all documents."""
    form = to_arrow("word binary, many long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        for batch in batches:
            for data in raw(batch):
                counted.update(data.translate(LOWERED).split())
                if len(counted) > KEPT:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], schema=form)
                    counted.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], schema=form)

    return docs.select("text").mapInArrow(run, "word binary, many long").groupBy("word").agg(F.sum("many").alias("many"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> dict[bytes, int]:
    """The most frequent words of the corpus and their tokens, most frequent first."""
    rows = (word_counts(docs) if counts is None else counts).orderBy(F.desc("many"), "word").limit(TOKENS - SHARED).collect()      # a top list of fixed length
    return {bytes(r["word"]): i for i, r in enumerate(rows)}


class Known(dict):
    """Tokens of words; a word that is not listed gets one of the shared tokens."""

    def __missing__(self, word: bytes) -> int:
        at = TOKENS - SHARED + zlib.crc32(word) % SHARED
        if len(self) < MET and len(word) <= 40:
            self[word] = at
        return at


def tokens(data: bytes, known: Known) -> np.ndarray:
    """Tokens of a text."""
    words = data.translate(LOWERED).split()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def windows(own: np.ndarray) -> np.ndarray:
    """The tokens around every position, the position itself left out."""
    wide = np.concatenate([np.full(SIDE, EDGE), own, np.full(SIDE, EDGE)])
    return np.stack([wide[i:i + len(own)] for i in range(2 * SIDE + 1) if i != SIDE], 1)


def picked(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of the logarithm of the softmax of each row, the value at the place ``own``."""
    logits = logits - logits.max(1, keepdims=True)
    return logits[np.arange(len(own)), own] - np.log(np.exp(logits).sum(1))


def members(own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that occurs, and its positions."""
    groups = (own // WITHIN).astype(np.uint8)
    order = np.argsort(groups, kind="stable")
    edges = np.searchsorted(groups[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if edges[g] < edges[g + 1]:
            yield g, order[edges[g]:edges[g + 1]]


def log_probabilities(w: Weights, own: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of every token given those around it."""
    x = w["words"].take(around, axis=0).reshape(len(around), -1)
    h = np.tanh(x @ w["hidden"] + w["hidden_bias"])
    out = picked(h @ w["group"] + w["group_bias"], own // WITHIN).astype(np.float64)
    for g, at in members(own):
        out[at] += picked(h[at] @ w["within"][g] + w["within_bias"][g], own[at] % WITHIN)
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    """Softmax of each row."""
    out = np.exp(logits - logits.max(1, keepdims=True))
    out /= out.sum(1, keepdims=True)
    return out


def gradients(w: Weights, own: np.ndarray, around: np.ndarray) -> Weights:
    """Gradient of the mean negative log-probability; that of ``words`` is left by position."""
    order = np.argsort((own // WITHIN).astype(np.uint8), kind="stable")
    out = grouped_gradients(w, own[order], around[order])
    words = np.empty_like(out["words"])
    words.reshape(len(own), -1)[order] = out["words"].reshape(len(own), -1)
    return out | {"words": words}


def grouped_gradients(w: Weights, own: np.ndarray, around: np.ndarray) -> Weights:
    """``gradients`` of positions in order of their groups."""
    x = w["words"].take(around, axis=0).reshape(len(around), -1)
    h = np.tanh(x @ w["hidden"] + w["hidden_bias"])
    error, inner, every, size = softmax(h @ w["group"] + w["group_bias"]), np.empty((len(own), WITHIN), h.dtype), np.arange(len(own)), np.float32(len(own))
    edges = np.searchsorted(own // WITHIN, np.arange(GROUPS + 1))
    parts = [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]
    for g, part in parts:
        inner[part] = h[part] @ w["within"][g] + w["within_bias"][g]
    inner = softmax(inner)
    error[every, own // WITHIN] -= 1
    inner[every, own % WITHIN] -= 1
    error /= size
    inner /= size
    out = {"group": h.T @ error, "group_bias": error.sum(0), "within": np.zeros_like(w["within"]), "within_bias": np.zeros_like(w["within_bias"])}
    back = error @ w["group"].T
    for g, part in parts:
        out["within"][g], out["within_bias"][g] = h[part].T @ inner[part], inner[part].sum(0)
        back[part] += inner[part] @ w["within"][g].T
    back *= 1 - h * h
    return out | {"hidden": x.T @ back, "hidden_bias": back.sum(0), "words": (back @ w["hidden"].T).reshape(-1, WIDTH)}


def descend(w: Weights, own: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One step of gradient descent on a batch."""
    order = np.argsort((own // WITHIN).astype(np.uint8), kind="stable")
    own, around = own[order], around[order]
    for name, g in grouped_gradients(w, own, around).items():
        if name == "words":
            cells = (around.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
            w["words"] -= np.float32(rate * 10) * np.bincount(cells, g.ravel(), w["words"].size).reshape(w["words"].shape).astype(np.float32)
        else:
            w[name] -= np.float32(rate) * g


def train(docs: DataFrame, words: dict[bytes, int], rounds: int = ROUNDS) -> Weights:
    """Weights trained on every position of all documents by all tasks."""
    return train_coded(written(coded(docs, words)), rounds)


def train_coded(rows: DataFrame, rounds: int = ROUNDS) -> Weights:
    """``train`` on texts that ``coded`` has turned into tokens."""
    weights, kind = packed(drawn()), "task int, many long, weights binary"
    form = to_arrow(kind)
    for number in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(weights)      # of fixed size

        def run(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            w = unpacked(held.value)
            many, waiting, size = 0, [], 0
            rate = RATE / (1 + number)

            def learn() -> None:
                own, around = (np.concatenate(x) for x in zip(*waiting, strict=True))
                order = np.random.default_rng(many).permutation(len(own))
                for i in range(0, len(order), BATCH):
                    descend(w, own[order[i:i + BATCH]], around[order[i:i + BATCH]], rate)

            for batch in batches:
                for data in raw(batch, "tokens"):
                    own = numbers(data)
                    at = slice(number, None, rounds)
                    if len(own) > number:
                        waiting.append((own[at], windows(own)[at]))
                        size += len(own[at])
                    if size >= 16 * BATCH:
                        learn()
                        many, waiting, size = many + size, [], 0
            if size:
                learn()
                many += size
            if many:
                row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([many], pa.int64()), pa.array([packed(w)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, schema=form)

        weights = averaged(written(rows.select("tokens").mapInArrow(run, kind)), weights)
    return unpacked(weights)


def averaged(rows: DataFrame, default: bytes) -> bytes:
    """Mean of the tasks' weights by number of positions, ``FAN_IN`` at a time."""
    while (count := rows.count()) > FAN_IN:
        slotted = rows.withColumn("slot", F.pmod("task", F.lit(math.ceil(count / FAN_IN))))
        rows = written(slotted.groupBy("slot").applyInArrow(lambda key, part: _mean(key[0].as_py(), part), "task int, many long, weights binary"))
    own = pa.Table.from_pylist([r.asDict() for r in rows.collect()])       # FAN_IN rows at most
    return _mean(0, own)["weights"][0].as_py() if own.num_rows else default


def _mean(task: int, part: pa.Table) -> pa.Table:
    part = part.sort_by("task")
    many = part["many"].to_numpy()
    total = sum(n * np.frombuffer(x.as_py(), np.float32).astype(np.float64) for n, x in zip(many, part["weights"], strict=True))
    return pa.table({"task": pa.array([task], pa.int32()), "many": pa.array([int(many.sum())], pa.int64()),
                     "weights": pa.array([(total / many.sum()).astype(np.float32).tobytes()], pa.binary())})


def numbers(data: bytes) -> np.ndarray:
    """Tokens from the bytes that ``coded`` keeps."""
    return np.frombuffer(data, "<u2").astype(np.int64)


def score(docs: DataFrame, words: dict[bytes, int], weights: Weights) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean by token for every row."""
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return score_coded(coded(docs, words), weights).drop("row").withColumn("mean_log_likelihood", mean)


def score_coded(rows: DataFrame, weights: Weights) -> DataFrame:
    """row, doc_id, n_tokens, log_likelihood, and ``share`` where there is one, of texts that ``coded`` has turned into tokens."""
    shares = [c for c in rows.columns if c == "share"]
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def step(batch: pa.RecordBatch) -> dict:
        w, counts, sums = held.value, [], np.zeros(batch.num_rows)
        waiting, size = [], 0

        def settle() -> None:
            own, around, row = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for i in range(0, len(own), SLICE):
                part = slice(i, i + SLICE)
                sums[:] += np.bincount(row[part], log_probabilities(w, own[part], around[part]), batch.num_rows)

        for i, data in enumerate(raw(batch, "tokens")):
            own = numbers(data)
            counts.append(len(own))
            if len(own):
                waiting.append((own, windows(own), np.full(len(own), i)))
                size += len(own)
            if size >= SLICE:
                settle()
                waiting, size = [], 0
        if size:
            settle()
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": counts, "log_likelihood": sums} | {c: batch.column(c) for c in shares}

    return mapped(rows.select("row", "doc_id", "tokens", *shares), step, "row long, doc_id long, n_tokens long, log_likelihood double" + ", share double" * len(shares))


def listed(counts: DataFrame) -> tuple[dict[bytes, int], DataFrame]:
    """Counts of the most frequent words, ``LISTED`` at most, and the rows of all others."""
    seen, least = 0, None
    for r in counts.groupBy("many").agg(F.count("*").alias("words")).orderBy(F.desc("many")).limit(LISTED).collect():
        seen += r["words"]
        if seen > LISTED:
            break
        least = r["many"]
    if least is None:
        return {}, counts
    return {bytes(r["word"]): r["many"] for r in counts.where(F.col("many") >= least).collect()}, counts.where(F.col("many") < least)


def shared_totals(counts: DataFrame, words: dict[bytes, int]) -> np.ndarray:
    """Count of all words of each shared token."""
    out = np.zeros(SHARED)
    for r in counts.groupBy(F.pmod(F.crc32("word"), F.lit(SHARED)).alias("at")).agg(F.sum("many").alias("many")).collect():
        out[r["at"]] = r["many"]
    own = list(words)
    for r in counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in own], "word binary")), "word").collect() if own else []:
        out[zlib.crc32(r["word"]) % SHARED] -= r["many"]
    return out


def coded(docs: DataFrame, words: dict[bytes, int], known: dict[bytes, int] | None = None, totals: np.ndarray | None = None) -> DataFrame:
    """row, doc_id and tokens of every text, each text split once.

    With the counts of frequent words and of the shared tokens also ``share``, what these words add to the score, and the list of
    the rarer words, ``rare``.
    """
    held = docs.sparkSession.sparkContext.broadcast((words, None if totals is None else ({w: math.log(n) for w, n in known.items()}, np.log(np.maximum(totals, 1)))))
    kind = "row long, doc_id long, tokens binary" + ("" if totals is None else ", share double, rare array<struct<word: binary, n: long>>")
    form = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed_words, counted = Known(held.value[0]), held.value[1]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ends, codes, said = split(batch)
            token = np.fromiter(map(listed_words.__getitem__, said), np.int64, len(said))
            own, starts = token[codes], np.append(0, ends[:-1])
            kept = [x.tobytes() for x in np.split(own.astype("<u2"), ends[:-1])]
            columns = [pa.array(range(number, number + batch.num_rows), pa.int64()), batch.column("doc_id"), pa.array(kept, pa.binary())]
            if counted is not None:
                logs, shared = counted
                known_log = np.fromiter((logs.get(w, math.nan) for w in said), np.float64, len(said))
                place = token - (TOKENS - SHARED)
                value = np.where(place >= 0, np.nan_to_num(known_log) - shared[np.maximum(place, 0)], 0.0)
                text = np.repeat(np.arange(batch.num_rows), ends - starts)
                sums = np.bincount(text, value[codes], batch.num_rows)
                rare = ((place >= 0) & np.isnan(known_log))[codes]
                pairs, many = np.unique(text[rare] * len(said) + codes[rare], return_counts=True)
                stops = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(said))
                names = pa.array(said, pa.binary()).take(pa.array(pairs % max(len(said), 1)))
                found = pa.StructArray.from_arrays([names, pa.array(many, pa.int64())], names=["word", "n"])
                columns += [pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), found).cast(form.field("rare").type)]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, schema=form)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def score_words(docs: DataFrame, words: dict[bytes, int], weights: Weights, counts: DataFrame) -> DataFrame:
    """``score`` by words: a word of a shared token gets its counted share of the token's probability.

    A word that was not counted is taken as seen once.
    """
    rows, rest = shared(docs, words, counts)
    return scored(rows, weights, rest)


def shared(docs: DataFrame, words: dict[bytes, int], counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts as ``coded`` gives them with the shares of frequent words, written, and the counts of all other words."""
    known, rest = listed(counts)
    return written(coded(docs, words, known, shared_totals(counts, words))), rest


def scored(rows: DataFrame, weights: Weights, rest: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean by words: the rarer ones, listed with each text, are joined with their counts."""
    missed = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    added = (missed.join(rest, "word", "left").groupBy("row")
             .agg(F.sum(F.col("n") * F.log(F.coalesce("many", F.lit(1)).cast("double"))).alias("added")))
    plain = score_coded(rows, weights)
    total = F.col("log_likelihood") + F.col("share") + F.coalesce("added", F.lit(0.0))
    return (plain.join(added, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
            .withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))))
