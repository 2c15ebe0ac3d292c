"""Hard-negative mining on an inverted multi-index.

Vectors are integers (``floor(256 * x)``) and scores their inner products, so results are exact.  Each half of the
space has a codebook; the two codes of a row are its cell.  Rows are dealt to blocks by hash, and a block is an index of
its own: rows by cell, all together and once more by label, and for each half and code the largest distance of a row from the centre (the radius).  The
score of an anchor half ``q`` with any row of a code is at most ``q . centre + |q| * radius``, and that of a cell the sum of two.
A heap over both sorted lists of half bounds (multi-sequence) visits the cells from the greatest sum on.

* **Positives** of an anchor are the best rows of its own label; a block is done when no bound is left that reaches the
  last of the best so far.
* **Negatives** of a positive lie in a window of scores.  A window is certified when it has all its rows and no bound left
  reaches the last of them, or none reaches its lower end.  The search stops when all windows of an anchor are certified.

Anchors, a fixed share of the rows, meet every block: they are the query set, sent to each block, and pass through one by one
beside the one block a task holds.  What a block finds for an anchor is a few rows; the best of all blocks are ranked by a
window that limits before the shuffle.  Centres come from at most ``SAMPLE`` rows and only set the order of visits; every row is
indexed, and nothing is approximate.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part.  Shorter vectors
count as filled up with zeros.  Scaled components saturate at 64 bits; where sums could leave the range in which floating point is
exact, unbounded integers are used, and scores are cut to 64 bits.  Rows with one id are rows of their own, each an anchor.
Ties go by id.  Columns other than the three named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import to_arrow, written

SCALE = 256                  # components become floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95           # window of a negative's score, in percent of the positive's
CODES, TRAINED = 16, 6       # centres of a half, rounds of training
SAMPLE = 4096                # rows that centres are trained on at most
ROWS = 1 << 16               # rows of a block
SMALL = 2048                 # rows of a block at least, while there are fewer blocks than tasks
FIRST = 2048                 # rows scored before the first look at the bounds; four times as many from there
EXACT = {np.float32: float(1 << 24), np.float64: float(1 << 53)}       # sums below are exact
MOST = (1 << 63) - 1


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, id, label and vector of the rows that take part, from ``vec_id``, ``label`` and ``embedding``."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    own = rows.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return own.where(~F.exists("embedding", odd)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), "label", scaled.alias("vector"))


def stacked(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch as rows, filled up with zeros."""
    ends = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values)[ends[0]:ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def codebooks(rows: DataFrame, dims: int, codes: int = CODES) -> list[np.ndarray]:
    """Centres of both halves, by rounds of means over a bounded sample of the rows."""
    picked = rows.select("row", "vector", F.xxhash64("row").alias("h")).orderBy("h", "row").limit(SAMPLE)
    data = np.zeros((0, dims))
    batches = picked.select("vector").toArrow().combine_chunks().to_batches()       # of bounded length
    if batches:
        data = np.concatenate([stacked(b.column(0), dims) for b in batches])
    out = []
    for part in (data[:, :dims // 2], data[:, dims // 2:]):
        distinct = np.unique(part, axis=0)
        centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, part.shape[1]))
        for _ in range(TRAINED):
            code = nearest(part, centres)
            for i in range(len(centres)):
                if (code == i).any():
                    centres[i] = part[code == i].mean(axis=0)
        out.append(centres)
    return out


def nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((centres ** 2).sum(axis=1) - 2 * part @ centres.T, axis=1)


class Index:
    """Rows by cell, with the radii of the half codes."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, data: np.ndarray, books: list[np.ndarray]):
        half = len(books[0][0])
        code = [nearest(data[:, :half], books[0]), nearest(data[:, half:], books[1])]
        order = np.lexsort((ids, code[1], code[0]))
        self.peak = float(np.abs(data).max(initial=0))
        self.row, self.ids, self.label = row[order], ids[order], label[order]
        self.books, self.half, self.radius = books, half, []
        for book, own, part in zip(books, code, (data[:, :half], data[:, half:]), strict=True):
            far = np.sqrt(((part - book[own]) ** 2).sum(axis=1))
            reach = np.full(len(book), -1.0)
            np.maximum.at(reach, own, far)
            self.radius.append(reach)           # -1: no row has this code
        self.cell = code[0][order] * len(books[1]) + code[1][order]
        self.starts = np.searchsorted(self.cell, np.arange(len(books[0]) * len(books[1]) + 1)).tolist()
        self.bounds = np.stack([self.starts[:-1], self.starts[1:]], axis=1)
        self.data = data[order].astype(np.float32 if self.peak ** 2 * data.shape[1] < EXACT[np.float32] else np.float64)

    def scores(self, places: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        """Inner products with the rows at some places, in the shortest floating point in which they are exact."""
        part, reach = self.data[places], self.peak * np.abs(query).max(initial=0) * len(query)
        if reach < EXACT[part.dtype.type]:
            return (part @ query.astype(part.dtype)).astype(np.int64)
        return (part.astype(np.float64) @ query).astype(np.int64) if reach < EXACT[np.float64] else _unbounded(part, query)

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """Cells with rows from the greatest bound on, as (bound, cell); the heap holds one front of both sorted lists."""
        sides = []
        for book, reach, q in zip(self.books, self.radius, (query[:self.half], query[self.half:]), strict=True):
            bound = np.where(reach < 0, -np.inf, book @ q + np.sqrt(q @ q) * np.maximum(reach, 0))
            order = np.argsort(-bound, kind="stable")[:int((reach >= 0).sum())]
            sides.append(((-bound[order]).tolist(), order.tolist()))
        (first, a), (second, b) = sides
        if not a or not b:
            return
        starts, wide, push, pop = self.starts, len(self.books[1]), heapq.heappush, heapq.heappop
        heap = [(first[0] + second[0], 0, 0)]
        while heap:
            bound, i, j = pop(heap)
            if i == 0 and j + 1 < len(b):
                push(heap, (first[0] + second[j + 1], 0, j + 1))
            if i + 1 < len(a):
                push(heap, (first[i + 1] + second[j], i + 1, j))
            cell = a[i] * wide + b[j]
            if starts[cell] < starts[cell + 1]:
                yield 1.0 + 1e-9 * abs(bound) - bound, cell        # what floating point may have lost is far below that

    def visited(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Rows of more and more cells and their scores, with the bound of what is left."""
        cells, held, most = [], 0, FIRST
        for bound, cell in self.cells(query):
            if held >= most:
                yield bound, *self._scored(cells, query)
                cells, held, most = [], 0, 4 * most
            cells.append(cell)
            held += self.starts[cell + 1] - self.starts[cell]
        if cells:
            yield -np.inf, *self._scored(cells, query)

    def _scored(self, cells: list[int], query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.bounds[np.sort(np.array(cells))]
        size = begin[:, 1] - begin[:, 0]
        places = np.arange(size.sum()) + np.repeat(begin[:, 0] - np.cumsum(size) + size, size)
        if len(places) == places[-1] - places[0] + 1:               # cells that lie together
            return places, self.scores(slice(int(places[0]), int(places[-1]) + 1), query)
        return places, self.scores(places, query)


def _unbounded(part: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores beyond floating point, by Python's integers, cut to 64 bits."""
    values = [sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in part]
    return np.array([max(-MOST, min(MOST, v)) for v in values], np.int64)


class Block:
    """The rows a task holds: one index of all of them and one of each label."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, data: np.ndarray, books: list[np.ndarray]):
        self.all = Index(row, ids, label, data, books)
        self.of = {int(x): Index(*(v[label == x] for v in (row, ids, label, data)), books) for x in np.unique(label)}


def _best(index: Index, at: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first rows by score, then id."""
    if len(at) > 4 * most:                      # only those that reach the last score needed
        keep = score >= np.partition(score, len(score) - most)[len(score) - most]
        at, score = at[keep], score[keep]
    order = np.lexsort((index.row[at], index.ids[at], -score))[:most]
    return at[order], score[order]


def nearest_others(index: Index, row: int, query: np.ndarray, most: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """The best rows but one, and their scores."""
    at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bound, places, values in index.visited(query):
        other = index.row[places] != row
        at, score = _best(index, np.concatenate([at, places[other]]), np.concatenate([score, values[other]]), most)
        if len(at) == most and bound < score[-1]:
            break
    return at, score


def in_windows(index: Index, label: int, query: np.ndarray, windows: list[tuple[int, int]], most: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, the best rows of other labels in it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    pending = [i for i, (low, high) in enumerate(windows) if low <= high]
    if not pending:
        return found
    for bound, places, values in index.visited(query):
        keep = np.flatnonzero((values >= min(windows[i][0] for i in pending)) & (values <= max(windows[i][1] for i in pending)))
        keep = keep[index.label[places[keep]] != label]
        places, values = places[keep], values[keep]
        for i in list(pending):
            low, high = windows[i]
            inside = (values >= low) & (values <= high)
            at, score = _best(index, np.concatenate([found[i][0], places[inside]]), np.concatenate([found[i][1], values[inside]]), most)
            found[i] = at, score
            if bound < low or len(at) == most and bound < score[-1]:
                pending.remove(i)
        if not pending:
            break
    return found


def searched(rows: DataFrame, anchors: DataFrame, blocks: int, books: list[np.ndarray], dims: int, look, kind: str) -> DataFrame:
    """``look(block, anchor record, its vector)`` for every block and anchor; it yields records of ``kind``.

    The rows of a block come first, then the anchors in batches; a task holds one block at a time.
    """
    form, names = to_arrow(kind), [f.name for f in to_arrow(kind)]
    held = rows.sparkSession.sparkContext.broadcast(books)         # of fixed size
    extra = [c for c in anchors.columns if c not in rows.columns]
    dealt = rows.select(*rows.columns, *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra),
                        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block"), F.lit(0).alias("turn"))
    sent = anchors.select(*rows.columns, *extra, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("turn"))

    def run(batches):
        block, parts, index = None, [], None
        for batch in batches:
            at, turn = np.asarray(batch.column("block")), np.asarray(batch.column("turn"))
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(turn) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(low, high - low)
                if at[low] != block:
                    block, parts, index = at[low], [], None
                vectors = stacked(part.column("vector"), dims)
                if turn[low] == 0:
                    parts.append((*(np.asarray(part.column(c)) for c in ("row", "id", "label")), vectors))
                    continue
                if index is None and parts:
                    index, parts = Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), held.value), []
                if index is not None:
                    out = [r for anchor, query in zip(part.select(["row", "id", "label", *extra]).to_pylist(), vectors, strict=True) for r in look(index, anchor, query)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in zip(names, form, strict=True)], schema=form)

    return dealt.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "turn", "row").mapInArrow(run, kind)


def mine(rows: DataFrame, anchor: str = "id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         codes: int = CODES, block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from ``prepared`` rows and a condition that names the anchors."""
    rows = written(rows)
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-count // block), min(tasks, count // SMALL))
    books = codebooks(rows, dims, codes)
    anchors = rows.where(anchor)

    def near(block, record, query):
        if (index := block.of.get(record["label"])) is None:
            return
        at, score = nearest_others(index, record["row"], query, positives)
        for i, s in zip(at.tolist(), score.tolist(), strict=True):
            yield {"anchor": record["row"], "positive_id": int(index.ids[i]), "score": s, "row": int(index.row[i])}

    kind = "anchor long, positive_id long, score long, row long"
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "row")
    first = written(searched(rows, anchors, blocks, books, dims, near, kind).withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= positives))
    wanted = first.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("turn", "positive_id", "score")).alias("positives"))
    asked = written(anchors.join(wanted, "row"))

    def window(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def hard(block, record, query):
        index = block.all
        found = in_windows(index, record["label"], query, [window(p["score"]) for p in record["positives"]], negatives)
        for p, (at, score) in zip(record["positives"], found, strict=True):
            for i, s in zip(at.tolist(), score.tolist(), strict=True):
                yield {"anchor": record["row"], "anchor_id": record["id"], "turn": p["turn"], "positive_id": p["positive_id"], "positive_score": p["score"],
                       "negative_id": int(index.ids[i]), "negative_score": s, "row": int(index.row[i])}

    kind = "anchor long, anchor_id long, turn int, positive_id long, positive_score long, negative_id long, negative_score long, row long"
    best = Window.partitionBy("anchor", "turn").orderBy(F.desc("negative_score"), "negative_id", "row")
    return (searched(rows, asked, blocks, books, dims, hard, kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
