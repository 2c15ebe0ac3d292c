"""Benchmark decontamination by an FM-index for each shard of the training text.

A benchmark item gives windows of ten consecutive words, or one shorter window if it has fewer.  Words that
no item has, and stretches of known words too short for any window, cannot be part of a match: each becomes
one separator, and the rest of a shard is indexed.  All windows are searched backwards at once, their
occurrences located, and the covered words merged into spans.

Items are held by tasks in blocks of bounded size; each block is searched against all documents.

Defined cases: null and empty texts have no words and are never hit.  Items without words have no window.
Equal items are all reported; an item without an id marks words but is not listed.  Repeated documents are
searched row by row, and other columns pass through unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, raw, to_arrow
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20       # benchmark text held by a task at once
SHARD_BYTES = 32 << 20       # document text of one index
SPANS = "array<struct<start:int,end:int>>"
_KEPT = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 32 for b in LOWERED)
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text."""
    return data.translate(_KEPT).split()


class Phrases:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.names: list[str | None] = []
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if own:
                self.names.append(name)
                for i in range(max(1, len(own) - window + 1)):
                    found.setdefault(tuple(own[i:i + window]), set()).add(len(self.names) - 1)
        self.windows: dict[int, np.ndarray] = {}
        self.items: dict[int, list[list[int]]] = {}
        for size in {len(w) for w in found}:
            mine = [w for w in found if len(w) == size]
            self.windows[size] = np.array(mine, np.int64)
            self.items[size] = [sorted(found[w]) for w in mine]
        self.shortest = min(self.windows, default=0)

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Number of words, merged spans of hit words, and names of the items found, for each text."""
        counts, hits, names = [], [[] for _ in texts], [[] for _ in texts]
        stretches, origin, owner = [], [], []
        for i, text in enumerate(texts):
            own = words(text)
            counts.append(len(own))
            if not self.windows or len(own) < self.shortest:
                continue
            ids = np.fromiter(map(self.number.get, own, repeat(0)), np.int32, len(own))
            edge = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.shortest:
                    stretches += [ids[a:b], np.zeros(1, np.int32)]
                    origin.append(np.arange(a, b + 1))
                    owner.append(np.full(b - a + 1, i))
        if not stretches:
            return counts, hits, names
        text, place, owner = np.concatenate(stretches).astype(np.int64), np.concatenate(origin), np.concatenate(owner)
        index = FMIndex(text, len(self.number) + 1)
        edges = np.zeros(len(text) + 1, np.int64)
        pairs = []
        for size, windows in self.windows.items():
            which, low, high = index.search(windows)
            many = high - low
            rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            at, what = index.locate(rows), np.repeat(which, many)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            for key in np.unique(owner[at] * len(windows) + what):
                pairs += [(int(key // len(windows)), x) for x in self.items[size][int(key % len(windows))]]
        hit = np.cumsum(edges[:-1]) > 0
        turn = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        for a, b in zip(turn[::2], turn[1::2], strict=True):
            hits[owner[a]].append((int(place[a]), int(place[b - 1]) + 1))
        for i, item in set(pairs):
            if self.names[item] is not None:
                names[i].append(self.names[item])
        return counts, hits, [sorted(set(x)) for x in names]


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Items in blocks of about ``most`` bytes, dealt out by a hash of the text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / most))
    for i in range(count):
        mine = items if count == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == i)
        yield Phrases([(r["name"], bytes(r["text"])) for r in mine.toLocalIterator()], window)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES, shard: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words and names of the items found, for every row of ``docs``."""
    kind = f"doc_id long, n_words long, spans {SPANS}, items array<string>"
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit([]).cast(SPANS).alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    steps = list(blocks(benchmark, window, most))
    for number, phrases in enumerate(steps):
        last = number == len(steps) - 1
        schema = kind if last else f"{kind}, text string"

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, first=number == 0, last=last, form=to_arrow(schema)) -> Iterator[pa.RecordBatch]:
            for held in _shards(batches, shard):
                counts, spans, names = phrases.find([x for b in held for x in raw(b)])
                at = 0
                for b in held:
                    to = at + b.num_rows
                    own, items = spans[at:to], names[at:to]
                    if not first:
                        own = [merged(a + [(s["start"], s["end"]) for s in x]) for a, x in zip(own, b.column("spans").to_pylist(), strict=True)]
                        items = [sorted(set(a) | set(x)) for a, x in zip(items, b.column("items").to_pylist(), strict=True)]
                    own = [[{"start": s, "end": e} for s, e in x] for x in own]
                    columns = [b.column("doc_id"), pa.array(counts[at:to], pa.int64()), pa.array(own, form.field("spans").type), pa.array(items, form.field("items").type)]
                    yield pa.RecordBatch.from_arrays(columns + ([] if last else [b.column("text")]), schema=form)
                    at = to

        out = out.mapInArrow(run, schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return "".join(kept) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES, shard: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``docs`` with benchmark passages cut out of their texts.

    Cutting is repeated until no window is left, since words may come to stand side by side.  A document
    of which no word is left goes; all others keep their columns, and untouched texts stay as they are.
    """
    steps = list(blocks(benchmark, window, most))
    form = to_arrow(docs.schema)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, shard):
            texts = [x for b in held for x in raw(b)]
            changed: dict[int, str] = {}
            look = list(range(len(texts)))
            while look:
                again = set()
                for phrases in steps:
                    _, spans, _ = phrases.find([texts[i] for i in look])
                    for i, own in zip(look, spans, strict=True):
                        if own:
                            changed[i] = cut(texts[i].decode("utf-8", "replace"), own)
                            texts[i] = changed[i].encode()
                            again.add(i)
                look = sorted(again)
            at = 0
            for b in held:
                own = {i - at: t for i, t in changed.items() if at <= i < at + b.num_rows}
                at += b.num_rows
                if own:
                    columns = b.columns
                    columns[place] = pa.array([own.get(i, x) for i, x in enumerate(b.column("text").to_pylist())], form.field("text").type)
                    b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
                    b = b.filter(pa.array([i not in own or bool(WORD.search(own[i])) for i in range(b.num_rows)]))
                yield b

    return docs.mapInArrow(run, docs.schema)
