"""Periodic runs of words, by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends and that is at least ``max(LEAST, TIMES * q)`` words long.  Two words q apart lie on the diagonal of lag q; a run
of the least length covers ``max(LEAST - q, (TIMES - 1) * q)`` places of it.  That is the minimum guaranteed overlap, so
for the lags of one class, ``(2^(j-1), 2^j]``, the words are indexed by grams of just that many words.

* **Seeds.**  Grams get exact numbers by doubling: a gram of 2m words is a pair of grams of m words, and a gram that
  occurs once is left out from then on.  Each occurrence is paired with the next one of the same gram in the document
  only.  As a gram is no shorter than the lags of its class (``TIMES`` is 3 or more), a smaller lag between would make the period smaller: so
  consecutive occurrences inside a run are exactly its period apart, and a lag found is the smallest period.  A group of
  equal grams gives as many pairs as it has members, never its square.
* **Extension.**  Seeds are taken by lag and place; a table holds for every lag how far its diagonal is covered, and a
  seed below that mark belongs to a stretch already extended.  Others are extended both ways, by doubling steps.

All documents of a batch are worked on together: words get other numbers in each document, so no gram that spans
two documents occurs twice.  Documents are independent, so nothing is shuffled; batches are cut by words, so memory
follows the longest document.  Time is n log n in its words.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text.  A null id and repeated rows
are rows like any other.  Columns beside the id and the text are not read.  Among runs of the greatest exponent
(compared exactly) the one with the smallest start, then the smallest period is ``best``; null without runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw, to_arrow

LEAST, TIMES = 6, 4          # shortest run in words, and in periods
WORDS = 1 << 20              # words worked on at once; a longer document is one batch
SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "best struct<start: long, length: long, period: long>, collapsed string")


def _numbered(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that occur more than once, grouped by key and ascending within, and the number of each one's key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(len(keys), bool)
    often[1:] |= same
    often[:-1] |= same
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    return places[order][often], (np.cumsum(first) - 1)[often]


def _grams(names: np.ndarray, places: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated pairs of the grams at a place and ``shift`` words on; ``names`` is -1 where a gram occurs once."""
    places = places[places + shift < len(names)]
    later = names[places + shift]
    places, later = places[later >= 0], later[later >= 0]
    return _numbered(names[places] * np.int64(len(names) + 1) + later, places)


def classes(longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """low, high and gram of each class of lags: what every run of a lag in it, or in a later class, is sure to overlap."""
    out, low, high = [], 0, 1
    while times * (low + 1) <= longest:
        out.append((low, high, min(max(least - q, (times - 1) * q) for q in range(low + 1, min(high, max(low + 1, least)) + 1))))
        low, high = high, 2 * high
    for i in range(len(out) - 1, 0, -1):
        out[i - 1] = (*out[i - 1][:2], min(out[i - 1][2], out[i][2]))
    return out


def seeds(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of consecutive occurrences of the grams, for every class of lags.

    ``words`` are numbers from 0; ``longest`` is the number of words of the longest document in them.
    """
    found, lags = [], []
    places, number = _numbered(words, np.arange(len(words)))
    size = 1
    for low, high, gram in classes(longest, least, times):
        while 2 * size <= gram and len(places):
            names = np.full(len(words), -1, np.int64)
            names[places] = number
            places, number = _grams(names, np.sort(places), size)
            size *= 2
        if not len(places):
            break
        at, name = places, number
        if gram > size:
            names = np.full(len(words), -1, np.int64)
            names[places] = number
            at, name = _grams(names, np.sort(places), gram - size)
        lag = at[1:] - at[:-1]
        near = (name[1:] == name[:-1]) & (lag > low) & (lag <= high)
        found.append(at[:-1][near])
        lags.append(lag[near])
    return (np.concatenate(found), np.concatenate(lags)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of two arrays agree, read in steps that double."""
    at, step, most = 0, 32, min(len(a), len(b))
    while at < most:
        end = min(most, at + step)
        other = np.flatnonzero(a[at:end] != b[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, 2 * step
    return most


def extended(words: np.ndarray, places: np.ndarray, lags: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length and period of the runs that hold a seed, by start and period."""
    order = np.lexsort((places, lags))
    covered: dict[int, int] = {}
    out = []
    for place, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
        if place < covered.get(lag, 0):
            continue
        end = place + lag + _same_ahead(words[place:], words[place + lag:])
        start = place - _same_ahead(words[:place][::-1], words[:place + lag][::-1])
        covered[lag] = end - lag
        if end - start >= max(least, times * lag):
            out.append((start, end - start, lag))
    return sorted((s, n, q) for s, n, q in out)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:                # by start and period, so that a later one must be greater
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _record(run: tuple[int, int, int]) -> dict:
    return {"start": run[0], "length": run[1], "period": run[2]}


def _solved(ids: list, docs: list[list[bytes]], least: int, times: int, form: pa.Schema) -> pa.RecordBatch:
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for words in docs for w in words], np.int64)
    sizes = np.array([len(words) for words in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    apart = numbers + np.repeat(np.arange(len(docs)), sizes) * np.int64(len(known) + 1)      # other numbers in each document
    at, lag = seeds(apart, int(sizes.max(initial=0)), least, times)
    found: dict[int, list] = {}
    for start, length, period in extended(apart, at, lag, least, times):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        found.setdefault(doc, []).append((start - int(starts[doc]), length, period))
    runs, best, collapsed = [], [], []
    for i, words in enumerate(docs):
        own = found.get(i, [])
        if own:
            keep, reach = [], 0
            for start, length, period in sorted((s + q, s + n, q) for s, n, q in own):       # stretches that go
                keep += words[reach:max(reach, start)]
                reach = max(reach, length)
            words = keep + words[reach:]
        top = _best(own)
        runs.append([_record(r) for r in own])
        best.append(_record(top) if top else None)
        collapsed.append(b" ".join(words))
    columns = [ids, sizes, runs, best, pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, form, strict=True)], schema=form)


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, words: int = WORDS) -> DataFrame:
    """The runs of every row's text, the greatest one, and the text without the words that repeat a first period.

    A word goes if any run contains it after that run's first period; the words kept are joined by one space.
    """
    if least < 2 or times < 3:
        raise ValueError("a gram as long as its lag is guaranteed from three periods on")
    form = to_arrow(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, split, total = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                ids.append(doc_id)
                split.append(text.split())
                total += len(split[-1])
                if total >= words:
                    yield _solved(ids, split, least, times, form)
                    ids, split, total = [], [], 0
            if ids:
                yield _solved(ids, split, least, times, form)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
