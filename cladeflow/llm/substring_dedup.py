"""Substring de-duplication by super-k-mers.

A window is ``WINDOW`` consecutive words of one document; it is a repeat where its word sequence also starts in a document
with a smaller id.  Words covered by a repeat are removed, all windows judged on the input.

The minimiser of a window is the smallest hash of its ``GRAM``-word grams, so equal windows have equal minimisers.
Consecutive windows that share theirs are one super-k-mer and travel as one packed string to the bucket of that
minimiser, where equal strings are merged and the windows of the others sorted, so that each is counted exactly.

* **What travels.**  A first pass counts super-k-mers and smallest and largest id by minimiser, combined in every batch before
  the shuffle.  Windows whose minimiser occurs in one document only are no repeats.  The other minimisers set bits of a filter of at
  most ``FILTER_BITS`` bits, which each task holds; a minimiser that meets a bit by chance travels too and changes nothing.
* **Hot buckets.**  The super-k-mers of a minimiser with more than ``LIMIT`` of them are dealt over parts of that size in turn,
  copies included.  Each part merges equal strings, so a part holds the copies of a text once; the rest of its windows
  meet the other parts' as 128-bit digests, as a plain minimum by digest that combines before the shuffle.  Only windows with
  different smallest ids in two parts are joined back.

Defined cases: a null or empty text has no words.  A row without an id counts as having the largest: it loses what any named
document has, and takes nothing.  Rows with one id never take words from one another, and each is judged by its own text.  A
text shorter than a window stays as it is, its words joined by one space.  Columns beside the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, light, raw, to_arrow, written

WINDOW, GRAM = 50, 10        # words of a window and of a gram
LIMIT = 2000                 # super-k-mers of one minimiser that one group of a task holds
WORDS = 1 << 19              # words worked on at once; a longer document is one batch
KNOWN = 1 << 18              # words whose hash a task keeps
FILTER_BITS = 1 << 29        # largest filter of minimisers: 64 MB in a task
LARGEST = (1 << 63) - 1      # stands for a null id
PAGE = 32768                 # bits of one bitmap of Spark's bitmap functions

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of the grams at every place, built from those of half the length."""
    done, size, out, covered = words, 1, None, 0
    while True:
        if gram & size:
            at = done[covered:]
            out = at if out is None else _mixed(out[:len(at)] * _FACTOR + at[:len(out)])
            covered += size
        if 2 * size > gram:
            return out
        done, size = _mixed(done[:-size] * _FACTOR + done[size:]), 2 * size


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive hashes at every place, by doubling."""
    size = 1
    while 2 * size <= width:
        hashes, size = np.minimum(hashes[:-size], hashes[size:]), 2 * size
    return np.minimum(hashes[:len(hashes) - width + size], hashes[width - size:]) if width > size else hashes


def super_kmers(words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, document, first window and number of windows of every super-k-mer of documents laid end to end.

    One holds at most as many windows as a window has grams, so that a text of one word is cut too.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none
    width = window - gram + 1
    least = minimisers(gram_hashes(words, gram), width)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    at = np.flatnonzero(left >= window)
    if not len(at):
        return none, none, none, none
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    pieces = -(-length // width)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(at[first], pieces) + part * width
    count = np.minimum(np.repeat(length, pieces) - part * width, width)
    document = np.searchsorted(np.cumsum(sizes), start, "right")
    return np.repeat(value[first], pieces).view(np.int64), document, start, count


def _keyed(docs: DataFrame) -> DataFrame:
    """Key of a row: its id and a hash of its text, so that rows with one id keep their own spans."""
    return docs.select(F.coalesce("doc_id", F.lit(LARGEST)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """doc, row, all words and their hashes, words by document: of about ``most`` words at once."""
    known: dict[bytes, int] = {}
    for batch in batches:
        doc, row, words, sizes = [], [], [], []
        ids, rows = batch.column("doc").to_pylist(), batch.column("row").to_pylist()
        for i, text in enumerate(raw(batch)):
            own = text.split()
            doc.append(ids[i])
            row.append(rows[i])
            sizes.append(len(own))
            words += own
            if len(words) >= most or i + 1 == batch.num_rows:
                if len(known) > KNOWN:
                    known.clear()
                hashed = [known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words]
                yield np.array(doc, np.int64), np.array(row, np.int64), words, np.array(hashed, np.uint64), np.array(sizes, np.int64)
                doc, row, words, sizes = [], [], [], []


def counted(keyed: DataFrame, window: int, gram: int, words: int = WORDS) -> DataFrame:
    """Minimisers that windows of two or more documents have, with the number of their super-k-mers."""
    kind = "mz long, low long, high long, many long"
    form = to_arrow(kind)

    def run(batches):
        for doc, _, _, hashed, sizes in _batches(batches, words):
            value, own, _, _ = super_kmers(hashed, sizes, window, gram)
            if len(value):
                order = np.argsort(value, kind="stable")
                value, ids = value[order], doc[own[order]]
                first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                columns = value[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), np.diff(np.append(first, len(value)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=form)

    return written(keyed.mapInArrow(run, kind).groupBy("mz").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("many").alias("many"))
                   .where("low < high").select("mz", "many"))


def _filter(repeated: DataFrame, most: int) -> np.ndarray:
    """Bits set for the minimisers, 16 bits or more for each while ``most`` allows it; no more than ``most`` bits reach the driver."""
    bits = PAGE
    while bits < min(most, 16 * repeated.count()):
        bits *= 2
    slot = F.pmod("mz", F.lit(bits)) + 1
    pages = repeated.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for page in pages.toLocalIterator():
        at = (page.page - 1) * PAGE // 8
        out[at:at + PAGE // 8] = np.frombuffer(bytes(page.bits), np.uint8)
    return out


def packed(keyed: DataFrame, repeated: DataFrame, window: int, gram: int, bits: int = FILTER_BITS, words: int = WORDS) -> DataFrame:
    """The super-k-mers that travel: minimiser, document, first word and the packed words; ``turn`` numbers those of a task."""
    held = keyed.sparkSession.sparkContext.broadcast(_filter(repeated, bits))      # of bounded size
    kind = "mz long, turn long, doc long, row long, start long, data binary"
    form = to_arrow(kind)

    def run(batches):
        mask, turn = held.value, 0
        for doc, row, text, hashed, sizes in _batches(batches, words):
            value, own, start, count = super_kmers(hashed, sizes, window, gram)
            slot = value % np.int64(8 * len(mask))
            going = np.flatnonzero((mask[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            begin = (np.cumsum(sizes) - sizes)[own]
            for some in np.array_split(going, len(going) // 20000 + 1):
                if len(some):
                    strings = [b" ".join(text[a:b]) for a, b in zip(start[some].tolist(), (start + count + window - 1)[some].tolist(), strict=True)]
                    columns = value[some], turn + np.arange(len(some)), doc[own[some]], row[own[some]], (start - begin)[some]
                    turn += len(some)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(strings, pa.binary())], schema=form)

    return keyed.mapInArrow(run, kind)


def windows_of(data: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    place = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    starts, ends = [0, *(p + 1 for p in place)], [*place, len(data)]
    return [data[a:b] for a, b in zip(starts, ends[window - 1:], strict=False)]


def first_ids(strings: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """Smallest id of every window of distinct strings, each given with its own smallest id, by sorting all windows."""
    if len(strings) == 1:
        return [[strings[0][1]] * len(windows_of(strings[0][0], window))]
    cut = [windows_of(data, window) for data, _ in strings]
    out = [[low] * len(own) for own, (_, low) in zip(cut, strings, strict=True)]
    rows = sorted((text, strings[i][1], i, j) for i, own in enumerate(cut) for j, text in enumerate(own))
    last, low = None, 0
    for text, own, i, j in rows:
        if text != last:
            last, low = text, own
        out[i][j] = low
    return out


def _ranges(firsts: list[int], doc: int, start: int, window: int) -> Iterator[tuple[int, int]]:
    """Word ranges of a document that its repeated windows cover."""
    begin = None
    for i, first in enumerate(firsts):
        if first < doc and begin is None:
            begin = i
        if begin is not None and first >= doc:
            yield start + begin, start + i - 1 + window
            begin = None
    if begin is not None:
        yield start + begin, start + len(firsts) - 1 + window


_SPANS = "doc long, row long, begin long, end long"
_FOUND = f"{_SPANS}, mz long, part long, no long, low long, windows array<binary>, holders array<struct<doc: long, row: long, start: long>>"


def counted_windows(rows: DataFrame, window: int) -> DataFrame:
    """Spans found in whole buckets; for parts of hot buckets their strings, as digests of the windows.

    ``rows`` lie together by minimiser and part, ordered by packed string.
    """
    form, names = to_arrow(_FOUND), [f.name for f in to_arrow(_FOUND)]

    def group(key: tuple, strings: list[tuple[bytes, list]]) -> Iterator[dict]:
        mz, part, parts = key
        lows = [min(h[0] for h in holders) for _, holders in strings]
        if parts == 1:
            if len(strings) == 1 and lows[0] == max(h[0] for h in strings[0][1]):
                return                                                          # a single document
            for (_, holders), firsts in zip(strings, first_ids([(s, low) for (s, _), low in zip(strings, lows, strict=True)], window), strict=True):
                for doc, row, start in holders:
                    for begin, end in _ranges(firsts, doc, start, window):
                        yield {"doc": doc, "row": row, "begin": begin, "end": end}
        else:
            for no, ((data, holders), low) in enumerate(zip(strings, lows, strict=True)):
                yield {"mz": mz, "part": part, "no": no, "low": low, "windows": [blake2b(w, digest_size=16).digest() for w in windows_of(data, window)],
                       "holders": [{"doc": d, "row": r, "start": s} for d, r, s in holders]}

    def groups(batches) -> Iterator[dict]:
        key, strings = None, []
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for mz, part, parts, doc, row, start, data in zip(*(column[c] for c in ("mz", "part", "parts", "doc", "row", "start", "data")), strict=True):
                if (mz, part, parts) != key:
                    if strings:
                        yield from group(key, strings)
                    key, strings = (mz, part, parts), []
                if not strings or strings[-1][0] != data:
                    strings.append((data, []))
                strings[-1][1].append((doc, row, start))
        if strings:
            yield from group(key, strings)

    def run(batches):
        some = []
        for row in groups(batches):
            some.append(row)
            if len(some) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in some], f.type) for n, f in zip(names, form, strict=True)], schema=form)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in some], f.type) for n, f in zip(names, form, strict=True)], schema=form)

    return rows.mapInArrow(run, _FOUND)


def hot_spans(found: DataFrame, window: int) -> DataFrame:
    """Spans of the documents in the parts of hot buckets."""
    form, key = to_arrow(_SPANS), ["mz", "part", "no"]
    strings = found.where("windows IS NOT NULL").select(*key, "low", "windows", "holders")
    places = strings.select(*key, "low", F.posexplode("windows").alias("at", "digest"))
    least = written(places.groupBy("digest").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").select("digest", "first"))
    earlier = (places.join(light(least), "digest").where("first < low")
               .groupBy(*key).agg(F.collect_list(F.struct("at", "first")).alias("earlier")))

    def run(batches):
        for batch in batches:
            doc, row, begin, end = [], [], [], []
            for record in batch.to_pylist():
                firsts = [record["low"]] * record["n"]
                for e in record["earlier"] or []:
                    firsts[e["at"]] = e["first"]
                for h in record["holders"]:
                    for a, b in _ranges(firsts, h["doc"], h["start"], window):
                        doc.append(h["doc"])
                        row.append(h["row"])
                        begin.append(a)
                        end.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, row, begin, end)], schema=form)

    return strings.select(*key, "low", F.size("windows").alias("n"), "holders").join(earlier, key, "left").drop(*key).mapInArrow(run, _SPANS)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, bits: int = FILTER_BITS) -> DataFrame:
    """Key of a row (doc, row) and the word ranges that its repeated windows cover, for rows that have any."""
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit into the window")
    keyed = _keyed(docs)
    repeated = counted(keyed, window, gram)
    hot = light(repeated.where(F.col("many") > limit).select("mz", F.ceil(F.col("many") / limit).alias("parts")))
    going = packed(keyed, repeated, window, gram, bits).join(hot, "mz", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    going = going.withColumn("part", F.pmod("turn", "parts")).drop("turn")
    found = written(counted_windows(going.repartition("mz", "part").sortWithinPartitions("mz", "part", "data"), window))
    spans = found.where("windows IS NULL").select("doc", "row", "begin", "end")
    if found.where("windows IS NOT NULL").head(1):
        spans = spans.unionByName(hot_spans(found, window))
    return written(spans.groupBy("doc", "row").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))


def clean(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row, joined by one space."""
    found = repeats(docs, window, gram, limit, bits)
    few = (found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]) <= BROADCAST_ROWS
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LARGEST)).alias("doc"), F.xxhash64("text").alias("row"))
    rows = keyed.join(F.broadcast(found) if few else found, ["doc", "row"], "left").select("doc_id", "text", "spans")
    kind = "doc_id long, n_words long, n_removed long, kept string"
    form = to_arrow(kind)

    def run(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(raw(batch), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if spans:
                    keep, reach = [], 0
                    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                        keep += words[reach:max(reach, begin)]
                        reach = max(reach, end)
                    words = keep + words[reach:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], schema=form)

    return rows.mapInArrow(run, kind)
