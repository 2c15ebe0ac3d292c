"""Token ids in a grammar-compressed file format.

Documents lie in blocks in the order of their ids.  A block is compressed by Re-Pair: frequent pairs of ids are replaced
by nonterminals, again and again; it stores its rules, the compressed ids in three bytes each, and at every 64th of them
how many ids it stands for before that, so that any stretch of ids is decoded without the rest.  Blocks are rows of
Parquet files, written by Spark's own committer into a shared folder.

Defined cases: a null or empty text is the end id alone.  Rows with equal ids all stay, ordered by text; rows without an
id come first.  A document is never cut between blocks; one longer than a block has its own.  An empty table has no block.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import to_arrow

END = 1
FIRST = 1 << 16            # the first nonterminal
BLOCK = 1 << 18            # ids of a block
RULES, LEAST = 4096, 12    # rules of one pass over a block, and how often a pair must occur; passes go on until none does
EVERY = 64
CACHE = 1 << 19
LINE = 500                 # pieces that the library gets at once
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^a-z0-9\n]+")      # as in the vocabulary file, for lower-case ASCII in lines
ROW = "part int, block int, doc_ids array<long>, counts array<long>, total long, rules binary, body binary, places binary"


def gathered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists laid end to end in ``flat``, taken in the order of their numbers, and their sizes in that order."""
    starts, many = np.cumsum(sizes) - sizes, sizes[order]
    return flat[np.repeat(starts[order] - np.cumsum(many) + many, many) + np.arange(many.sum())], many


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; faster than its own list for many short ones."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """The library's encoding, with the ids of pieces met so far.

    Text is cut at blanks, which no token of this vocabulary crosses; a distinct word of a batch is encoded once.  Words of
    printable ASCII are cut further, as the vocabulary's own pattern does, so that the library encodes distinct pieces; all
    other words, and those that may hold a special token, go to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.clear()

    def clear(self) -> None:
        """Forget the pieces: their numbers, and by number their ids."""
        self.known, self.flat, self.sizes = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column, the end id last; null is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded, ends = words.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(words).to_numpy())
        flat, sizes = self.words(coded.dictionary)
        order = np.insert(coded.indices.to_numpy(), ends, len(sizes))        # the end id is one more word after each text
        ids, many = gathered(np.append(flat, END), np.append(sizes, 1), order)
        return np.split(ids, np.cumsum(many)[ends + np.arange(len(ends))][:-1])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(words, "^[!-~]*$"), pc.match_substring(words, "<|"))
        lines = "\n".join([*strings(words.filter(plain)), ""]).lower()
        pieces = pa.array(PIECE.findall(lines), pa.string()).dictionary_encode()
        names, codes = strings(pieces.dictionary), pieces.indices.to_numpy()
        flat, many = gathered(*self.pieces(names), codes)
        sizes = np.diff(np.cumsum(many)[codes == (names.index("\n") if names else -1)], prepend=0)
        more, own = self.pieces(strings(words.filter(pc.invert(plain))))
        first = plain.to_numpy(zero_copy_only=False)
        return gathered(np.append(flat, more), np.append(sizes, own), np.where(first, np.cumsum(first) - 1, len(sizes) + np.cumsum(~first) - 1))

    def pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct texts by the library, end to end, and how many each has."""
        if len(self.known) > CACHE or len(self.flat) > 8 * CACHE:
            self.clear()
        known = self.known
        missing = [x for x in names if x not in known]
        if missing:
            flat, sizes = self.encoded(missing)
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)
            known.update(zip(missing, range(len(known), len(known) + len(missing)), strict=True))
        return gathered(self.flat, self.sizes, np.fromiter(map(known.__getitem__, names), np.int64, len(names)))

    def encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``pieces`` by the library alone, which gets them in lines; the offsets of tokens tell whose they are."""
        lines = [names[i:i + LINE] for i in range(0, len(names), LINE)]
        flat, sizes = [], []
        for line, found in zip(lines, self.library.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *(len(x) + 1 for x in line[:-1])])
            first = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            flat.append(np.array(found.ids, np.int64))
            sizes.append(np.bincount(np.searchsorted(starts, first, "right") - 1, minlength=len(line)))
        return np.concatenate(flat), np.concatenate(sizes)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once by each worker."""
    return Encoder(path)


def compress(ids: np.ndarray, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs, the first one is nonterminal ``FIRST``) and compressed ids, in which no pair occurs ``least`` times."""
    made, body = [], ids
    while len(body) > 1:
        keys = (body[:-1] << 32) | body[1:]
        slots = ((keys * np.int64(-7046029254386353131)) >> 46) & ((1 << 18) - 1)
        often = np.bincount(slots, minlength=1 << 18)[slots] >= least       # most pairs are rare and are not sorted
        pairs, counts = np.unique(keys[often], return_counts=True)
        best = np.argsort(-counts, kind="stable")[:rules]
        pairs = np.sort(pairs[best[counts[best] >= least]])
        if not len(pairs):
            break
        where = np.flatnonzero(often)
        at = np.minimum(np.searchsorted(pairs, keys[where]), len(pairs) - 1)
        hit = pairs[at] == keys[where]
        where, at = where[hit], at[hit]
        lead = np.flatnonzero(np.diff(where, prepend=-2) != 1)      # in a run of overlapping pairs every second one goes
        turn = np.arange(len(where)) - np.repeat(lead, np.diff(np.append(lead, len(where))))
        where, at = where[turn % 2 == 0], at[turn % 2 == 0]
        body = body.copy()
        body[where] = FIRST + len(made) + at
        keep = np.ones(len(body), bool)
        keep[where + 1] = False
        body = body[keep]
        made += [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()]
    return np.array(made, np.int64).reshape(-1, 2), body


class Grammar:
    """Expansions of the rules of a block."""

    def __init__(self, rules: np.ndarray) -> None:
        lengths = np.ones(FIRST + len(rules), np.int64)
        self.parts: list[np.ndarray] = []
        one = lambda s: self.parts[s - FIRST] if s >= FIRST else np.array([s])
        for a, b in rules.tolist():
            self.parts.append(np.concatenate([one(a), one(b)]))
            lengths[FIRST + len(self.parts) - 1] = len(self.parts[-1])
        self.lengths = lengths
        self.flat = np.concatenate([np.arange(FIRST), *self.parts])
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def expand(self, body: np.ndarray) -> np.ndarray:
        """Ids of a stretch of compressed ids."""
        sizes = self.lengths[body]
        begin = np.repeat(self.starts[body] - np.cumsum(sizes) + sizes, sizes)
        return self.flat[begin + np.arange(sizes.sum())]


def stored(ids: np.ndarray) -> dict[str, bytes]:
    """Binary columns of a block."""
    rules, body = compress(ids)
    before = np.cumsum(Grammar(rules).lengths[body])
    places = np.concatenate([[0], before[EVERY - 1::EVERY]])
    return {"rules": rules.astype("<u4").tobytes(), "places": places.astype("<u8").tobytes(),
            "body": body.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()}


class Block:
    """A block read back."""

    def __init__(self, rules: bytes, body: bytes, places: bytes) -> None:
        self.grammar = Grammar(np.frombuffer(rules, "<u4").astype(np.int64).reshape(-1, 2))
        self.body, self.places = np.frombuffer(body, np.uint8).reshape(-1, 3), np.frombuffer(places, "<u8").astype(np.int64)

    def symbols(self, start: int, end: int) -> np.ndarray:
        """Compressed ids from ``start`` to ``end``."""
        three = self.body[start:end].astype(np.int64)
        return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the block; only the compressed ids around them are read."""
        low = int(np.searchsorted(self.places, start, "right")) - 1
        high = int(np.searchsorted(self.places, end, "left"))
        first = int(self.places[low])
        return self.grammar.expand(self.symbols(low * EVERY, high * EVERY))[start - first:end - first]


def write(docs: DataFrame, vocabulary: str, path: str, block: int = BLOCK) -> None:
    """Encode ``docs`` and write their ids to ``path`` in ascending order of doc_id."""
    form = to_arrow(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "block": number, "doc_ids": names, "counts": [len(x) for x in held], "total": size} | stored(np.concatenate(held))
            return pa.RecordBatch.from_pylist([row], schema=form)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text")), strict=True):
                if held and size + len(ids) > block:
                    yield flush()
                    names, held, size, number = [], [], 0, number + 1
                names.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, ROW).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of a folder of blocks."""
    blocks = spark.read.schema(ROW).parquet(path)
    sizes = blocks.select("part", "block", "total")
    parts = sizes.groupBy("part").agg(F.sum("total").alias("all")).orderBy("part").collect()      # one row for each file
    before, at = [], 0
    for r in parts:
        before.append((r["part"], at))
        at += r["all"]
    heads = spark.createDataFrame(before, "part int, before long")
    earlier = F.sum("total").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "block", F.coalesce(earlier, F.lit(0)).alias("within")).join(F.broadcast(heads), "part")
    kind = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    form = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                block, out, place = Block(one["rules"], one["body"], one["places"]), [], 0
                whole = block.ids(0, one["total"])
                for doc, count in zip(one["doc_ids"], one["counts"], strict=True):
                    own = whole[place:place + count]
                    out.append({"part": one["part"], "block": one["block"], "doc_id": doc, "at": place, "n_tokens": count,
                                "ids_crc32": zlib.crc32(own.astype("<u4").tobytes())} | ({"ids": own} if ids else {}))
                    place += count
                yield pa.RecordBatch.from_pylist(out, schema=form)

    found = blocks.mapInArrow(run, kind).join(starts, ["part", "block"])
    return found.select("doc_id", (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
