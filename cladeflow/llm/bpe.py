"""Byte-level BPE, encoded and decoded from a public vocabulary file.

A short word is held as a contiguous array of part boundaries beside the ranks of adjacent parts.  The
smallest rank is looked for again and again; its boundary goes, and the ranks next to it are refreshed.  Long
words take a heap with the same order (smallest rank first, then leftmost) instead of repeated scans.

Defined cases: a null text is empty and has no ids.  Texts of any length are encoded whole; those beyond
``BLOCK`` characters pass through in blocks of words.  Repeated ids or rows are encoded row by row.
Strings of special tokens inside a text become those tokens, as the library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, texts

SHORT = 48             # bytes of a word that is scanned rather than put on a heap
BLOCK = 1 << 20        # characters of a text that is split into words at once
CACHE = 1 << 20        # words kept with their ids by one worker
FAR = 1 << 40          # rank of a pair that does not merge


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Ranks, ids and bytes of one vocabulary, with the ids of the words met so far."""

    def __init__(self, path: str) -> None:
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = byte_alphabet()
        plain = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {plain(token): number for token, number in model["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes = {number: token for token, number in self.ids.items()} | {n: s.encode() for s, n in self.special.items()}
        self.digits = {number: str(number) for number in self.bytes}
        self.pattern = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        if (found := self.known.get(word)) is not None:
            return found
        data = word.encode("utf-8")
        if (one := self.ids.get(data)) is not None and len(data) == 1:
            found = (one,)
        else:
            found = tuple(self.short(data) if len(data) <= SHORT else self.long(data))
        if len(data) <= SHORT:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def short(self, data: bytes) -> list[int]:
        """Scan the ranks of adjacent parts for the smallest until none merges."""
        ends, rank_of = list(range(len(data) + 1)), self.ranks.get
        ranks = [rank_of((data[i:i + 1], data[i + 1:i + 2]), FAR) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) != FAR:
            at = ranks.index(least)
            del ends[at + 1], ranks[at]
            part = data[ends[at]:ends[at + 1]]
            if at:
                ranks[at - 1] = rank_of((data[ends[at - 1]:ends[at]], part), FAR)
            if at < len(ranks):
                ranks[at] = rank_of((part, data[ends[at + 1]:ends[at + 2]]), FAR)
        ids = self.ids
        return [ids[data[a:b]] for a, b in zip(ends, ends[1:], strict=False)]

    def long(self, data: bytes) -> list[int]:
        """The same merges in the same order, with a heap over the adjacent parts."""
        size, rank_of = len(data), self.ranks.get
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        parts: list[bytes | None] = [data[i:i + 1] for i in range(size)]
        heap = [(rank, i, 2) for i in range(size - 1) if (rank := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= size or len(parts[i]) + len(parts[j]) != length or rank_of((parts[i], parts[j])) != _:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (rank := rank_of((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (rank, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (rank := rank_of((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (rank, h, len(parts[h]) + len(parts[i])))
        return [self.ids[x] for x in parts if x is not None]

    def words(self, text: str) -> Iterator[list[str]]:
        """Blocks of the words of a stretch without special tokens."""
        if len(text) <= BLOCK:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK // 8)):
            yield block

    def encode(self, text: str) -> Iterator[list[int]]:
        """Blocks of the ids of a text, in order."""
        for stretch in self.cuts.split(text) if self.cuts and "<|" in text else (text,):
            if stretch in self.special:
                yield [self.special[stretch]]
            elif stretch:
                for block in self.words(stretch):
                    known = self.known
                    yield list(chain.from_iterable([known.get(w) or self.word(w) for w in block]))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once by each worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row."""
    def step(batch: pa.RecordBatch) -> dict:
        own = codec(path)
        return {"doc_id": batch.column("doc_id"), "ids": [list(chain.from_iterable(own.encode(t))) for t in texts(batch)]}

    return mapped(docs.select("doc_id", "text"), step, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are no UTF-8 become the replacement sign."""
    def step(batch: pa.RecordBatch) -> dict:
        own = codec(path)
        return {"doc_id": batch.column("doc_id"), "text": [own.decode(x.as_py() or ()).decode("utf-8", "replace") for x in batch.column("ids")]}

    return mapped(rows.select("doc_id", "ids"), step, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text never leave the worker whole."""
    def step(batch: pa.RecordBatch) -> dict:
        own, counts, ids_sha, text_sha = codec(path), [], [], []
        for text in texts(batch):
            count, ids_hash, text_hash = 0, hashlib.sha256(), _Replacing()
            for block in own.encode(text):
                ids_hash.update((("," if count else "") + ",".join(map(own.digits.__getitem__, block))).encode())
                text_hash.update(own.decode(block))
                count += len(block)
            counts.append(count)
            ids_sha.append(ids_hash.hexdigest())
            text_sha.append(text_hash.hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return mapped(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Replacing:
    """SHA-256 of bytes read as UTF-8 in pieces that may cut a character."""

    def __init__(self) -> None:
        import codecs

        self.reader, self.hash = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256()

    def update(self, data: bytes) -> None:
        self.hash.update(self.reader.decode(data).encode())

    def hexdigest(self) -> str:
        self.hash.update(self.reader.decode(b"", True).encode())
        return self.hash.hexdigest()
