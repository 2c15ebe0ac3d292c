"""K-mer sets of texts by super-k-mers: consecutive k-mers that share their rarest gram travel as one short text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

LETTERS = 1 << 21         # letters worked on at a time
SLOTS = 1 << 16           # hashes of grams that are counted apart
LONGEST = 255             # letters of a piece: its length is one byte
LARGEST_K = 128           # longest k-mers that pieces are made for

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_of(k: int) -> int:
    """Letters of the gram by which k-mers are dealt."""
    return min(k, max(4, k // 3))


def chunks(rows: Iterable[tuple[int, str]], k: int, most: int = LETTERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, lengths and joined letters of ``(number, text)`` rows, about ``most`` letters at a time.

    A longer text is cut into pieces that overlap by k - 1 letters; texts without a k-mer are left out.
    """
    held, numbers, size = [], [], 0
    for number, text in rows:
        for lo in range(0, len(text) - k + 1, most):
            held.append(text[lo:lo + most + k - 1])
            numbers.append(number)
            size += len(held[-1])
            if size >= most:
                yield _joined(numbers, held)
                held, numbers, size = [], [], 0
    if held:
        yield _joined(numbers, held)


def _joined(numbers: list[int], held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(numbers, np.uint8), np.array([len(x) for x in held], np.int64), np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)


def gram_slots(letters: np.ndarray, gram: int) -> np.ndarray:
    """The slot of the gram at every place."""
    count = len(letters) - gram + 1
    out = np.zeros(count, np.uint64)
    for i in range(gram):
        out += letters[i:i + count]
        out *= _FACTOR
        out ^= out >> np.uint64(29)
    return (out * _FACTOR >> np.uint64(48)).astype(np.uint16)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values at every place, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def pieces(numbers: np.ndarray, lengths: np.ndarray, letters: np.ndarray, k: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rank of the rarest gram, number, first letter and letters of the runs of k-mers of one text that share that gram."""
    gram = gram_of(k)
    lowest = smallest(ranks[gram_slots(letters, gram)], k - gram + 1)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[:len(lowest)]
    whole = np.arange(k, len(lowest) + k) <= np.cumsum(lengths)[text]
    goes_on = whole[1:] & whole[:-1] & (lowest[1:] == lowest[:-1]) & (text[1:] == text[:-1])
    first = np.flatnonzero(whole & ~np.append(False, goes_on))
    count = np.flatnonzero(whole & ~np.append(goes_on, False)) + 1 - first
    width = LONGEST - k + 1
    parts = -(-count // width)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + part * width
    size = np.minimum(np.repeat(count, parts) - part * width, width) + k - 1
    return lowest[start], numbers[text[start]], start, size


def packed(letters: np.ndarray, bucket: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Pieces by bucket: the bucket, the numbers, the lengths and the joined texts of its pieces."""
    order = np.lexsort((number, bucket))
    bucket, number, start, size = bucket[order], number[order].tobytes(), start[order], size[order]
    ends = np.cumsum(size)
    own = letters[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
    text = own.tobytes().decode("utf-32-le").encode()
    after = np.cumsum(1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000))[ends - 1]
    lengths = size.astype(np.uint8).tobytes()
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    begin = 0
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
        end = int(after[hi - 1])
        yield int(bucket[lo]), number[lo:hi], lengths[lo:hi], text[begin:end]
        begin = end


def carriers(number: bytes, size: bytes, text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers have a k-mer, one bit each, and how many different k-mers have just these; all pieces of a bucket."""
    number, size = np.frombuffer(number, np.uint8), np.frombuffer(size, np.uint8).astype(np.int64)
    letters = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(letters.max()) + 1, bool)
    seen[letters] = True
    letters = (np.cumsum(seen) - 1).astype(np.uint32)[letters]        # the bucket's own alphabet, so that a k-mer is a few numbers
    bits = max(1, (int(seen.sum()) - 1).bit_length())
    count = size - k + 1
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(count.sum())
    words = []
    for lo in range(0, k, 64 // bits):
        word = np.zeros(len(at), np.uint64)
        for j in range(lo, min(lo + 64 // bits, k)):
            word <<= np.uint64(bits)
            word |= letters[at + j]
        words.append(word)
    key = words[0]
    for word in words[1:]:
        key = (key ^ key >> np.uint64(31)) * _FACTOR + word
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    first = _changes([key], order)
    exact = _changes(words, order)
    if not np.array_equal(first, exact):          # two k-mers of one hash: they are told apart by their letters
        order = np.lexsort(words)
        exact = _changes(words, order)
    masks = (np.int64(1) << np.repeat(number, count).astype(np.int64))[order]
    return np.unique(np.bitwise_or.reduceat(masks, np.flatnonzero(exact)), return_counts=True)


def _changes(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where, in this order, a number differs from the one before."""
    out = np.zeros(len(order), bool)
    out[0] = True
    for word in words:
        own = word[order]
        out[1:] |= own[1:] != own[:-1]
    return out
