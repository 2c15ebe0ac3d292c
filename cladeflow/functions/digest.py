"""MD5 of many short messages at once, as array arithmetic: the hash that every SQL engine has."""

from __future__ import annotations

from math import floor, sin

import numpy as np

LONGEST = 55              # bytes of a message that is one block with its padding
STEP = 32768              # messages worked on at a time: enough for array calls, few enough to stay near the processor
_ADD = [floor(abs(sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_START = (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)


def md5_block(words: list[np.ndarray | int]) -> list[np.ndarray]:
    """The four words of the digest of padded one-block messages, given as sixteen little-endian words of each."""
    n = max(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, s, dtype=np.uint32) for s in _START)
    for i in range(64):
        if i < 16:
            mix, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mix, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mix, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mix, at = c ^ (b | ~d), 7 * i % 16
        mix += a
        word = words[at]
        if isinstance(word, np.ndarray):
            mix += word
            mix += np.uint32(_ADD[i])
        else:
            mix += np.uint32((_ADD[i] + word) & 0xffffffff)
        turned = mix << np.uint32(_TURN[i])
        mix >>= np.uint32(32 - _TURN[i])
        turned |= mix
        turned += b
        a, b, c, d = d, turned, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


def leading(words: list[np.ndarray]) -> np.ndarray:
    """The first 64 bits of digests, as numbers that sort like their hexadecimal text."""
    return words[0].byteswap().astype(np.uint64) << np.uint64(32) | words[1].byteswap().astype(np.uint64)


def padded(texts: list[bytes], offset: int, length: int) -> list[np.ndarray]:
    """Sixteen words of each message of ``offset`` empty bytes and a text of ``length`` bytes, with MD5's padding."""
    block = np.zeros((len(texts), 64), dtype=np.uint8)
    block[:, offset:offset + length] = np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), length)
    block[:, offset + length] = 0x80
    block[:, 56:60] = np.frombuffer(np.uint32(8 * (offset + length)).tobytes(), dtype=np.uint8)
    return list(np.ascontiguousarray(block.view("<u4").T))


_QUADS = np.array([int.from_bytes("".join("ACGT"[v >> s & 3] for s in (6, 4, 2, 0)).encode(), "little") for v in range(256)], dtype=np.uint32)
_CODES = np.full(256, 4, dtype=np.uint8)
_CODES[list(b"ACGT")] = range(4)


def _spans(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every k letters as a base-four number, read forward and as the reverse complement; by doubling."""
    forward, back = codes.astype(np.uint64), (3 - codes).astype(np.uint64)
    parts, width, done = None, 1, 0
    while True:
        if k & width:
            if parts is None:
                parts, done = (forward, back), width
            else:
                n = len(forward) - done
                parts = (parts[0][:n] << np.uint64(2 * width) | forward[done:done + n], parts[1][:n] | back[done:done + n] << np.uint64(2 * done))
                done += width
        if done == k:
            n = len(codes) - k + 1
            return parts[0][:n], parts[1][:n]
        n = len(forward) - width
        forward, back = forward[:n] << np.uint64(2 * width) | forward[width:], back[:n] | back[width:] << np.uint64(2 * width)
        width *= 2


def canonical_hashes(seq: bytes, k: int, highest: int) -> np.ndarray:
    """60-bit MD5 hashes, up to ``highest``, of the distinct canonical k-mers (k <= 31) of letters in upper case.

    K-mers with other letters than ACGT are skipped.
    """
    codes = _CODES[np.frombuffer(seq, dtype=np.uint8)]
    if len(codes) < k:
        return np.zeros(0, dtype=np.int64)
    other = np.concatenate(([0], np.cumsum(codes > 3)))
    forward, back = _spans(codes & 3, k)
    kmers = np.sort(np.minimum(forward, back)[other[k:] == other[:-k]])
    kmers = kmers[np.concatenate(([True], kmers[1:] != kmers[:-1]))] if len(kmers) else kmers
    found = []
    for lo in range(0, len(kmers), STEP):
        value, words = kmers[lo:lo + STEP], [0] * 16
        for at in range(0, k, 4):
            left = k - at - 4
            some = value >> np.uint64(2 * left) if left >= 0 else value << np.uint64(-2 * left)
            word = _QUADS[(some & np.uint64(255)).astype(np.intp)]
            words[at // 4] = word if left >= 0 else word & np.uint32((1 << 8 * (4 + left)) - 1) | np.uint32(0x80 << 8 * (4 + left))
        if k % 4 == 0:
            words[k // 4] = 0x80
        words[14] = 8 * k
        hashes = leading(md5_block(words)) >> np.uint64(4)
        found.append(hashes[hashes <= np.uint64(highest)].astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
