"""Coefficients by number of carriers and by score, in blocks, and their products.

A table of counts ``c[score, k]`` is cut by k into blocks of ``BLOCK`` and held as logarithms, minus infinity for
none: scores of a block are rows from ``low`` on.  Products are convolutions in both directions.  Each row is scaled by
its largest entry before it leaves the logarithms; within so few k entries differ by less than a double can hold.

The state of some siblings is what their sets share, as a bit mask (1 = {0}, 2 = {1}, 3 = both, 0 = nothing): siblings that
share nothing take both states together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
CELLS = 1 << 20           # numbers of one matrix product
NEAR = 100.0              # logarithm of the scales that one sum holds
Tables = dict[tuple[int, int], tuple[int, np.ndarray]]      # (state, block) -> lowest score and logarithms
# Pairs of sums of states whose products have a state in common; together every pair of states once.
PRODUCTS = ((3, (3,), (3,)), (1, (1,), (1, 3)), (1, (3,), (1,)), (2, (2,), (2, 3)), (2, (3,), (2,)),
            (0, (0,), (0, 1, 2, 3)), (0, (1, 2, 3), (0,)), (0, (1,), (2,)), (0, (2,), (1,)))
SUMS = sorted({states for _, *sides in PRODUCTS for states in sides})


def log_binomials(n: int, ks: np.ndarray) -> np.ndarray:
    """Logarithms of n over k."""
    from math import lgamma

    return np.array([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for k in ks.tolist()])


def scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as plain numbers of at most 1, and the logarithm each was divided by, minus infinity for an empty row."""
    top = rows.max(axis=1)
    return np.exp(rows - np.where(np.isfinite(top), top, 0.0)[:, None]), top


def _places(x: np.ndarray, y: np.ndarray):
    """Products of every row of ``x`` with every row of ``y`` by place, in parts of limited size: first rows and ``(x, y, place)``."""
    n, width = x.shape[1], x.shape[1] + y.shape[1] - 1
    some = max(1, CELLS // (n * width))
    for j in range(0, len(y), some):
        padded = np.zeros((len(y[j:j + some]), width + n - 1))
        padded[:, n - 1:n - 1 + y.shape[1]] = y[j:j + some]
        shifted = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[:, ::-1].transpose(1, 0, 2).reshape(n, -1)
        step = max(1, CELLS // (len(padded) * width))
        for i in range(0, len(x), step):
            yield i, j, (x[i:i + step] @ shifted).reshape(-1, len(padded), width)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two blocks: scores add up, and so do the places within the blocks.

    The places are a matrix product, and what adds up to one score is weighted by the largest scale among it.  All terms
    are positive, so nothing cancels.  Parts of a scale too small for one sum are added as logarithms where they may count.
    """
    if len(a) < len(b):
        a, b = b, a
    (x, up_x), (y, up_y) = scaled(a), scaled(b)
    out = np.zeros((len(a) + len(b) - 1, a.shape[1] + b.shape[1] - 1))
    ups, at = up_x[:, None] + up_y, np.add.outer(np.arange(len(a)), np.arange(len(b)))
    top = np.full(len(out), -np.inf)
    np.maximum.at(top, at, ups)
    top = np.where(np.isfinite(top), top, 0.0)
    near = ups >= top[at] - NEAR
    weights = np.where(near, np.exp(ups - top[at]), 0.0)
    for i, j, met in _places(x, y):
        met *= weights[i:i + met.shape[0], j:j + met.shape[1], None]
        for s, row in enumerate(met, i + j):
            out[s:s + len(row)] += row
    late = ~near & np.isfinite(ups) & (out.min(axis=1) < np.exp(-NEAR / 2))[at]
    with np.errstate(divide="ignore"):
        out = np.log(out) + top[:, None]
        if late.any():
            for i, j, met in _places(x, y):
                for r, row in enumerate(met):
                    c = np.flatnonzero(late[i + r, j:j + len(row)])
                    if len(c):
                        s = i + r + j + c
                        out[s] = np.logaddexp(out[s], np.log(row[c]) + ups[i + r, j + c, None])
    return out


def total(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Sum of tables with their lowest scores; rows without any entry at both ends are left out."""
    low, high = min(p[0] for p in parts), max(p[0] + len(p[1]) for p in parts)
    out = np.full((high - low, parts[0][1].shape[1]), -np.inf)
    for at, table in parts:
        own = out[at - low:at - low + len(table)]
        np.logaddexp(own, table, out=own)
    used = np.flatnonzero(np.isfinite(out).any(axis=1))
    return (low, out[:0]) if not len(used) else (low + int(used[0]), out[used[0]:used[-1] + 1])


def gathered(rows) -> Tables:
    """Tables of rows ``(state, block, low, logs)``; what has one state and block is added up."""
    met: dict[tuple[int, int], list] = {}
    for state, block, low, logs in rows:
        met.setdefault((state, block), []).append((low, np.asarray(logs, dtype=float).reshape(-1, BLOCK)))
    return {key: parts[0] if len(parts) == 1 else total(parts) for key, parts in met.items()}


def combined(x: Tables, y: Tables, last: int | None = None) -> Tables:
    """Tables of two sets of siblings together, up to block ``last``: the states that all share are those that both share.

    State 0 (none is shared) stays with whatever follows, so a set of siblings needs nothing else.
    """
    def sums(side: Tables) -> dict[int, dict[tuple[int, ...], tuple[int, np.ndarray]]]:
        out: dict[int, dict] = {}
        for block in {b for _, b in side}:
            for states in SUMS:
                parts = [side[s, block] for s in states if (s, block) in side]
                if parts and len((made := parts[0] if len(parts) == 1 else total(parts))[1]):
                    out.setdefault(block, {})[states] = made
        return out

    left, right, met = sums(x), sums(y), {}
    for bx, own in left.items():
        for by, other in right.items():
            if last is not None and bx + by > last:
                continue
            for state, a, b in PRODUCTS:
                if a in own and b in other:
                    part = own[a][0] + other[b][0], product(own[a][1], other[b][1])
                    key = state, bx + by
                    met[key] = total([met[key], part]) if key in met else part
    out: dict[tuple[int, int], list] = {}
    for (state, block), (low, table) in met.items():
        for step, piece in enumerate((table[:, :BLOCK], table[:, BLOCK:])):
            if np.isfinite(piece).any() and (last is None or block + step <= last):
                wide = np.full((len(piece), BLOCK), -np.inf)
                wide[:, :piece.shape[1]] = piece
                out.setdefault((state, block + step), []).append((low, wide))
    return {key: total(parts) for key, parts in out.items()}
