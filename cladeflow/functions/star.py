"""Global alignment of a member to its family's centre, for star alignments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from cladeflow.params import Scoring

COUNTED = re.compile("(.)([0-9]+);", re.S)        # a letter and its count in a column
ROWS_HELD, PROFILES_HELD = 1024, 32               # what a task remembers


def align_to_centre(member: str, centre: str, scores: Scoring) -> tuple[str, list[str]]:
    """Residue (or gap) under every centre position, and what is inserted before each and at the end.

    Ties prefer a diagonal step, then a gap in the centre, then a gap in the member.
    """
    m = np.frombuffer(member.encode("utf-32-le"), dtype=np.int32)
    c = np.frombuffer(centre.encode("utf-32-le"), dtype=np.int32)
    ramp = np.arange(len(c) + 1) * -scores.gap
    row = -ramp.astype(np.int64)
    step = np.full((len(m) + 1, len(c) + 1), 2, dtype=np.uint8)       # 0 diagonal, 1 insert, 2 delete
    for i in range(1, len(m) + 1):
        diagonal = row[:-1] + np.where(c == m[i - 1], scores.match, scores.mismatch)
        insert = row + scores.gap
        new = insert.copy()
        np.maximum(new[1:], diagonal, out=new[1:])
        step[i, 1:] = np.where(diagonal >= insert[1:], 0, 1)
        step[i, 0] = 1
        best = np.maximum.accumulate(new + ramp) - ramp
        step[i][best > new] = 2
        row = best
    under, before = ["-"] * len(c), [""] * (len(c) + 1)
    i, j = len(m), len(c)
    while i or j:
        if step[i, j] == 0:
            i, j = i - 1, j - 1
            under[j] = member[i]
        elif step[i, j] == 1:
            i -= 1
            before[j] = member[i] + before[j]
        else:
            j -= 1
    return "".join(under), before


def star_rows(scores: Scoring):
    """Arrow-batched map over ``(family, strain, seq, centre)`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [align_to_centre(s, c, scores) for s, c in zip(pdf["seq"], pdf["centre"])]
            yield pd.DataFrame({"family": pdf["family"], "strain": pdf["strain"], "under": [d[0] for d in done],
                                "before": [d[1] for d in done]})

    return run


def align_to_profile(member: str, profile: list[dict[str, int]], scores: Scoring) -> tuple[str, list[str]]:
    """Residue (or gap) under every column of a profile, and what is inserted before each and at the end.

    A column counts the letters of the other rows.  The score is that of the member's pairs with all of them; a gap over a gap
    is free, and an insertion meets a gap in every row.  Ties as in ``align_to_centre``.
    """
    counts = {x: np.array([column.get(x, 0) for column in profile], dtype=np.int64) for x in {"-", *member}}
    rows = np.array([sum(column.values()) for column in profile], dtype=np.int64)
    return align_to_counts(member, counts, rows, scores)


def align_to_counts(member: str, of: dict[str, np.ndarray], rows: np.ndarray, scores: Scoring) -> tuple[str, list[str]]:
    """``align_to_profile`` with the columns' counts by letter, '-' among them, and the rows they are of."""
    wide, others, gaps = len(rows), int(rows.max(initial=0)), of["-"]
    letters = rows - gaps
    skipped = np.concatenate([[0], np.cumsum(letters * scores.gap)])
    row = skipped.copy()
    step = np.full((len(member) + 1, wide + 1), 2, dtype=np.uint8)       # 0 diagonal, 1 insert, 2 skip
    for i, x in enumerate(member, 1):
        diagonal = row[:-1] + of[x] * scores.match + (letters - of[x]) * scores.mismatch + gaps * scores.gap
        insert = row + scores.gap * others
        new = insert.copy()
        np.maximum(new[1:], diagonal, out=new[1:])
        step[i, 1:] = np.where(diagonal >= insert[1:], 0, 1)
        step[i, 0] = 1
        best = np.maximum.accumulate(new - skipped) + skipped
        step[i][best > new] = 2
        row = best
    under, before = ["-"] * wide, [""] * (wide + 1)
    i, j = len(member), wide
    while i or j:
        if step[i, j] == 0:
            i, j = i - 1, j - 1
            under[j] = member[i]
        elif step[i, j] == 1:
            i -= 1
            before[j] = member[i] + before[j]
        else:
            j -= 1
    return "".join(under), before


def counted_letters(profile: list[str]) -> dict[str, np.ndarray]:
    """Counts by letter of the columns of a profile, each a text of ``letter count ;``."""
    counts = {"-": np.zeros(len(profile), dtype=np.int64)}
    for place, column in enumerate(profile):
        for x, n in COUNTED.findall(column):
            counts.setdefault(x, np.zeros(len(profile), dtype=np.int64))[place] = int(n)
    return counts


def profile_rows(scores: Scoring):
    """Arrow-batched map over ``(family, strain, aligned, profile, anew)`` rows; rows not marked stay as they are.

    A task reads the profile of a family once and aligns equal rows once, as long as it remembers them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, found = {}, {}
        for pdf in batches:
            done = []
            for family, aligned, profile, anew in zip(pdf["family"], pdf["aligned"], pdf["profile"], pdf["anew"]):
                if not anew:
                    done.append((aligned, [""] * (len(aligned) + 1)))
                    continue
                if (family, aligned) not in found:
                    if len(found) >= ROWS_HELD:
                        found.clear()
                    if family not in profiles:
                        if len(profiles) >= PROFILES_HELD:
                            profiles.clear()
                        counts = counted_letters(profile)
                        profiles[family] = counts, sum(counts.values()) - 1
                    counts, others = profiles[family]
                    own = np.frombuffer(aligned.encode("utf-32-le"), dtype=np.int32)
                    rest = {x: counts[x] - (own == ord(x)) for x in {"-", *aligned}}
                    found[family, aligned] = align_to_counts(aligned.replace("-", ""), rest, others, scores)
                done.append(found[family, aligned])
            yield pd.DataFrame({"family": pdf["family"], "strain": pdf["strain"], "under": [d[0] for d in done], "before": [d[1] for d in done]})

    return run
