import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow.llm import substring_dedup as sd
from cladeflow.llm.queries import op13_substring_dedup

KIND = "doc_id long, text string"


def brute(rows, window=50):
    """doc_id, words, kept words of every row, by a table of all windows."""
    key = lambda d: (d is None, d or 0)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            own = tuple(words[i:i + window])
            first[own] = min(first.get(own, key(d)), key(d))
    out = []
    for d, words in split:
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i:i + window])] < key(d) for j in range(i, i + window)}
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: str(rng.randrange(4000))
    passages = [[word() for _ in range(rng.randrange(40, 140))] for _ in range(6)] + [["x"] * 180, ["a", "b"] * 60]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(60))] + rng.choice(passages)
        rows.append((i * 3 % n, " ".join(words)))
    return rows + [rows[5], (rows[7][0], rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (None, None), (n, None), (n + 1, ""), (n + 2, "\t\n"),
                   (-4, "É " * 60), (n + 3, "É " * 80), (n + 4, " ".join(rows[1][1].split() * 9))]


def cleaned(spark, rows, **how):
    return sorted((tuple(r) for r in sd.clean(spark.createDataFrame(rows, KIND), **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"limit": 5}, {"bits": 1}, {"window": 12, "gram": 4, "limit": 3}, {"window": 7, "gram": 7}, {"window": 3, "gram": 1}])
def test_same_as_a_table_of_all_windows(spark, how):
    rows = made(len(how) + how.get("limit", 0))
    assert cleaned(spark, rows, **how) == brute(rows, how.get("window", 50))


def test_super_kmers_hold_every_window_once_and_equal_windows_meet():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 49, 50, 400, 0, 3, 200, 400])
    words = rng.integers(0, 1 << 60, sizes.sum()).astype(np.uint64)
    words[-400:] = words[99:499]
    words[520:560] = 7
    value, doc, start, count = sd.super_kmers(words, sizes)
    seen = sorted(i for s, c in zip(start.tolist(), count.tolist(), strict=True) for i in range(s, s + c))
    ends = np.cumsum(sizes)
    assert seen == [i for e, n in zip(ends, sizes, strict=True) for i in range(e - n, e - 49)]
    assert max(count) <= 41 and len(value) == len(doc)
    met = {i: v for v, s, c in zip(value.tolist(), start.tolist(), count.tolist(), strict=True) for i in range(s, s + c)}
    again = int(ends[-1]) - 400
    assert all(met[99 + i] == met[again + i] for i in range(351))
    assert len(value) < len(seen) / 10


def test_one_passage_in_every_document_is_dealt_over_parts(spark):
    rng = random.Random(2)
    passage = [str(rng.randrange(10 ** 6)) for _ in range(70)]
    rows = [(i, " ".join([str(rng.randrange(10 ** 6)) for _ in range(30)] + passage + [str(i)] * 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, KIND)
    keyed = sd._keyed(docs)
    repeated = sd.counted(keyed, 50, 10)
    assert repeated.agg(F.max("many")).first()[0] >= 300
    assert cleaned(spark, rows, limit=20) == brute(rows)


def test_query_against_brute_force(spark, tmp_path):
    rows = made(9)
    (tmp_path / "documents.parquet").mkdir()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    frame.assign(doc=1, row="clash", spans=2, mz=3, part=4, kept="no").to_parquet(tmp_path / "documents.parquet" / "p.parquet")
    got = sorted((tuple(r) for r in op13_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows)), key=str)


def test_empty_table(spark):
    assert sd.clean(spark.createDataFrame([], KIND)).collect() == []
