import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from cladeflow.llm.periodic_runs import LEAST, TIMES, classes, extended, find, seeds
from cladeflow.llm.queries import op11_periodic_runs

KIND = "doc_id long, text string"


def brute(x, least=LEAST, times=TIMES):
    """Every maximal stretch of every period, kept if no smaller period fits it."""
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, times * q) and not any(all(x[t] == x[t + d] for t in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out)


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (9, 3), (12, 4)])
def test_runs_are_those_of_a_plain_search(least, times):
    rng = random.Random(times + least)
    for _ in range(700):
        n, k = rng.randrange(70), rng.choice([1, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
        own = np.array(x, np.int64)
        assert extended(own, *seeds(own, n, least, times), least, times) == brute(x, least, times)


def test_grams_cover_the_guaranteed_overlap_and_the_lags_of_their_class():
    assert classes(200)[:4] == [(0, 1, 5), (1, 2, 6), (2, 4, 9), (4, 8, 15)]
    assert all(high <= gram <= max(LEAST - q, (TIMES - 1) * q) for low, high, gram in classes(10000) for q in range(low + 1, high + 1))


def test_equal_words_make_no_more_seeds_than_words():
    own = np.zeros(50000, np.int64)
    at, lag = seeds(own, len(own))
    assert len(at) <= len(own) and set(lag.tolist()) == {1}
    assert extended(own, at, lag) == [(0, 50000, 1)]


def changed(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = changed(doc_id, (text or "").encode().split())
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_a_plain_search(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(rng.choice([2, 9, 500]))) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(None, "x y " * 30), (None, None), (400, None), (401, ""), (402, " \t\n\x0b "), (17, rows[17][1]), (17, "z " * 9),
             (403, "é a é a é a é a\x0bé a é a"), (404, "a b " * 4000 + "c")]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    (tmp_path / "documents.parquet").mkdir()
    frame.assign(runs="other", best=1, _w="clash", h=3, g=4, a=5, p=6).to_parquet(tmp_path / "documents.parquet" / "part.parquet")
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(expected(i, t) for i, t in rows)


def test_batches_by_words_change_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c " * i + "d") for i in range(60)], KIND)
    assert sorted(map(str, find(docs, words=1).collect())) == sorted(map(str, find(docs).collect()))


def test_empty_table(spark):
    assert find(spark.createDataFrame([], KIND)).collect() == []


def test_null_words_count_as_text(spark):
    row = find(spark.createDataFrame([(1, None)], KIND)).first()
    assert (row.n_words, row.runs, row.best, row.collapsed) == (0, [], None, "")
