import random

import numpy as np
import pytest

from cladeflow.llm import decontaminate as dec
from cladeflow.llm import fm_index


def test_suffix_order_search_and_locate_match_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        text = []
        for _ in range(draw.randint(1, 6)):
            text += [draw.randint(1, 3) for _ in range(draw.randint(1, 40))] * draw.randint(1, 2) + [0]
        text = np.array(text)
        keys = [tuple((0, i + k) if s == 0 else (1, s) for k, s in enumerate(text[i:])) for i in range(len(text))]
        assert fm_index.suffix_order(text).tolist() == sorted(range(len(text)), key=keys.__getitem__)
        index = fm_index.FMIndex(text, 5)
        phrases = np.array([[draw.randint(1, 4) for _ in range(4)] for _ in range(20)])
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(*index.search(phrases))}
        want = {w: at for w, p in enumerate(phrases) if (at := [i for i in range(len(text) - 3) if (text[i:i + 4] == p).all()])}
        assert got == want


def test_rank_counts_symbols():
    symbols = np.random.default_rng(1).integers(0, 11, 500)
    tree = fm_index.Wavelet(symbols, 11)
    c, at = np.random.default_rng(2).integers(0, 11, 300), np.random.default_rng(3).integers(0, 501, 300)
    assert tree.rank(c, at).tolist() == [int((symbols[:j] == i).sum()) for i, j in zip(c, at)]


def brute(docs, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: dec.WORD.findall((t or "").translate(lower))
    out = []
    for doc, text, *_ in docs:
        own, hit, found = split(text), set(), set()
        for name, item in items:
            w = split(item)
            for i in range(max(1, len(w) - 9)) if w else ():
                win = w[i:i + 10]
                for j in range(len(own) - len(win) + 1):
                    if own[j:j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        found |= {str(name)} if name is not None else set()
        out.append((doc, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(9)
    some = lambda n: " ".join(draw.choice(["ab", "Cd", "é", "x1", "Ü-b"]) for _ in range(n))
    items = [(i, some(draw.randint(9, 25))) for i in range(12)] + [(20, "q r, S"), (21, "..."), (22, None), (None, "lone words here"), (23, "q r s")]
    docs = [(i, " zz ".join(draw.choice([items[draw.randrange(12)][1], some(30), "q R s", "lone words here", items[2][1][:30]]).upper().replace("É", "é").replace("Ü", "ü")
                            if draw.random() < 0.5 else draw.choice(items)[1] or "" for _ in range(3)), 1) for i in range(60)]
    return docs + [(100, None, 1), (101, "", 1), (5, docs[5][1], 1), (None, "q r s", 1)], items


@pytest.mark.parametrize("most,shard", [(dec.BLOCK_BYTES, dec.SHARD_BYTES), (150, 500)])
def test_hits_match_brute_force_in_one_block_and_in_several(spark, made, most, shard):
    docs, items = made
    a, b = spark.createDataFrame(docs, "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string")
    got = dec.search(a, b, most=most, shard=shard).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got), key=str) == brute(docs, items)
    assert all(x.end < y.start for r in got for x, y in zip(r.spans, r.spans[1:]))


def test_cleaning_leaves_no_window_and_touches_nothing_else(spark, made):
    docs, items = made
    a, b = spark.createDataFrame(docs, "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string")
    kept = dec.clean(a, b).collect()
    rows = [tuple(r) for r in kept]
    assert dec.clean(a, b).columns == a.columns
    assert all(n == 0 for _, _, n, _ in brute(rows, items))
    untouched = [d for d, (_, _, n, _) in ((d, brute([d], items)[0]) for d in docs) if n == 0]
    assert all(d in rows for d in untouched)
    assert (None, "q r s", 1) not in rows and (100, None, 1) in rows


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dec.search(a, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in dec.search(one, b).collect()] == [(1, 2, [], [])]
    assert dec.clean(one, b).count() == 1
