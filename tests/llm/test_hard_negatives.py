import numpy as np
import pandas as pd
import pytest

from cladeflow.llm import hard_negatives as hn
from cladeflow.llm.queries import op12_hard_negatives


def brute(rows, anchor=50):
    """Every anchor against every row, with Python integers."""
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(use):
        if i % anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, _, w) in enumerate(use) if b != a]
        for s, p, _ in sorted(x for x in scored if use[x[2]][1] == label)[:5]:
            fit = [x for x in scored if use[x[2]][1] != label and -50 * s <= -100 * x[0] <= -95 * s]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(sorted(fit)[:3])]
    return sorted(out)


def given(seed, n=900, dims=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(10))
        rows.append((int(rng.integers(5000)), label, (centres[label] + spread * rng.normal(size=dims)).astype(np.float32).tolist()))
    same = rows[3][2]
    rows += [(50 * k, 3, same) for k in range(30)] + [(7 * k + 1, 4, same) for k in range(30)]              # a group of copies, with ties
    rows += [(50, None, same), (None, 3, same), (100, 3, None), (150, 3, [None] * dims), (200, 3, [float("nan")] * dims), (250, 4, [float("inf")] * dims)]
    return rows + [(300, 3, same[:5]), (350, 2, []), (50, 3, same), (-50, 3, same), (400, 5, [0.0] * dims)]


def table(folder, rows):
    (folder / "embeddings.parquet").mkdir()
    frame = pd.DataFrame(rows, columns=["vec_id", "label", "embedding"]).astype({"vec_id": "Int64", "label": "Int32"})
    frame.assign(row=1, id=2, vector="x", block=3, turn=4, score=5).to_parquet(folder / "embeddings.parquet" / "p.parquet")
    return str(folder)


@pytest.mark.parametrize("seed, spread", [(1, 0.4), (2, 3.0)])
def test_query_against_all_pairs(spark, tmp_path, seed, spread):
    rows = given(seed, spread=spread)
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, table(tmp_path, rows)).collect())
    assert got == brute(rows) and len(got) > 100


def test_blocks_and_codes_change_nothing(spark):
    rows = [r for r in given(5, 300) if r[0] is not None]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    own = hn.prepared(frame)
    want = sorted(map(tuple, hn.mine(own, "id % 10 = 0").collect()))
    assert want == sorted(map(tuple, hn.mine(own, "id % 10 = 0", block=37, codes=3).collect())) and want


def test_bounds_hold_and_cells_come_in_their_order():
    rng = np.random.default_rng(4)
    data = rng.integers(-300, 300, (500, 8)).astype(float)
    index = hn.Index(np.arange(500), np.arange(500), rng.integers(0, 3, 500), data, [data[:5, :4].copy(), data[5:11, 4:].copy()])
    query = rng.integers(-300, 300, 8).astype(float)
    seen = list(index.cells(query))
    assert [b for b, _ in seen] == sorted((b for b, _ in seen), reverse=True)
    assert sorted(c for _, c in seen) == sorted(set(index.cell.tolist()))
    for bound, cell in seen:
        assert index.scores(slice(index.starts[cell], index.starts[cell + 1]), query).max() <= bound


def test_search_stops_before_all_cells():
    rng = np.random.default_rng(6)
    centres = 4000 * rng.normal(size=(40, 8))
    data = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)))
    index = hn.Index(np.arange(4000), np.arange(4000), np.zeros(4000, int), data, [centres[:, :4].copy(), centres[:, 4:].copy()])
    looked = []
    score = index.scores
    index.scores = lambda some, query: looked.append(len(index.ids[some])) or score(some, query)
    at, best = hn.nearest_others(index, 0, data[0])
    assert best.tolist() == sorted((data[1:] @ data[0]).astype(int).tolist(), reverse=True)[:5] and sum(looked) < 3000


def test_large_components_are_exact():
    data = np.array([[2.0 ** 31, 1.0], [2.0 ** 31, 2.0], [3.0, 2.0 ** 32]])
    index = hn.Index(np.arange(3), np.arange(3), np.zeros(3, int), data, [data[:1, :1].copy(), data[:1, 1:].copy()])
    assert index.scores(slice(0, 3), np.array([2.0 ** 31, 1.0])).tolist()[:2] != [2 ** 62, 2 ** 62]
    assert sorted(index.scores(slice(0, 3), np.array([2.0 ** 31, 1.0])).tolist()) == [3 * 2 ** 31 + 2 ** 32, 2 ** 62 + 1, 2 ** 62 + 2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mine(hn.prepared(empty)).collect() == []
