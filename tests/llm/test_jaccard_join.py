import random

import numpy as np
import pytest

from cladeflow.llm import jaccard_join as jj
from cladeflow.llm.components import components

KIND = "doc_id long, text string, n int"


def brute(rows, gram=5):
    sets = []
    for _, text, *_ in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        sets.append({tuple(words[i:i + gram]) for i in range(max(1, len(words) - gram + 1))} if words else set())
    low = list(range(len(rows)))
    linked = [[j for j in range(len(rows)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(linked):
            best = min(low[j] for j in [i, *others])
            if best < low[i]:
                low[i], changed = best, True
    comp = {}
    for i, (doc, *_) in enumerate(rows):
        comp.setdefault(low[i], []).append(doc)
    name = {c: min((d for d in docs if d is not None), default=None) for c, docs in comp.items()}
    return sorted(((doc, len(sets[i]), name[low[i]] if sets[i] else doc) for i, (doc, *_) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(11), []
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [draw.choice(vocabulary) for _ in range(12)]
    for base in range(12):
        text = [draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 30, 60, 90]))]
        for _ in range(draw.choice([1, 2, 9, 14])):
            if draw.random() < 0.6 and len(text) > 8:      # copies drift, so that chains form
                at = draw.randrange(len(text))
                text = [*text[:at], draw.choice(vocabulary), *text[at + draw.choice([0, 1, 1, 3]):]]
            out.append(" ".join([*text, *shared] if base % 3 == 0 else text))
    out += ["", None, "a", "A", "one two\tthree", "x y z u v", "X Y z u v", "\x1ca"]
    draw.shuffle(out)
    made = [(i, t, 0) for i, t in enumerate(out)]
    return made + [made[3], (5, made[9][1], 0), (None, made[4][1], 0), (None, "nameless text", 0)]


@pytest.mark.parametrize("frequent,rounds", [(16, 2), (2, 1), (10**6, 0), (2, 0)])
def test_components_match_brute_force_with_and_without_leaders(spark, rows, monkeypatch, frequent, rounds):
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    got = jj.link(spark.createDataFrame(rows, KIND), rounds=rounds).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_overlaps_derived_from_a_leader_are_exact(spark):
    draw = np.random.default_rng(3)
    x, z = (np.unique(draw.integers(0, 60, 50).astype(np.uint64)) for _ in range(2))
    followers = [np.unique(np.concatenate([x[draw.random(len(x)) < 0.9], draw.integers(50, 70, 4).astype(np.uint64)])) for _ in range(30)]
    stored = spark.createDataFrame([(0, x.tobytes()), (1, z.tobytes()), *((i + 2, y.tobytes()) for i, y in enumerate(followers))], "cls long, data binary")
    leaders = spark.createDataFrame([(i + 2, 0, np.setdiff1d(x, y).tobytes(), np.setdiff1d(y, x).tobytes()) for i, y in enumerate(followers)],
                                    "y long, x long, gone binary, new binary")
    pairs = spark.createDataFrame([(i + 2, 1) for i in range(30)], "y long, z long")
    for percent in (20, 35, 50):
        want = {i + 2 for i, y in enumerate(followers) if 100 * len(np.intersect1d(y, z)) >= percent * len(np.union1d(y, z))}
        assert {r.y for r in jj.derived(pairs, stored, leaders, percent).collect()} == want


def test_indexed_tokens_meet_for_every_link():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(draw.integers(0, 2**60, draw.integers(1, 40)).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.9], draw.integers(0, 2**60, 2).astype(np.uint64)]))
        late = np.sort(draw.choice(a, len(a) // 2, replace=False))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jj.indexed(a, late), jj.indexed(b, late)))


def test_parity_maps_never_hide_an_overlap():
    draw = np.random.default_rng(6)
    for size in (3, 50, 400, 3000):
        a = np.unique(draw.integers(0, 2**60, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.8], draw.integers(0, 2**60, size // 5).astype(np.uint64)]))
        apart = int(np.bitwise_count(jj.parity(a).view(np.uint64) ^ jj.parity(b).view(np.uint64)).sum())
        assert (len(a) + len(b) - apart) / 2 >= len(np.intersect1d(a, b))


def test_kept_documents_and_an_empty_table(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None][:60], KIND)
    kept = jj.kept_documents(df)
    want = {d for d, _, c in brute(df.collect()) if d == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == df.columns
    assert jj.link(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(3, 3), (1, 2), (2, 1)]
    draw.shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(20, 60)]}, 1: 1, 2: 1}


def test_kept_documents_keep_a_column_called_like_the_id(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 7, "a"), (2, text, 8, "b"), (3, None, 9, "c")], "doc_id long, text string, _id long, _ID_ string")
    kept = jj.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, text, 7, "a"), (3, None, 9, "c")]
