import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cladeflow.llm import quality
from cladeflow.llm.common import table
from cladeflow.llm.queries import op9_quality

DATA = "/root/testdata/sf0.01"


def test_ftrl_reaches_the_optimum_of_a_separable_problem():
    draw = random.Random(1)
    make = lambda good: " ".join(draw.choice(["we", "went", "home"] if good else ["BUY!!", "NOW!!", "went"]) for _ in range(20)).encode()
    rows = [(*quality.features(make(i % 2)), i % 2) for i in range(200)]
    weights = quality.train(rows)
    assert all((quality.dot(s, v, weights) > 0) == bool(y) for s, v, y in rows)
    assert (quality.train(rows) == weights).all()


def test_held_out_rows_are_classified_and_never_learnt_from(spark):
    got = {r.doc_id: r for r in op9_quality(spark, DATA).collect()}
    truth = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(r.score, truth[d]) for d, r in got.items() if r.held_out and d in truth]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.93
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    labels = table(spark, DATA, "labels")
    docs = table(spark, DATA, "documents")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, labels) == quality.fit(docs, turned)).all()


def test_no_labels_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (1, "", 3.0), (None, "word " * 9, 3.0)], "doc_id long, text string, other double")
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels))
    assert [r.score for r in got.collect()] == [0.5, 0.5, 0.5] and got.columns == ["doc_id", "text", "other", "score"]
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def plain_ftrl(rows, epochs, seed=7):
    """FTRL-proximal coordinate by coordinate, with dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(abs(zi) - quality.L1) * (1 if zi > 0 else -1) / ((quality.BETA + ni ** 0.5) / quality.ALPHA + quality.L2)

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            slots, values, label = rows[k]
            x = [*zip(slots.tolist(), values.tolist()), (quality.BIAS, 0.3)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g, before = (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before ** 0.5) / quality.ALPHA * w[i]
                n[i] = before + g * g
    return weight


def test_training_and_scores_are_those_of_a_plain_reference():
    rng = random.Random(5)
    rows = [(*quality.features(" ".join(rng.choice("abcdefgh") + str(label) * (i % 3) for _ in range(20)).encode()), label) for i in range(60) for label in (0, 1)]
    weights, plain = quality.train(rows, 2), plain_ftrl(rows, 2)
    for slots, values, _ in rows[:20]:
        assert all(abs(weights[i] - plain(i)) < 1e-9 for i in slots.tolist())
        own = sum(plain(i) * v for i, v in zip(slots.tolist(), values.tolist(), strict=True)) + 0.3 * plain(quality.BIAS)
        assert abs(quality.dot(slots, values, weights) - own) < 1e-9


def test_accepted_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1, 0.2, "x"), (2, None, 0.3, 0.4, "y")], "doc_id long, text string, score double, _score double, Score_ string")
    weights = np.zeros(quality.DIMENSIONS + 1, np.float32)
    kept = quality.accepted(docs, weights)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_one_id_with_many_texts_is_learnt_from_within_the_bound(spark):
    docs = spark.createDataFrame([(1, f"word{i} good") for i in range(50)] + [(1, "same")] * 50 + [(3, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert np.isfinite(quality.fit(docs, labels, sample=4)).all()
