import zlib

import numpy as np
import pyarrow as pa
import pytest

from cladeflow.llm import masked_lm as lm
from cladeflow.llm.common import table
from cladeflow.llm.queries import op5_masked_lm

DATA = "/root/testdata/sf0.001"


def test_probabilities_of_all_tokens_sum_to_one():
    w = {k: v.astype(np.float64) * 5 for k, v in lm.drawn(1).items()}
    around = np.array([[1, lm.EDGE, 5, 900]])
    every = np.concatenate([lm.log_probabilities(w, np.array([t]), around) for t in range(lm.TOKENS)])
    assert abs(np.exp(every).sum() - 1) < 1e-9


@pytest.mark.parametrize("name", list(lm.drawn()))
def test_gradients_match_finite_differences(name):
    w = {k: v.astype(np.float64) * 3 for k, v in lm.drawn(2).items()}
    draw = np.random.default_rng(3)
    own = draw.integers(0, lm.TOKENS, 40)
    around = lm.windows(own)
    got = lm.gradients(w, own, around)[name]
    if name == "words":
        full = np.zeros_like(w["words"])
        np.add.at(full, around.ravel(), got)
        got = full
    flat, loss = w[name].reshape(-1), lambda: -lm.log_probabilities(w, own, around).mean()
    for i in [int(np.abs(got).argmax()), *draw.integers(0, flat.size, 5)]:
        old = flat[i]
        flat[i] = old + 1e-5
        high = loss()
        flat[i] = old - 1e-5
        low = loss()
        flat[i] = old
        assert abs((high - low) / 2e-5 - got.reshape(-1)[i]) < 1e-5


def test_trained_scores_beat_untrained_ones_and_order_counts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words = lm.vocabulary(docs)
    weights = lm.train(docs, words)
    rows = docs.where("n_chars between 2000 and 4000 and lang = 'en'").limit(40).collect()
    draw, known = np.random.default_rng(1), lm.Known(words)
    mean = lambda own, w: lm.log_probabilities(w, own, lm.windows(own)).mean()
    texts = [lm.tokens(r.text.encode(), known) for r in rows]
    assert np.mean([mean(t, weights) for t in texts]) > np.mean([mean(t, lm.drawn()) for t in texts]) + 1
    counts = np.bincount(np.concatenate(texts), minlength=lm.TOKENS)
    other = [draw.permutation(np.repeat(np.arange(lm.TOKENS), counts))[:len(t)] for t in texts]
    assert np.mean([mean(t, weights) for t in texts]) > np.mean([mean(t, weights) for t in other])


def test_sums_match_a_score_position_by_position(spark, monkeypatch):
    docs = table(spark, DATA, "documents")
    words, w = lm.vocabulary(docs), lm.drawn(4)
    got = {r.doc_id: r for r in lm.score(docs, words, w).collect()}
    for r in docs.collect()[:25]:
        own = lm.tokens((r.text or "").encode(), lm.Known(words))
        want = sum(float(lm.log_probabilities(w, own[i:i + 1], lm.windows(own)[i:i + 1])[0]) for i in range(len(own)))
        assert got[r.doc_id].n_tokens == len(own) and abs(got[r.doc_id].log_likelihood - want) < 1e-3 * max(1, len(own) ** 0.5)


def test_word_counts_cover_the_corpus(spark):
    docs = table(spark, DATA, "documents")
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert abs(lm.word_counts(docs).agg({"many": "sum"}).first()[0] - total) < total * 1e-3


def test_averages_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = spark.createDataFrame([(i, i + 1, np.full(3, i, np.float32).tobytes()) for i in range(7)], "task int, many long, weights binary")
    want = sum(i * (i + 1) for i in range(7)) / sum(i + 1 for i in range(7))
    assert np.allclose(np.frombuffer(lm.averaged(rows, b""), np.float32), want)
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (2, "one", 1), (None, "one two", 1)], "doc_id long, text string, n_tokens int")
    words = lm.vocabulary(docs)
    got = lm.score(docs, words, lm.train(docs, words)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 2] and all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)
    none = docs.limit(0)
    assert lm.score(none, lm.vocabulary(none), lm.train(none, {})).count() == 0
    assert op5_masked_lm(spark, DATA).columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]


def test_every_position_is_trained_on_once(spark, monkeypatch):
    trained, averaged = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda rows, default: trained.append(rows.agg({"many": "sum"}).first()[0]) or averaged(rows, default))
    docs = table(spark, DATA, "documents")
    lm.train(docs, {})
    assert sum(trained) == sum(len((r.text or "").encode().split()) for r in docs.collect())


@pytest.mark.parametrize("listed", [0, 2000, 1 << 16])
def test_words_of_a_shared_token_have_their_counted_share(spark, monkeypatch, listed):
    monkeypatch.setattr(lm, "LISTED", listed)
    docs = table(spark, DATA, "documents")
    counts, w = lm.word_counts(docs), lm.drawn(4)
    words, many = lm.vocabulary(docs), {bytes(r.word): r.many for r in counts.collect()}
    total = np.zeros(lm.SHARED)
    for word, n in many.items():
        if word not in words:
            total[zlib.crc32(word) % lm.SHARED] += n
    plain, got = ({r.doc_id: r for r in x.collect()} for x in (lm.score(docs, words, w), lm.score_words(docs, words, w, counts)))
    assert len(got) == len(plain) == docs.count()
    for r in docs.collect():
        rare = [x for x in (r.text or "").encode().translate(lm.LOWERED).split() if x not in words]
        want = plain[r.doc_id].log_likelihood + sum(np.log(many[x] / total[zlib.crc32(x) % lm.SHARED]) for x in rare)
        assert abs(got[r.doc_id].log_likelihood - want) < 1e-6 * max(1, abs(want)) and got[r.doc_id].n_tokens == plain[r.doc_id].n_tokens


def test_query_tells_a_frequent_word_from_a_rare_one_of_its_token(spark, tmp_path):
    mine = {}
    for i in range(3000):
        mine.setdefault(zlib.crc32(b"w%d" % i) % lm.SHARED, []).append(f"w{i}")
    often, seldom = max(mine.values(), key=len)[:2]
    filler = [" ".join(f"f{i}" for i in range(lm.TOKENS)) for _ in range(9)]
    rows = [(1, often), (2, seldom)] + [(3 + i, x) for i, x in enumerate([often] * 4 + filler)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_likelihood for r in op5_masked_lm(spark, str(tmp_path)).collect()}
    assert abs(got[1] - got[2] - np.log(5)) < 1e-6


def test_every_text_is_split_into_tokens_once(spark, monkeypatch):
    split, coded = [], lm.coded
    monkeypatch.setattr(lm, "coded", lambda docs, *a: split.append(docs.count()) or coded(docs, *a))
    docs = table(spark, DATA, "documents")
    assert op5_masked_lm(spark, DATA).count() == docs.count() and split == [docs.count()]


def test_tokens_are_kept_as_they_are(spark):
    docs = spark.createDataFrame([(1, "One two  one"), (2, None), (3, " ".join(f"w{i}" for i in range(300)))], "doc_id long, text string")
    words = lm.vocabulary(docs.where("doc_id = 1"))
    for r in docs.join(lm.coded(docs, words), "doc_id").collect():
        assert lm.numbers(r.tokens).tolist() == lm.tokens((r.text or "").encode(), lm.Known(words)).tolist()


def test_a_batch_is_split_like_its_texts():
    texts = [None, "", " a\x1cB  a\n", "É x\x0bA", " ", "Ünd z a"]
    ends, codes, words = lm.split(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    want = [(t or "").encode().translate(lm.LOWERED).split() for t in texts]
    assert [[words[c] for c in x] for x in np.split(codes, ends[:-1])] == want
