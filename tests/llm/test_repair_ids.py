import uuid
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeflow.llm import repair_ids as rp
from cladeflow.llm.common import shared_folder
from cladeflow.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_like_the_library(text):
    for t in (text, f"Café {text}\x1c x y <|endoftext|> ΣΑΣİ {text}"):
        assert rp.encoder(PATH)(t).tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, rp.END]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aB1'st!\u0301é <|", max_size=30)), min_size=1, max_size=8))
def test_a_batch_is_encoded_like_its_texts(texts):
    texts = [*texts, None, "It's <|endoftext|>x y<|startoftext|> ''s 'S e\u0301 \u0301e \x1c\x85 a\u00a0b 12é3"]
    got = rp.encoder(PATH).batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, rp.END] for t in texts]


def test_the_library_gets_distinct_pieces_not_distinct_words():
    encode = rp.Encoder(PATH)
    text = " ".join(f"word{i}!" for i in range(2000))
    assert encode(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, rp.END]
    assert len(encode.known) < 20


def test_pieces_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(rp, "CACHE", 10)
    encode = rp.Encoder(PATH)
    for i in range(30):
        text = " ".join(chr(97 + i % 26) * n for n in range(1, 9))
        assert encode(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, rp.END]
    assert len(encode.known) < 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_any_stretch_is_decoded(ids, a, b):
    ids = np.array(ids, np.int64)
    rules, body = rp.compress(ids, least=2)
    assert rp.Grammar(rules).expand(body).tolist() == ids.tolist()
    stored = rp.stored(np.concatenate([np.tile(ids, 20), [1]]))
    want = np.concatenate([np.tile(ids, 20), [1]])
    a, b = sorted((a % len(want), b % (len(want) + 1)))
    assert rp.Block(**stored).ids(a, b).tolist() == want[a:b].tolist()


def test_repeats_are_compressed():
    ids = np.tile(np.arange(2, 60), 500)
    _, body = rp.compress(ids)
    assert len(body) < len(ids) / 20


def test_passes_go_on_until_no_pair_is_frequent():
    rules, body = rp.compress(np.full(65536, 7))
    assert len(rules) + len(body) <= 40 and rp.Grammar(rules).expand(body).tolist() == [7] * 65536
    ids = np.tile(np.arange(100, 200), 3000)
    rules, body = rp.compress(ids)
    keys, counts = np.unique((body[:-1] << 32) | body[1:], return_counts=True)
    assert counts.max(initial=0) < rp.LEAST and len(rules) + len(body) < 600
    assert rp.Grammar(rules).expand(body).tolist() == ids.tolist()


def test_files_give_every_document_in_order(spark):
    texts = ["", None, "so it goes", "so it goes " * 400, "x", "ÉCOLE d'été", "a" * 3000]
    rows = [(i, texts[i % len(texts)], 0) for i in range(60, 0, -1)] + [(7, "zzz", 0), (7, "zzz", 0), (None, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rp.write(df, PATH, path, block=500)
    at = 0
    got = {(r.doc_id, r.start): r for r in rp.read(spark, path).collect()}
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        row = got.pop((doc, at))
        assert row["ids"] == ids and row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert not got
    rp.write(df.limit(0), PATH, path + "e")
    assert rp.read(spark, path + "e").count() == 0
