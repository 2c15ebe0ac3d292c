import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeflow.llm import bpe
from cladeflow.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [i for block in bpe.codec(PATH).encode(text) for i in block]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_like_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False)
    assert ids(text) == want.ids
    assert bpe.codec(PATH).decode(ids(text)).decode("utf-8", "replace") == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    own, draw = bpe.Codec(PATH), random.Random(4)
    for _ in range(200):
        data = "".join(draw.choice("abeinth ") for _ in range(draw.randint(2, 48))).replace(" ", "é").encode()[:48]
        assert own.short(data) == own.long(data)
    word = "".join(draw.choice("thenigo") for _ in range(30_000))
    assert ids(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_special_strings_blocks_and_bad_bytes(monkeypatch):
    text = "a<|endoftext|> b  <|endoftext|>\n\n c's 1234 <|end"
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "BLOCK", 16)
    assert ids(text * 9) == LIBRARY.encode(text * 9, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode([198, 255]).decode("utf-8", "replace") == LIBRARY.decode([198, 255], skip_special_tokens=False)


def test_rows_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "so it goes 🙂", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect()}
    assert back == {(1, ""), (2, ""), (2, "so it goes 🙂"), (None, "x")}
    trip = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(rows, PATH).collect()}
    assert (1, 0, hashlib.sha256(b"").hexdigest()) in trip and len(trip) == 4
    assert bpe.round_trip(rows.limit(0), PATH).count() == 0
