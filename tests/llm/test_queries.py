import os

import duckdb
import pytest

import __spark_entry__ as entry
from cladeflow.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in order]
    assert sorted(names) == order
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_names_and_contracts(spark):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    want = {"op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
            "op8_repair_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
            "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
            "op10_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
            "op11_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
                                   "runs_sha256": "string", "collapsed_sha256": "string"},
            "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
            "op13_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
            "op2_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
            "op1_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}}
    for name, kinds in want.items():
        assert dict(QUERIES[name](spark, FOLDER).dtypes) == kinds


def test_digests_of_every_document(spark):
    import hashlib
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from cladeflow.llm.common import table
    from cladeflow.llm.queries import vocabulary
    from tests.llm.test_pii import brute

    docs = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op6_bpe"](spark, FOLDER).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    library, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for r in sorted(QUERIES["op8_repair_ids"](spark, FOLDER).collect()):
        ids = [*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for r in QUERIES["op10_pii"](spark, FOLDER).collect():
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))  | {""} and r.n_email == sum(k == "email" for k, _, _ in base)
