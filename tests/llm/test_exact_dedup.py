import random

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import exact_dedup as dedup

KIND = "doc_id long, text string, kept int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(doc)
    return sorted((doc, max(x for x in groups[lowered(text)]), len(groups[lowered(text)])) for doc, text, *_ in rows)


@pytest.fixture()
def rows():
    draw = random.Random(2)
    texts = ["", None, "a", "A", "É", "é", "ab" * 70_000, "AB" * 70_000, "ab" * 69_999 + "ac", "b", "a\x00", "\x00a"]
    return [(i, draw.choice(texts), 0) for i in range(90)]


@pytest.mark.parametrize("huge", [1000, 70_001, dedup.HUGE])
def test_groups_match_brute_force_at_every_size_of_a_piece(spark, rows, huge):
    got = dedup.decisions(spark.createDataFrame(rows, KIND), huge=huge).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_pieces_combine_to_the_whole():
    data = random.Random(1).randbytes(5 * dedup.PIECE + 17)
    for cut in (0, 1, dedup.PIECE, 100_001, len(data)):
        for i, prime in enumerate(dedup.PRIMES):
            head, tail = dedup.fingerprint(data[:cut])[i], dedup.fingerprint(data[cut:])[i]
            assert (head * pow(dedup.BASES[i], len(data) - cut, prime) + tail) % prime == dedup.fingerprint(data)[i]
    assert dedup.fingerprint(b"\0") != dedup.fingerprint(b"")


def test_equal_fingerprints_of_unequal_texts_are_told_apart(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("abcdefgh") + draw.choice("abcdefgh"), 0) for i in range(200)]
    got = dedup.decisions(spark.createDataFrame(rows, KIND), primes=(3, 2)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(rows)


def test_repeated_rows_null_ids_and_the_kept_rows(spark):
    rows = [(1, "x", 7), (1, "x", 7), (1, "y", 7), (None, "z", 7), (None, "z", 7), (2, "Y", 8), (3, None, 9), (4, "", 9)]
    df = spark.createDataFrame(rows, KIND)
    got = dedup.decisions(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 4
    kept = dedup.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "x", 7), (2, "Y", 8), (4, "", 9), (None, "z", 7)], key=str)
    assert dedup.decisions(df.where(F.lit(False))).count() == 0


def test_kept_documents_keep_columns_of_any_name(spark):
    kind = "doc_id long, text string, _id long, _sha string, _own string, _row int, copies long, many long"
    docs = spark.createDataFrame([(1, "a", 5, "s", "o", 9, 3, 1), (2, "A", 6, "t", "p", 8, 2, 1), (3, "b", 7, "u", "q", 7, 1, 1), (3, "b", 7, "u", "q", 7, 1, 1)], kind)
    kept = dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "A", 6, "t", "p", 8, 2, 1), (3, "b", 7, "u", "q", 7, 1, 1)]


def test_batches_are_bounded_by_bytes(spark):
    from cladeflow.llm.common import mapped

    docs = spark.range(24).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = mapped(docs, lambda b: {"n": [b.num_rows] * b.num_rows}, "n int").collect()
    assert len(got) == 24 and max(r.n for r in got) <= 4
