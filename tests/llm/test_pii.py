import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PART = st.sampled_from(["a", "@", ".", "b-c", "é", " ", "+1", "(", ")", "12", "255", "256", "007", "4041894974608795", "4041-8949 7460 8795", "-", "a.b@c.de", "1.2.3.4", "%", "_"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_fixed_spans_match_the_plain_patterns(text):
    assert [(k, a, b) for k, a, b, ok in pii.matches(text) if ok] == brute(text)


def test_long_runs_take_little_time():
    for text in ("a" * 300_000, "@" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "0:" * 150_000):
        pii.candidates(text[:200_000])


def test_reliabilities_find_the_labelers_that_are_right():
    draw = np.random.default_rng(1)
    truth = draw.random(4000) < 0.4
    votes = np.stack([np.where(draw.random(4000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.6, 0.85)], 1)
    votes[draw.random(votes.shape) < 0.2] = 2
    found, tables = pii.reliabilities(np.zeros(4000, int), votes, np.ones(4000))
    assert ((found > 0.5) == truth).mean() > 0.93
    right = [tables[0, i, 1, 1] / (tables[0, i, 1, 1] + tables[0, i, 1, 0]) for i in range(4)]
    assert right[0] > right[2] and right[1] > right[2] and abs(right[2] - 0.6) < 0.08


def test_added_spans_touch_no_fixed_one_and_edge_rows(spark):
    good = "call +1 (269) 555-3296 or mail me.12@mail.com from 10.2.3.4 with 4041894974608795."
    joined = "é +1 (269) 555-3296 4041894974608795 end"
    rows = [(i, good, 0) for i in range(40)] + [(100, joined, 0), (101, None, 0), (101, "", 0), (None, good, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = pii.find(df, pii.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [tuple(s) for s in by[3].base] == brute(good) and not by[3].added
    assert [tuple(s) for s in by[100].added] == [("card", 20, 36), ("phone", 2, 19)] and not by[100].base
    assert not by[101].base and not by[101].added
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0
