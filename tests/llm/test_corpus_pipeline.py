import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cladeflow.llm import quality
from cladeflow.llm.common import table
from cladeflow.llm.queries import vocabulary
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard_join import brute as components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what every stage returns, each on what its predecessor kept."""
    from cladeflow.llm.common import written

    out = [table(spark, DATA, "documents")]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA)))
    return out


def test_columns_and_the_last_stage(spark, stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in stages[-2].collect()}
    assert {r.doc_id: r.ids for r in stages[-1].collect()} == want
    got = pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.ids for r in got} == want


def test_quality_and_copies_match_brute_force(spark, stages):
    scores = {r.doc_id: r.score for r in quality.score(stages[0], quality.fit(stages[0], table(spark, DATA, "labels"))).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {d for d, s in scores.items() if s >= 0.5}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in stages[1].collect():
        last[(r.text or "").translate(lower)] = max(r.doc_id, last.get((r.text or "").translate(lower), -1))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(last.values())


def test_near_copies_and_benchmark_passages_match_brute_force(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {d for d, _, c in components(rows) if d == c}
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    before = {r.doc_id: r.text for r in stages[3].collect()}
    clean = {d for d, _, n, _ in hits([(d, t) for d, t in before.items()], items) if n == 0}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(after[d] == before[d] for d in clean) and len(clean) < len(before)
    assert all(n == 0 for _, _, n, _ in hits(list(after.items()), items))
