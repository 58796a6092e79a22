"""Every stage against a brute-force version on its own input."""
from collections import Counter

import corpus_pipeline
from tests.llm import test_bpe, test_mixing, test_near_dup, test_quality_rules, test_suffix_dedup

from postresp.llm.common import stored, table
from postresp.llm.mixing import Mix
from postresp.llm.quality_rules import Rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    steps = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.dtypes
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.dtypes == columns
        steps.append(docs.collect())
    raw, good, single, cut, mixed = steps
    triples = [(r.doc_id, r.text, r.source) for r in raw]
    kept = sorted((r[0], r[-1]) for r in test_quality_rules.brute(triples, Rules()) if r[-2])
    assert sorted((r.doc_id, r.text) for r in good) == kept and len(kept) < len(raw)
    rows = [(r.doc_id, r.text) for r in good]
    assert sorted(r.doc_id for r in single) == sorted(r[0] for r in test_near_dup.brute(rows) if r[0] == r[2])
    rows = [(r.doc_id, r.text) for r in single]
    sizes = {r[0]: r[1] - r[2] for r in test_suffix_dedup.brute(rows)}
    # bytes of characters that a cut leaves incomplete go too
    assert {r.doc_id for r in cut} == set(sizes) and all(0 <= sizes[r.doc_id] - len(r.text.encode()) <= 6 * 20 for r in cut)
    words, taken = Counter(), Counter()
    for r in cut:
        words[r.source] += test_mixing.size(r.text)
    for r in mixed:
        taken[r.source] += test_mixing.size(r.text)
    order = sorted(words)
    for s, t in zip(order, test_mixing.targets([words[s] for s in order], Mix())):
        assert abs(taken[s] - t) <= max(2 * Mix().block, 0.05 * t)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    for r in mixed:
        ids, text = test_bpe.expected(r.text)
        assert last[r.doc_id].ids == ids and last[r.doc_id].decoded_sha256 == test_bpe.sha(text)


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda rs: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rs)
    assert key(rows) == key(again) and rows and len({r.doc_id for r in rows}) == len(rows)


def test_odd_rows(spark):
    data = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x " * 80, None, "s", 3), (3, "a b c " * 200, "en", "s", 5),
            (4, " ".join(f"w{i}" for i in range(90)), "en", "s", 5), (4, " ".join(f"w{i}" for i in range(90)), "en", "s", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        assert empty.count() == 0
    assert [r.doc_id for r in docs.collect()] == [4]
