"""The pipeline, stage by stage, against plain versions on a small table."""

import hashlib

import corpus_pipeline as pipeline
import numpy as np

from tests.conftest import SF_SMALL
from tests.llm import cases
from tests.llm.test_corpus import brute_classes, brute_lines
from tests.llm.test_texts import brute_contamination
from vigil.llm import bpe, near_dup
from vigil.llm.common import read_table, written


def test_stages_in_order(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    columns = docs.columns
    seen = []
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, SF_SMALL), "test-stage")
        seen.append(name)
        if name != "tokenize":
            assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        rows = [(d, r.text) for d, r in before.items()]
        if name == "language":
            assert len(after) >= 0.99 * sum(any(c.isalpha() for c in t or "") for _, t in rows)
        elif name == "lines":
            plain = brute_lines(rows, 3, 5)
            assert {d: r.text for d, r in after.items()} == {
                d: "\n".join(v) for d, v in plain.items() if v}
        elif name == "near_duplicates":
            assert set(after) == set(brute_classes(rows, near_dup.word_idf(docs)).values())
        elif name == "decontaminate":
            assert set(after) == {r[0] for r in brute_contamination(rows, items) if not r[5]}
        else:
            for d, t in rows:
                ids = np.frombuffer(after[d]["ids"], "<u4").tolist()
                assert bpe.encoder().bpe.decode(ids) == t.encode()
                assert after[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        docs = out
    assert seen == ["language", "lines", "near_duplicates", "decontaminate", "tokenize"]


def test_run_equals_the_chained_stages(spark):
    got = pipeline.run(spark, SF_SMALL)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and 0 < got.count() < 200


def test_empty_table(spark):
    docs = cases.empty(spark)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), f"empty-{name}")
        assert docs.count() == 0
