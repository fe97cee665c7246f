"""The pipeline against a brute-force version of its stages."""

import array
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as p
from claimlens.llm import language_id
from claimlens.llm import textblocks as tb
from tests.llm.conftest import DOC, ODD, SF, make
from tests.llm.test_byte_bpe import TRUE
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_components

SECRET = re.compile(r"(?i)(token = [^\w\s]*\")([0-9a-f]{40})(\")")


def brute(spark, docs, items):
    """(doc_id, ids) of what stays, by comparing everything with everything."""
    model = language_id.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep = []
    for b in tb.blocks(pa.array([t for _, t in rows], pa.string())):
        i, s = language_id.score_block(model, b)
        keep += ((i >= 0) & (s >= model.threshold)).tolist()
    rows = [r for r, k in zip(rows, keep) if k]
    first = {d for d, _, c in brute_components(rows) if d == c}
    rows = [r for r in rows if r[0] in first]
    dirty = {d for d, _, _, found in brute_hits(rows, items) if found}
    rows = [(d, SECRET.sub(r"\1<SECRET>\3", t)) for d, t in rows if d not in dirty]
    return {d: array.array("I", TRUE.encode_ordinary(t)).tobytes() for d, t in rows}


def test_stages_and_columns(spark, docs):
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "tokens"]
    now = docs
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.schema.names == docs.schema.names
    odd = make(spark, [(d, t, None, None, None) for d, t in ODD], DOC)
    for _, stage in p.STAGES[1:4]:  # nulls, empty and long texts, repeated rows
        odd = stage(spark, odd, SF)
    assert {r.doc_id for r in odd.collect()} >= {1, 2, 3, 5, None}


def test_run_equals_brute_force(spark, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(spark, docs, items)
    got = p.run(spark, SF).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id: bytes(r.ids) for r in got} == want
    assert 0 < len(want) < docs.count() and np.sum([len(x) for x in want.values()]) > 0
