"""Words that a plain polynomial hash confuses; rows that share an id; columns named like internal ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import decontamination, ngram_join, secret_scan
from claimlens.llm import textblocks as tb
from claimlens.llm.scratch import IdTable
from tests.llm.conftest import make


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096, 16384])
def test_thue_morse_words_differ(spark, n):
    x, y = thue_morse(n)
    docs = make(spark, [(1, x), (2, y), (3, f"{x} b c d e f"), (4, f"{y} b c d e f"), (5, x)])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    hits = {r["doc_id"]: r["items"] for r in decontamination.hits(docs, make(spark, [("i", x)], "item_id string, text string")).collect()}
    assert {d for d, i in hits.items() if i} == {1, 3, 5}


def test_equal_words_have_equal_hashes_and_others_differ():
    r = random.Random(4)
    texts = ["".join(r.choice("abé ") for _ in range(r.randrange(0, 60))) for _ in range(3000)] + ["x" * 20_000 + " " + "x" * 20_001]
    words, hashes = [], []
    for b in tb.blocks(pa.array(texts, pa.string()), 4096):
        w = tb.words(b, tb.SPACE)
        words += [b.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
        hashes += w.hash.tolist()
    assert words == [w for t in texts for w in t.encode().split()]
    assert len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))


def _texts(n):
    r = random.Random(9)
    return [" ".join(r.choice("abcdefghij") * 2 + str(r.randrange(50)) for _ in range(40)) for _ in range(n)]


def test_keep_one_judges_rows_not_ids(spark):
    a, b, c, d = _texts(4)
    near = a + " tail"
    rows = [(1, a), (1, b), (2, near), (2, c), (3, c), (4, c), (5, d), (5, d), (6, ""), (6, None), (None, a), (None, a), (7, b)]
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(make(spark, rows)).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (5, d), (6, ""), (6, None), (None, a), (None, a)], key=str)


def test_only_touched_texts_are_shuffled(spark):
    a, b, c = _texts(3)
    rows = [(i, t) for i, t in enumerate(_texts(60))] + [(100, a), (101, a), (102, b)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (ngram_join.keep_one(make(spark, rows)), secret_scan.redact(make(spark, [(*r, "s") for r in rows], "doc_id bigint, text string, source string"))):
            assert out.count() > 0
            plan = out._jdf.queryExecution().executedPlan().toString()
            union = plan[plan.index("Union"):]
            first, second = union.split("Exchange", 1) if "Exchange" in union else (union, "")
            assert "Filter" in first and "Exchange" not in first  # the rows that pass by come first, unshuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_id_table_holds_every_id(spark):
    ids = spark.range(0, 5000, 7).union(spark.createDataFrame([(None,)], "id bigint"))
    table = IdTable(ids, "id")
    from pyspark.sql import functions as F
    assert ids.where(~table.may_hold(F.col("id"))).count() == 0
    assert spark.range(10_000, 30_000).where(table.may_hold(F.col("id"))).count() < 4000
    none = IdTable(ids.limit(0), "id")
    assert spark.range(100).where(none.may_hold(F.col("id"))).count() == 0


def test_redact_with_columns_named_like_its_own(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = [(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"', "src") for i in range(30)] + [(90, "nothing here", "src"), (91, f'password = "{key}" and {key}', "src")]
    docs = make(spark, rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as _key", "2 as _secrets", "3 as secrets", "4 as k", "5 as _0", "6 as _1", "7 as candidate")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and got[90]["text"] == "nothing here" and all(r["_secrets"] == 2 and r["_0"] == 5 for r in got.values())
    assert key not in got[91]["text"] and all(secret_scan.REDACTED in got[i]["text"] for i in range(30))


def test_keep_one_with_columns_named_like_its_own(spark):
    a, b = _texts(2)
    docs = make(spark, [(2, a), (1, a), (3, b)]).selectExpr("*", "1 as c", "2 as key", "3 as k", "4 as kc", "5 as _0", "6 as n", "7 as root")
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["c"], r["_0"]) for r in out.collect()) == [(1, 1, 5), (3, 1, 5)]
    assert np.array_equal(sorted(out.toPandas().columns), sorted(docs.columns))


def test_250_languages_are_all_learned(spark):
    from claimlens.llm import language_id
    r = random.Random(8)
    words = {k: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for k in range(250)}
    rows = [(10 * k + i, " ".join(r.choices(words[k], k=30)), f"l{k:03d}") for k in words for i in range(2)]
    model = language_id.fit(make(spark, rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 250
