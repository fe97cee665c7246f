"""Every operator and stage on tables with extra columns named like internal ones; odd rows through the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import byte_bpe, chat_format, decontamination, fingerprints, language_id, pii, sharding, toxicity
from tests.llm.conftest import DOC, ODD, SF, make

NAMES = ["key", "row", "n", "c", "h", "_group", "_k", "_n", "_g", "_first", "_shard", "slot", "shard", "found", "added", "base", "kind", "start", "end", "items",
         "spans", "n_words", "ids", "n_tokens", "decoded", "score", "fingerprint", "edited", "next", "count", "label", "features", "id", "_key", "_secrets", "_0", "_kept"]


def wide(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


@pytest.fixture(scope="module")
def texts(spark):
    return wide(make(spark, [(i, f"Please call agent {i} on +1 (212) 555-{1000 + i} und der die das") for i in range(8)] + [(90, None), (91, "")]))


def one_row_each(out, docs):
    assert out.count() == docs.count()


def test_operators_answer_every_row(spark, texts):
    one_row_each(byte_bpe.encode(texts, byte_bpe.default_model(spark), decoded=True), texts)
    one_row_each(pii.extract(texts), texts)
    one_row_each(fingerprints.edited_pairs(texts), texts)
    bench = wide(make(spark, [("a", "call agent 3 on +1 (212) 555-1003 und")], "item_id string, text string"))
    hits = decontamination.hits(texts, bench)
    one_row_each(hits, texts)
    assert [r["doc_id"] for r in hits.where(F.size("items") > 0).collect()] == [3]
    clean = decontamination.remove_contaminated(texts, bench)
    assert clean.columns == texts.columns and clean.count() == texts.count() - 1


def test_models_answer_every_row(spark, texts):
    labelled = texts.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    model = language_id.fit(labelled)
    one_row_each(language_id.predict(labelled, model), texts)
    assert language_id.keep_known(labelled, model).columns == labelled.columns
    labels = make(spark, [(i, i % 2) for i in range(8)], "doc_id bigint, toxic int").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    one_row_each(toxicity.score(texts, toxicity.fit(texts, labels)), texts)


def test_sharding_keeps_the_callers_columns(spark, texts):
    rows = sharding.assign(texts.drop("shard"), sharding.layout(5))
    out = sharding.slots(rows, "shard", ["doc_id"], out="place")
    assert out.columns == [*rows.columns, "place"]
    got = out.collect()
    assert all(r["_group"] == NAMES.index("_group") and r["_k"] == NAMES.index("_k") for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_conversations(spark):
    turns = make(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.select("*", *[F.lit(1).alias(n) for n in ("path", "roles", "texts", "formatted", "position")])
    assert chat_format.read_back(chat_format.format_conversations(turns)).count() == 2


def test_stages_keep_extra_columns_and_odd_rows(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else "de", "s", len(t or "")) for d, t in ODD] + [(100 + i, f"the weather of day {i} is a fine one and so on " * 4, "en", "s", 9) for i in range(20)]
    now = wide(make(spark, rows, DOC))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "tokens":
            assert out.columns == now.columns
            now = out
    assert {r["doc_id"] for r in out.collect()} <= {d for d, *_ in rows}
    empty = make(spark, [], DOC)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        empty = out if set(empty.columns) <= set(out.columns) else empty
