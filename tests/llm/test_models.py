"""Language identification, toxicity, secrets: held-out accuracy and odd rows."""

import pytest
from pyspark.sql import functions as F

from claimlens.llm import language_id, secret_scan, toxicity
from tests.llm.conftest import DOC, ODD, SF, make

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lang_model(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))


def test_language_held_out_accuracy(spark, lang_model):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where(language_id.held_out(F.col("doc_id")))
    got = language_id.predict(docs, lang_model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 100
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.01


def test_language_odd_rows(spark, lang_model):
    got = {str(r.doc_id): r for r in language_id.predict(make(spark, ODD), lang_model).collect()}
    for k in ("1", "2", "3", "4"):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got["7"].lang_pred in lang_model.languages
    other = language_id.predict(make(spark, [(1, "これは日本語の文章です。学習した言語ではありません。")]), lang_model).first()
    assert other.rejected and other.lang_pred in lang_model.languages
    kept = language_id.keep_known(make(spark, [(*r, None, None, None) for r in ODD], DOC), lang_model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {str(r.doc_id) for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}


def test_language_without_labels(spark):
    empty = language_id.fit(make(spark, [(1, "some text", None, None, None), (2, None, "en", None, None)], DOC))
    assert [tuple(r)[1:] for r in language_id.predict(make(spark, [(1, "text")]), empty).collect()] == [("und", 0.0, True)]
    assert language_id.predict(make(spark, []), empty).count() == 0
    one = language_id.fit(make(spark, [(i, "some text here", "en", None, None) for i in range(10)], DOC))
    assert language_id.predict(make(spark, [(1, "text")]), one).first().lang_pred == "en"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~part))
    held = labels.where(part).select("doc_id", "toxic")
    got = toxicity.score(docs.join(held, "doc_id"), model).join(held, "doc_id").toPandas()
    said = got.score >= toxicity.THRESHOLD
    assert got.score.between(0, 1).all()
    assert (got.toxic[said] == 1).mean() > 0.9
    assert said[got.toxic == 1].mean() > 0.6
    odd = toxicity.score(make(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(r.score < toxicity.THRESHOLD for r in odd)


def test_toxicity_one_kind_or_no_labels(spark):
    docs = make(spark, [(i, f"text {i}") for i in range(20)])
    for rows, want in (([], 0.0), ([(i, 1) for i in range(20)], 1.0)):
        model = toxicity.fit(docs, make(spark, rows, "doc_id bigint, toxic int"))
        assert all(abs(r.score - want) < 1e-3 for r in toxicity.score(docs, model).collect())


def test_copies_of_a_toxic_text_leave_its_terms_in_the_lexicon(spark):
    terms = ["grobnik", "vuldrak", "sneptor"]
    copied = "harmless opening words " + " ".join(f"mild {t}" for t in terms) + " and a harmless ending"
    rows = [(i, " ".join(f"c{chr(97 + (i * 7 + k) % 26)}x {w}" for k, w in enumerate([terms[i % 3], "river", "table", "paper"])), 1) for i in range(90)]
    rows += [(100 + i, f"river table paper window {i} mild", 0) for i in range(200)]
    rows += [(1000 + i, copied, 1) for i in range(400)]
    docs, labels = make(spark, [r[:2] for r in rows]), make(spark, [(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    kept = {t for t, stem, _ in model.entries}
    assert all(any(t.startswith(k) for k in kept) for t in terms)
    assert not {"harmless", "opening", "ending"} & kept
    tests = make(spark, [(i, f"the river was {t} beside a table") for i, t in enumerate(terms)] + [(9, "the river was calm beside a table")])
    got = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
    assert min(got[i] for i in range(3)) > got[9]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row


def test_trie_automaton_against_edit_distance():
    import random

    r = random.Random(2)
    entries = [("".join(r.choice("abc") for _ in range(n)), stem, 1.0) for n in (3, 4, 5, 6, 7) for stem in (False, True) for _ in range(3)]
    trie = toxicity.Trie(entries)
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randrange(1, 10)))
        best = None
        for text, stem, _ in entries:
            d = min(distance(text, w)) if stem else distance(text, w)[-1]
            if d == 0 or d == 1 and len(text) >= toxicity.FUZZY_LENGTH:
                best = min(best, (d, -len(text))) if best else (d, -len(text))
        got = trie.match(w)
        assert (got is None) == (best is None)
        if got:
            assert (got[0], -len(entries[got[1]][0])) == best


def test_quotation_counts_less():
    assert toxicity.quoted('they said "you idiot" today', 15, 20)
    assert toxicity.quoted("he wrote idiot", 9, 14)
    assert not toxicity.quoted("you idiot", 4, 9)
    s = toxicity.Scorer([("idiot", False, 5.0)])
    assert s.features('"you idiot"')[0] < s.features("you idiot")[0]
    assert s.features("you idjot")[1] > 0 and s.features("you idjjt")[1] == 0


KEY = "token = \"9f86d081884c7d659a2feaa0c55ad015{:08x}\""


def test_secrets_held_out(spark):
    rows = [(i, f"text before {KEY.format(i * 7919)} and after") for i in range(60)]
    rows += [(100 + i, f"order number 49{i:014d} was sent") for i in range(60)]
    rows += [(300, None), (301, ""), (302, f"{KEY.format(1)} and again {KEY.format(1)}")]
    docs = make(spark, [(d, t, None) for d, t in rows], "doc_id bigint, text string, source string")
    got = secret_scan.scan(docs).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start:r.end] == r.candidate for r in got)
    assert len(got) == 122
    assert all(r.secret == (r.doc_id < 100 or r.doc_id == 302) for r in got)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[0] == 'text before token = "<SECRET>" and after' and clean[302].count("<SECRET>") == 2
    assert clean[100] == texts[100] and clean[300] is None and clean[301] == "" and len(clean) == len(rows)


def test_secrets_in_prose_and_short_or_digitless_ones(spark):
    rows = [(i, f"text before {KEY.format(i * 7919)} and after") for i in range(60)]
    rows += [(100 + i, f"order number 49{i:014d} was sent") for i in range(60)]
    rows += [(200 + i, f"see report-{i:06d}-final-page in the folder") for i in range(60)]
    prose = "3b1f0c9d27e5486aa1904d7ce8f2b6039d5c7e14"
    digitless = "qWzRtYpLmKxVbNcGhJdFsaQwZxE"
    rows += [(300, f"he pasted {prose} into the chat"), (301, "password = \"hunt3r!x2\" and hunt3r!x2 again"),
             (302, f"token = \"{digitless}\""), (303, "api_key: k9Zt4QbW"), (304, "a password is a word of sorts: anything")]
    docs = make(spark, [(d, t, None) for d, t in rows], "doc_id bigint, text string, source string")
    got = secret_scan.scan(docs).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start:r.end] == r.candidate for r in got)
    found = {(r.doc_id, r.candidate): r.secret for r in got}
    assert {c for d, c in found if d >= 300} == {prose, "hunt3r!x2", digitless, "k9Zt4QbW"}
    assert found[300, prose] and found[301, "hunt3r!x2"] and found[302, digitless]
    assert all(r.secret == (r.doc_id < 100) for r in got if r.doc_id < 300)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[300] == "he pasted <SECRET> into the chat" and clean[301] == 'password = "<SECRET>" and <SECRET> again'
    assert clean[210] == texts[210] and clean[304] == texts[304]


def test_distinct_characters_are_of_the_whole_candidate(spark):
    found = make(spark, [(1, "7" * 300 + "abcdefgh", None)], "doc_id bigint, text string, source string")
    assert secret_scan.describe(secret_scan.findings(found)).first().distinct == 9


def test_secrets_learn_from_a_label_table_and_generalise(spark):
    rows = [(i, f"key {i}: \"a{i:05d}F{i * 31:06d}xQ9z\"") for i in range(80)] + [(200 + i, f"build-{i:016d}-done-file") for i in range(80)]
    docs = make(spark, [(d, t, "src") for d, t in rows], "doc_id bigint, text string, source string")
    found = secret_scan.describe(secret_scan.findings(docs)).cache()
    train = found.where("key % 2 = 0")
    forest = secret_scan.Forest(train, (F.col("key") < 200).cast("double"))
    held = forest.judge(found.where("key % 2 = 1")).select("key", "secret").collect()
    assert len(held) == 80 and sum(r.secret == (r.key < 200) for r in held) >= 78


def test_secrets_one_kind_and_empty(spark):
    schema = "doc_id bigint, text string, source string"
    only = secret_scan.scan(make(spark, [(1, "1234567890123456", None)], schema)).collect()
    assert [r.secret for r in only] == [False]
    assert secret_scan.scan(make(spark, [], schema)).count() == 0
    assert secret_scan.redact(make(spark, [], schema)).count() == 0


def test_secret_scan_has_no_python_on_its_path(spark):
    plan = secret_scan.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_sample_is_sliced_where_it_lies():
    """Pipeline's driver memory: the bags are slices of the batches they came in, whatever their offsets."""
    import numpy as np
    import pyarrow as pa

    from claimlens.llm import language_id

    rows = [([3, 1], [0.5, 0.25]), ([], []), ([7], [1.0]), ([2, 2, 9], [0.1, 0.2, 0.7])]
    whole = pa.table({"bucket": pa.array([b for b, _ in rows], pa.list_(pa.int32())), "share": pa.array([s for _, s in rows], pa.list_(pa.float32()))})
    parts = pa.Table.from_batches([*whole.slice(0, 2).to_batches(), *whole.slice(2).to_batches()])
    got = language_id._slices(parts)
    assert [b.tolist() for b, _ in got] == [b for b, _ in rows]
    assert all(np.allclose(s, w) for (_, s), (_, w) in zip(got, rows))
    assert all(not x.flags.owndata for pair in got for x in pair)


def test_language_sample_reaches_the_driver_small(docs):
    """Pipeline's driver memory: bags are deflated in the tasks and the same when they are inflated."""
    import numpy as np
    import pyarrow as pa

    from claimlens.llm import language_id

    rows = [r for r in docs.select("lang", "text").limit(50).collect() if r.text]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([r.lang for r in rows]), pa.array([r.text for r in rows])], ["seed", "lang", "text"])
    got = pa.Table.from_batches(language_id._sample_bags(iter([batch, batch.slice(0, 0)])))
    plain = got.drop(["bag"]).nbytes + 8 * sum(got["size"].to_pylist())
    assert got.nbytes < plain / 2
    bags = language_id._slices(language_id._inflated(got))
    firsts = [i for i in range(len(bags)) if i == 0 or got["seed"][i - 1] != got["seed"][i]]  # the whole text comes first
    assert len(firsts) == len(rows)
    for i, r in zip(firsts, rows):
        bucket, share = language_id.bag(language_id._LETTER[np.frombuffer(r.text.encode(), np.uint8)])
        assert (bags[i][0] == bucket).all() and (bags[i][1] == share.astype(np.float32)).all()
