import array
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from claimlens.llm import byte_bpe as m
from tests.llm.conftest import ODD, make

RANKS = m.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return m.Encoder(RANKS, P.PATTERN)


def want(t):
    return array.array("I", TRUE.encode_ordinary(t)).tobytes()


def test_equals_the_library(enc, docs):
    texts = [r.text for r in docs.select("text").collect()]
    assert enc.packed(texts) == [want(t) for t in texts]


def test_random_text(enc):
    r = random.Random(4)
    texts = ["".join(r.choice("aàbß 0123 \n\t'stl漢字🙂é=-\x1c\x85\xa0²½/") for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["a" * 3000, " " * 3000, "=" * 999 + "<|endoftext|>"]
    assert enc.packed(texts) == [want(t) for t in texts]


def test_caches_are_bounded(enc, monkeypatch):
    monkeypatch.setattr(m, "CACHE_PIECES", 3)
    monkeypatch.setattr(m, "CACHE_PAIRS", 3)
    t = "several different words that do not fit the cache"
    small = m.Encoder(RANKS, P.PATTERN)
    assert small.packed([t, t[::-1], t]) == [want(t), want(t[::-1]), want(t)]


def test_append_and_edit(enc):
    r = random.Random(6)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(400))
    table = m.PrefixTable(enc)
    for i in range(0, 400, 7):
        table.append(data[i:i + 7])
    assert table.tokens() == m.PrefixTable(enc, data).tokens() == m.merge_by_rank(data, RANKS)
    done = table.edit(50, 53, b"xyzzy")
    assert table.tokens() == m.merge_by_rank(table.data, RANKS)
    assert done < 150
    table.edit(0, 10, b"")
    assert table.tokens() == m.merge_by_rank(table.data, RANKS)


def test_whole_rows(spark):
    model = m.default_model(spark)
    rows = make(spark, ODD + [(10, "<|endoftext|>")])
    got = m.decode(m.encode(rows, model), model).collect()
    assert sorted(((r.doc_id or 0, bytes(r.ids), bytes(r.decoded), r.n_tokens) for r in got)) == sorted(
        (d or 0, want(t or ""), (t or "").encode(), len(want(t or "")) // 4) for d, t in ODD + [(10, "<|endoftext|>")])
    assert m.encode(make(spark, []), model).count() == 0
    kept = make(spark, [(1, "a", 5)], "doc_id bigint, text string, ids int")
    with pytest.raises(Exception):
        m.encode(kept, model, ("doc_id", "ids")).collect()  # a kept column may not take the name of the result


def test_query_digests(spark):
    from tests.llm.conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in m.query(spark, SF).collect():
        assert r.ids_sha256 == hashlib.sha256(want(texts[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_neighbours_are_judged_without_merging_their_bytes(monkeypatch):
    """op2's time: a pair of tokens is taken apart merge by merge; the answers are those of plain merging."""
    ranks = m.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc, plain = m.Encoder(ranks, P.PATTERN), m.merge_by_rank
    tokens, rnd = sorted(ranks.values()), random.Random(3)
    few = [t for t in tokens if len(set(enc.bytes_of[t])) == 1 and len(enc.bytes_of[t]) < 5][:60]  # equal ranks at the border
    pairs = [(a, b) for a in few for b in few] + [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)] + [(-1, t) for t in tokens[::50]]
    want = [plain((enc.bytes_of[a] if a >= 0 else b"") + enc.bytes_of[b], ranks) == ([a] if a >= 0 else []) + [b] for a, b in pairs]
    monkeypatch.setattr(m, "merge_by_rank", lambda *a: pytest.fail("bytes of a pair were merged anew"))
    assert [enc.fits(a, b) for a, b in pairs] == want
    assert True in want and False in want
    monkeypatch.undo()
    # ranks in any order, also of tokens that no merge or only a later one makes
    for k in range(30):
        some = sorted({bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(12)})
        rnd.shuffle(some)
        odd = m.Encoder({**{bytes([i]): i for i in range(256)}, **{x: 256 + i for i, x in enumerate(some)}}, P.PATTERN)
        every = [97, 98, 99, *range(256, 256 + len(some))]
        for a in [-1, *every]:
            for b in every:
                alone = [a] if a >= 0 else []
                assert odd.fits(a, b) == (plain(b"".join(odd.bytes_of[t] for t in [*alone, b]), odd.ranks) == [*alone, b])
    words = ["", "abcabc" * 30, "zz" * 70, "é中" * 9] + ["".join(rnd.choices("aeth nr", k=20)) for _ in range(50)]
    assert enc.packed(words) == [b"".join(t.to_bytes(4, "little") for p in enc.split(w) for t in plain(p.encode(), ranks)) for w in words]
