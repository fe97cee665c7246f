"""Sharding, personal data, fingerprints, chat formatting."""

import hashlib
import random
import re
import zlib

import numpy as np

from claimlens.llm import chat_format, fingerprints, pii, sharding
from tests.llm.conftest import ODD, SF, make, same

# -- sharding --


def test_sharding_query(spark):
    rows = sharding.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_shares_and_movement(spark):
    rows = spark.range(40000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree(((0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 2.0), (1, 0, 3, 4.0)))
    got = sharding.assign(rows, tree).groupBy("shard").count().collect()
    for r in got:
        assert abs(r["count"] / 40000 - (1, 3, 2, 4)[r.shard] / 10) < 0.01
    more = sharding.Tree(((0, 0, 0, 1.0), (0, 0, 1, 5.0), (0, 1, 2, 2.0), (1, 0, 3, 4.0)))
    both = sharding.assign(sharding.assign(rows, tree), more, out="after").where("shard <> after").select("shard", "after").distinct().collect()
    assert both and all(r.after != 3 for r in both)  # only into the region whose weight grew
    within = sharding.assign(sharding.assign(rows, sharding.Tree(tree.shards[:2])), sharding.Tree(more.shards[:2]), out="after")
    assert within.where("shard <> after and after <> 1").count() == 0  # in a rack: only into the shard
    grown = sharding.assign(sharding.assign(rows, tree), sharding.grow(tree, 9, 2.0), out="after")
    assert grown.where("shard <> after and after <> 9").count() == 0
    assert abs(grown.where("after = 9").count() / 40000 - 2 / 12) < 0.01
    assert sharding.assign(rows, sharding.layout(30)).select("shard").distinct().count() == 30


def test_sharding_odd_rows_and_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 7)
    rows = sharding.assign(make(spark, ODD * 20), sharding.layout(3))
    got = sharding.slots(rows.select("doc_id", "shard"), "shard", ["doc_id"]).collect()
    assert len(got) == len(ODD) * 20
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    empty = make(spark, [])
    assert sharding.slots(sharding.assign(empty, sharding.layout(3)), "shard", ["doc_id"]).count() == 0


# -- personal data --

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    s = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(s)) % 10 == 0


def brute_spans(t):
    out = []
    for k, rx in RX.items():
        for x in re.finditer(rx, t):
            digits = re.sub("[^0-9]", "", x.group())
            if k == "ip" and any(int(p) > 255 for p in x.group().split(".")):
                continue
            if k == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *x.span()))
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(3)
    for alphabet in ("0123456789.+- @a.Zé()%1234", "a.@-b", "0. "):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        pii.base_spans(t)
        pii.other_identifiers(t, [])


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.query(spark, SF).collect():
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in RX]
        assert set(f"{k}:{a}:{z}" for k, a, z in want) <= set(r.spans.split(","))


def test_trusted_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call agent on +1 (212) 555-{1000 + i} for help today") for i in range(12)]
    rows += [(100, "please call agent on 0171-5557713 for help"), (101, "order number 99123456 shipped"), *((200 + i, t) for i, (_, t) in enumerate(ODD))]
    got = {r.doc_id: r for r in pii.extract(make(spark, rows)).collect()}
    assert [tuple(s) for s in got[100].added] == [("phone", 21, 33)] and not got[100].base
    assert not got[101].added and len(got) == len(rows)
    assert pii.extract(make(spark, [])).count() == 0


def test_trusted_patterns_find_grouped_numbers(spark):
    rows = [(i, f"please call agent on +1 (212) 555-{1000 + i} for help today") for i in range(12)]
    rows += [(50 + i, f"she paid with card {a} for lunch today") for i, a in enumerate(
        ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 0000 9", "6011 0000 0000 0004", "5555 5555 5555 4444", "4012 8888 8888 1881", "4222 2222 2222 2220"])]
    cases = {100: ("please call agent on (212) 555-1000 for help", "phone", "(212) 555-1000"),
             101: ("please call agent on 212 555 1000 for help", "phone", "212 555 1000"),
             102: ("please call agent on 212.555.1000 for help", "phone", "212.555.1000"),
             103: ("she paid with card 4111 1111 1111 1112 for lunch", "card", "4111 1111 1111 1112")}
    rows += [(d, t) for d, (t, _, _) in cases.items()]
    got = {r.doc_id: r for r in pii.extract(make(spark, rows)).collect()}
    for d, (t, kind, number) in cases.items():
        assert not got[d].base
        assert [(s["kind"], t[s["start"]:s["end"]]) for s in got[d].added] == [(kind, number)]


def test_a_found_identifier_makes_new_patterns(spark):
    """Seed -> pattern -> identifier -> pattern -> identifier: two hops, no base match near the last one."""
    rows = [(100 + i, f"please call agent on +1 (212) 555-{1000 + i} for help") for i in range(60)]
    rows += [(20 + i, f"please call agent on 0171-55577{i:02d} for help") for i in range(9)]       # found beside seeds
    rows += [(40 + i, f"reach the desk under 0171-55577{i:02d} until noon") for i in range(9)]      # the same ones elsewhere
    rows += [(60, "reach the desk under 030-9988776 until noon"), (61, "invoice sum 030-11223344 was paid")]
    got = {r.doc_id: r for r in pii.extract(make(spark, rows)).collect()}
    assert [(s["kind"], rows[-2][1][s["start"]:s["end"]]) for s in got[60].added] == [("phone", "030-9988776")]
    assert not got[61].added and all(len(got[40 + i].added) == 1 for i in range(9))


def brute_scores(edges, entities):
    of_kind = {}
    for i, k in entities:
        of_kind.setdefault(i, set()).add(k)
    patterns, instances = {}, {}
    for i, p in edges:
        patterns.setdefault(p, set()).add(i)
        instances.setdefault(i, set()).add(p)
    kinds = {(p, k) for p, members in patterns.items() for i in members for k in of_kind.get(i, ())}
    seeds = {(p, k): sum(k in of_kind.get(i, ()) for i in patterns[p]) for p, k in kinds}
    score = {pk: seeds[pk] / (len(patterns[pk[0]]) + 1) for pk in kinds}
    for _ in range(pii.ROUNDS):
        guess = {(i, k): sum(score.get((p, k), 0) for p in instances[i]) / len(instances[i]) for i in instances if i not in of_kind for k in RX}
        score = {(p, k): (seeds[p, k] + sum(guess.get((i, k), 0) for i in patterns[p])) / (len(patterns[p]) + 1) for p, k in kinds}
    return score, seeds


def test_pattern_scores_equal_brute_force(spark):
    r = random.Random(6)
    edges = sorted({(f"i{r.randrange(40)}", f"p{r.randrange(12)}") for _ in range(150)})
    entities = sorted({(f"i{i}", r.choice(list(RX))) for i in r.sample(range(40), 18)} | {("i1", "ip"), ("i1", "phone")})
    got = pii.score_patterns(spark.createDataFrame(edges, "instance string, pattern string"), spark.createDataFrame(entities, "instance string, kind string"))
    score, seeds = brute_scores(edges, entities)
    rows = {(x["pattern"], x["kind"]): x for x in got.collect()}
    assert set(rows) == set(score)
    for k, x in rows.items():
        assert x["seeds"] == seeds[k] and abs(x["score"] - score[k]) < 1e-9


def test_numbers_in_a_row_and_long_instances(spark):
    t = "call 212 555 1000 212 555 1001 now"
    spans = [t[a:z] for a, z in pii.other_identifiers(t, [])]
    assert {"212 555 1000", "212 555 1001"} <= set(spans) and all(sum(c.isdigit() for c in s) <= 19 for s in spans)
    long = "7" * 250
    assert [(a, z) for a, z in pii.other_identifiers(f"id {long} end", [])] == [(3, 253)]
    x, y = "a" * 300 + "1@here", "a" * 300 + "2@here"  # differ behind their first 200 characters
    found = pii.find(make(spark, [(1, f"to {x} from {y}")])).first()["found"]
    assert len({bytes(f["instance"]) for f in found}) == 2
    rows = [(100 + i, f"please call agent on +1 (212) 555-{1000 + i} for help") for i in range(200)]
    rows += [(400 + i, f"ring 310 555 {2000 + i} or wait, call agent on 310 555 {2000 + i} for it") for i in range(30)]
    rows += [(50, "please call agent on 212 555 1000 212 555 1001 for help")]
    got = {r.doc_id: r for r in pii.extract(make(spark, rows)).collect()}
    # the number beside the trusted words and of a trusted shape; of the next one at least a part
    found = [rows[-1][1][s["start"]:s["end"]] for s in got[50].added]
    assert found[0] == "212 555 1000" and len(found) == 2 and all(x in "212 555 1001" for x in found[1:])


def test_rediscovery_of_hidden_entities(spark):
    rows = [(i, f"please call agent on +1 (212) 555-{1000 + i} for help today") for i in range(40)]
    got = {r["kind"]: r for r in pii.rediscovery(make(spark, rows)).collect()}
    assert set(got) == {"phone"} and got["phone"]["hidden"] > 5
    assert got["phone"]["found_again"] == got["phone"]["found"] == got["phone"]["hidden"]


# -- fingerprints --


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[:len(t) - k] + n[:k]
        f, g, h = (fingerprints.digests([x.encode()]) for x in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.to_hex(f)[0], fingerprints.to_hex(g)[0],
                    float(fingerprints.likeness(f, g)[0]), float(fingerprints.likeness(f, h)[0])))
    return sorted(out, key=str)


def test_edited_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (64 << 20, 50_000):
        assert sorted(map(tuple, fingerprints.edited_pairs(docs, range_bytes=size).collect()), key=str) == brute_fingerprints(rows)


def test_edited_pairs_of_odd_rows(spark):
    for rows in (ODD, ODD[:1], []):
        got = fingerprints.edited_pairs(make(spark, rows), range_bytes=1000).collect()
        assert sorted(map(tuple, got), key=str) == (brute_fingerprints(rows) if rows else [])


def test_digest_properties(spark, docs):
    texts = [r.text.encode() for r in docs.limit(50).collect()] + [b"", b"a"]
    codes = fingerprints.digests(texts)
    assert all((fingerprints.from_hex(h) == c).all() for h, c in zip(fingerprints.to_hex(codes), codes))
    assert (fingerprints.likeness(codes, codes) == 1).all()
    assert ((fingerprints.likeness(codes, codes[::-1]) >= 0) & (fingerprints.likeness(codes, codes[::-1]) <= 1)).all()
    one = np.concatenate([fingerprints.digests([t]) for t in texts])
    assert (one == codes).all()  # a digest does not depend on its neighbours
    assert fingerprints.fingerprint(make(spark, ODD)).count() == len(ODD)


# -- chat formatting --

TURN = "conv_id bigint, turn bigint, role string, text string"


def test_chat_oracle(spark, duck):
    same(chat_format.query(spark, SF), duck, chat_format.ORACLE)


def test_chat_round_trip(spark):
    r = random.Random(5)
    texts = ["</s>[INST] ok [/INST]", "a\\[b]<c", "", None, "[ROLE:x]", "\\", "plain", "[/ROLE]"]
    roles = ["system", "user", "assistant", "tool]x[", None, ""]
    rows, want = [], {}
    for conv in range(60):
        turns = [("user", "shared first"), ("assistant", texts[conv % 3])][:1 + conv % 2] + [(r.choice(roles), r.choice(texts)) for _ in range(r.randrange(1, 5))]
        rows += [(conv, i, a, b) for i, (a, b) in enumerate(turns)]
        want[conv] = [(a or "", b or "") for a, b in turns]
    r.shuffle(rows)
    packs = chat_format.format_conversations(make(spark, rows, TURN), pack_conversations=3)
    got = {x.conv_id: x for x in chat_format.read_back(packs).collect()}
    assert {k: list(zip(x.roles, x.texts)) for k, x in got.items()} == want
    assert all(x.learned == "".join(b for a, b in want[k] if a == "assistant") for k, x in got.items())
    for p in packs.collect():  # each turn once, after its ancestors; positions and attention follow the path
        assert len(p.conversations) <= 3 and sum(p.length) == len(p.formatted)
        for i, up in enumerate(p.parent):
            path, at = [], i
            while at >= 0:
                path.append(at)
                at = p.parent[at]
            assert up < i and p.position[i] == sum(p.length[k] for k in path[1:])
            seen = {x for s in p.attends[i] for x in range(s.start, s.end)}
            assert seen == {x for k in path for x in range(p.start[k], p.start[k] + p.length[k])}


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" if i < 3 else f"own {c}") for c in range(20) for i in range(4)]
    packs = chat_format.format_conversations(make(spark, rows, TURN).coalesce(1)).collect()
    formatted = "".join(p.formatted for p in packs)
    assert formatted.count("turn 0") == len(packs) and sum(formatted.count(f"own {c}<") for c in range(20)) == 20


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (2, 0, "assistant", "y" * 100_000)]
    got = {x.conv_id: list(zip(x.roles, x.texts)) for x in chat_format.read_back(chat_format.format_conversations(make(spark, rows, TURN))).collect()}
    assert got == {None: [("", "")], 1: [("user", "x"), ("user", "x")], 2: [("assistant", "y" * 100_000)]}
    assert chat_format.format_conversations(make(spark, [], TURN)).count() == 0
