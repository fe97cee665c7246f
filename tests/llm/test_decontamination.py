import random
import re

from claimlens.llm import decontamination as m
from tests.llm.conftest import ODD, SF, make, same

ITEM = "item_id string, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x.group().lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                ids = wins.get(tuple(w[k:k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def result(df, bench, **kw):
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in m.hits(df, bench, **kw).collect()), key=str)


def test_oracle(spark, duck):
    same(m.query(spark, SF), duck, m.ORACLE)


def test_random_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: r.choice("abc")  # noqa: E731  few words: many ties and repeats
    items = [(str(i), " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)] + [("1", None), ("x", ""), (None, "a b"), ("2", "a b c")]
    docs = [(i, ", ".join(word() for _ in range(r.choice([0, 2, 9, 10, 60])))) for i in range(60)] + ODD
    a, b = make(spark, docs), make(spark, items, ITEM)
    want = brute(docs, items)
    assert result(a, b) == want
    assert result(a, b, max_windows=7) == want  # many benchmark blocks
    clean = [d for d, _, h, _ in want if not h]
    assert sorted(map(str, (x.doc_id for x in m.remove_contaminated(a, b, max_windows=50).collect()))) == sorted(map(str, clean))


def test_empty_tables(spark):
    none = make(spark, [], ITEM)
    assert result(make(spark, ODD), none) == brute(ODD, [])
    assert result(make(spark, []), make(spark, [("1", "a b")], ITEM)) == []


def test_every_shared_span_is_found(spark):
    r = random.Random(1)
    item = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(100):
        k = r.randrange(190)
        docs.append((i, " ".join([f"d{i}-{j}" for j in range(r.randrange(40))] + item[k:k + 10] + ["end"] * r.randrange(5))))
    got = result(make(spark, docs), make(spark, [("7", " ".join(item))], ITEM))
    assert all(hit >= 10 and items == ("7",) for _, _, hit, items in got)
