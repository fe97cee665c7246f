"""Operator 13 against SQL and a brute-force trie, with blocks of every size."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from claimlens.llm import conversation_trie as ct
from tests.llm.conftest import SF, same

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32], role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    return out


def brute(paths):
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below),
                    sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*ct._OUT[:-1], "ends").collect()), key=str)


def whole(rows):
    return sorted(((*r[:-1], r[-1] or ct.ROOT_ENDS) for r in rows), key=str)


def _table(seed, n, turns=5, kinds=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 6 * n), n):
        for t in range(r.randrange(1, turns)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice("abcdefg"[:kinds]) * r.randrange(0, 3)))
    return rows


def test_query_equals_sql(spark, duck):
    same(ct.query(spark, SF), duck, ct.ORACLE)


@pytest.mark.parametrize("classes", [1, 2, 7, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_with_blocks_of_any_size(spark, seed, classes, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(ct, "PIECE_IDS", 2)
    rows = _table(seed, 60)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    # worker processes import the module: the block size is given to the function that they run
    monkeypatch.setattr(ct, "_blocks", _blocks_of(classes))
    assert whole(got(ct.trie(ct.rebuilt_paths(df)))) == brute(rebuilt(rows))


def _blocks_of(classes):
    def run(it):
        from pyspark import TaskContext

        from claimlens.llm import conversation_trie as mod
        at, held = TaskContext.get().partitionId() << 32, []
        for row in mod._rows(it):
            held.append(row)
            if len(held) >= classes:
                yield mod._block(held, at)
                at, held = at + 1, []
        if held:
            yield mod._block(held, at)
    return run


def test_extents_by_binary_search_equal_a_scan():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 200):
        v = r.integers(0, 6, n)
        tree = ct.RangeMin(v)
        i, d = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(7)))
        right, left = tree.right(i, d), tree.left(i, d)
        for a, b, x, y in zip(i, d, left, right):
            assert y == next((j - 1 for j in range(a + 1, n) if v[j] < b), n - 1)
            assert x == next((j for j in range(a, 0, -1) if v[j] < b), 0)
        lo = r.integers(0, n, 50)
        hi = np.array([r.integers(a, n) for a in lo])
        assert (tree.between(lo, hi) == [v[a:b + 1].min() for a, b in zip(lo, hi)]).all()


def test_odd_rows_and_clashing_columns(spark):
    rows = [(7, None, None, None), (7, 1, "user", "é漢\U0001f642"), (7, 1, "user", "é漢\U0001f642"), (None, 0, "user", "x"), (0, 0, "user", "y" * 50_000),
            (100, 3, "assistant", ""), (100, 3, "assistant", "b"), (100, 2, "x", "\x00"), (113, 0, "user", "only"), (-5, 0, "user", "y")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as base", "2 as h", "3 as digest", "4 as chars", "5 as path", "6 as key", "7 as block")
    assert whole(got(ct.trie(ct.rebuilt_paths(df)))) == brute(rebuilt(rows))
    assert ct.trie(ct.rebuilt_paths(df.limit(0))).count() == 0
    assert ct.trie(ct.rebuilt_paths(df.where("conv_id is null"))).count() == 0
    own = {c: tuple((r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))) for c in (0, 113, -5)}
    assert whole(got(ct.trie(ct.plain_paths(df.where("conv_id in (0, 113, -5)"))))) == brute(own)


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its one turn is replaced, its first conversation absent
    rows = [(c, 0, "user", "x"), (205, 0, "user", "z"), (205, 1, "user", "z"), *[(205, i, "user", str(i)) for i in range(2, 9)]]
    out = whole(got(ct.trie(ct.rebuilt_paths(spark.createDataFrame(rows, TURNS)))))
    assert out == brute(rebuilt(rows))
    assert any(r[1] == 0 and r[-1] == hashlib.sha256(str(c).encode()).hexdigest() for r in out)


def test_a_conversation_copied_into_most_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(2)] + [(5000 + c, 0, "user", f"own {c % 40}") for c in range(500)]
    paths = spark.createDataFrame(rows, TURNS)
    plain = {}
    for c, t, r, x in rows:
        plain.setdefault(c, []).append((r, x))
    assert whole(got(ct.trie(ct.plain_paths(paths)))) == brute({c: tuple(v) for c, v in plain.items()})
