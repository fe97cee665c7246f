"""Distributed rank / running sum / percentile / top-k against plain windows."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.plans.materialize import join_null_safe
from claimlens.plans.ranking import exact_percentiles, top_k_ranked, value_positions
from tests.conftest import assert_same


def _random_rows(seed, n=400, keys=("a", "b", None), null_share=0.08, distinct=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.choice(keys)
        v = None if rnd.random() < null_share else D(rnd.randint(-distinct, distinct * 3)) / D(4)
        rows.append((i, k, v))
    return rows


SCHEMA = "id int, k string, v decimal(12,2)"


def running_sum_within(df, part, value, **kw):
    """Every row with the rank and running sum of its value."""
    pos = value_positions(df.select(*part, value), part, value, **kw).select(*part, value, "_rank", "_run_sum")
    return join_null_safe(df, pos, [*part, value])


@pytest.mark.parametrize("seed,buckets", [(1, 4), (2, 8), (3, 64)])
@pytest.mark.parametrize("descending,nulls_first", [(True, True), (False, False), (True, False), (False, True)])
def test_partitioned_rank_and_running_sum_match_window(spark, seed, buckets, descending, nulls_first):
    df = spark.createDataFrame(_random_rows(seed), SCHEMA)
    order = {(True, True): F.col("v").desc_nulls_first(), (True, False): F.col("v").desc_nulls_last(),
             (False, True): F.col("v").asc_nulls_first(), (False, False): F.col("v").asc_nulls_last()}[
        (descending, nulls_first)]
    w = Window.partitionBy("k").orderBy(order)  # default RANGE frame
    expected = df.select("id", F.rank().over(w).cast("bigint").alias("r"), F.sum("v").over(w).alias("s"))
    pos = value_positions(df.select("k", "v"), ["k"], "v", descending=descending,
                          nulls_first=nulls_first, buckets=buckets)
    got = running_sum_within(df, ["k"], "v", descending=descending, nulls_first=nulls_first, buckets=buckets)
    got = got.select("id", F.col("_rank").cast("bigint").alias("r"), F.col("_run_sum").alias("s"))
    assert_same(got, expected)
    assert pos.count() == df.select("k", "v").distinct().count()


@pytest.mark.parametrize("seed", [4, 5])
def test_global_rank_and_running_sum_match_window(spark, seed):
    df = spark.createDataFrame(_random_rows(seed, keys=("x",)), SCHEMA)
    w = Window.orderBy(F.col("v").desc_nulls_first())
    expected = df.select("id", F.rank().over(w).cast("bigint").alias("r"), F.sum("v").over(w).alias("s"))
    got = running_sum_within(df, [], "v", buckets=8)
    got = got.select("id", F.col("_rank").cast("bigint").alias("r"), F.col("_run_sum").alias("s"))
    assert_same(got, expected)


def test_rank_ties_fixture(spark):
    # totals 5, 5, 3 and one NULL, NULL first: ranks 1, 2, 2, 4; running NULL, 10, 10, 13
    df = spark.createDataFrame([(1, "x", D(5)), (2, "x", D(5)), (3, "x", D(3)), (4, "x", None)], SCHEMA)
    got = {r.id: (r._rank, r._run_sum) for r in running_sum_within(df, [], "v", buckets=2).collect()}
    assert got == {4: (1, None), 1: (2, D(10)), 2: (2, D(10)), 3: (4, D(13))}
    top = {r.id: (r._rank, r._run_sum, r._grand) for r in top_k_ranked(df, "v", ["id"], 3).collect()}
    assert top == {4: (1, None, D(13)), 1: (2, D(10), D(13)), 2: (2, D(10), D(13))}


def test_only_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None)], SCHEMA)
    got = sorted((r._rank, r._run_sum) for r in running_sum_within(df, ["k"], "v").collect())
    assert got == [(1, None), (1, None)]
    assert exact_percentiles(df, ["k"], "v", {"m": "0.5"}).count() == 0


@pytest.mark.parametrize("seed", [6, 7, 8])
@pytest.mark.parametrize("k", [1, 5, 25, 1000])
def test_top_k_matches_global_window(spark, seed, k):
    df = spark.createDataFrame(_random_rows(seed, n=300, keys=("x",), distinct=15), SCHEMA)
    w = Window.orderBy(F.col("v").desc_nulls_first())
    full = df.select("id", "v", F.rank().over(w).cast("bigint").alias("r"), F.sum("v").over(w).alias("s"),
                     F.sum("v").over(Window.partitionBy()).alias("g"))
    expected = full.orderBy(F.col("v").desc_nulls_first(), F.col("id")).limit(k)
    got = top_k_ranked(df, "v", ["id"], k).select(
        "id", "v", F.col("_rank").alias("r"), F.col("_run_sum").alias("s"), F.col("_grand").alias("g"))
    assert_same(got, expected)


@pytest.mark.parametrize("seed,buckets", [(9, 4), (10, 64)])
def test_exact_percentiles_match_percentile_cont(spark, seed, buckets):
    df = spark.createDataFrame(_random_rows(seed, n=300), SCHEMA)
    ps = {"p50": "0.5", "p25": "0.25", "p75": "0.75", "p10": "0.1"}
    exp = df.groupBy("k").agg(*[
        F.round(F.expr(f"percentile_cont({p}) within group (order by v)").cast("decimal(24,6)"), 6).alias(n)
        for n, p in ps.items()])
    exp = exp.where(F.col("p50").isNotNull())
    got = exact_percentiles(df, ["k"], "v", ps, buckets=buckets)
    got = got.select("k", *[F.round(F.col(n).cast("decimal(24,6)"), 6).alias(n) for n in ps])
    assert_same(got, exp)


def test_percentile_fixture(spark):
    # 1.00, 1.01, 3.00, 8.07, NULL: median 2.005 -> 2.01, p25 1.0075 -> 1.01
    df = spark.createDataFrame([(1, "s", D("1.00")), (2, "s", D("1.01")), (3, "s", D("3.00")),
                                (4, "s", D("8.07")), (5, "s", None)], SCHEMA)
    r = exact_percentiles(df, ["k"], "v", {"m": "0.5", "q1": "0.25"}).collect()[0]
    assert r.m == D("2.005") and r.q1 == D("1.0075")


def test_hot_key_and_hot_value_match_window(spark):
    # key "hot" holds ~80 % of rows; within it one value holds ~40 % and NULL ~20 %
    rnd = random.Random(99)
    rows = []
    for i in range(3000):
        k = "hot" if i % 5 else rnd.choice(["a", "b"])
        r = rnd.random()
        v = D("7.25") if r < 0.4 else (None if r < 0.6 else D(rnd.randint(0, 400)) / D(4))
        rows.append((i, k, v))
    df = spark.createDataFrame(rows, SCHEMA)
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_first())
    expected = df.select("id", F.rank().over(w).cast("bigint").alias("r"), F.sum("v").over(w).alias("s"))
    got = running_sum_within(df, ["k"], "v", buckets=16).select(
        "id", F.col("_rank").cast("bigint").alias("r"), F.col("_run_sum").alias("s"))
    assert_same(got, expected)
    exp_p = df.groupBy("k").agg(F.round(F.expr("percentile_cont(0.5) within group (order by v)")
                                        .cast("decimal(24,6)"), 6).alias("m"))
    got_p = exact_percentiles(df, ["k"], "v", {"m": "0.5"}, buckets=16).select(
        "k", F.round(F.col("m").cast("decimal(24,6)"), 6).alias("m"))
    assert_same(got_p, exp_p)


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_distribution_equals_percentile_cont_and_sums(spark, buckets):
    from claimlens.plans.ranking import distribution
    r = random.Random(buckets)
    rows = [(k, None if r.random() < 0.1 else D(r.choice([r.randrange(-500, 500), r.randrange(0, 10**7), 0, 700])) / 100)
            for k in ("a", "b", None) for _ in range(r.randrange(150, 300))]
    rows += [("one", D("3.10")), ("none", None), ("hot", D("1.00"))] + [("hot", D("5.00"))] * 400
    df = spark.createDataFrame(rows, "k string, v decimal(12,2)").repartition(4)
    got = {x["k"]: x for x in distribution(df, "k", "v", {"m": "0.5", "q1": "0.25", "q3": "0.75"}, buckets=buckets).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, x in got.items():
        mine = [v for j, v in rows if j == k]
        v = sorted(y for y in mine if y is not None)
        assert (x["_rows"], x["_cnt"], x["_sd_n"]) == (len(mine), len(v), len(v))
        if not v:
            assert (x["_sum"], x["_min"], x["m"]) == (None, None, None)
            continue
        assert (x["_sum"], x["_min"], x["_max"]) == (sum(v), v[0], v[-1])
        assert (int(x["_sd_s1"]), int(x["_sd_s2"])) == (sum(int(y * 100) for y in v), sum(int(y * 100) ** 2 for y in v))
        for name, p in (("m", D("0.5")), ("q1", D("0.25")), ("q3", D("0.75"))):
            at = (len(v) - 1) * p
            lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert x[name] == lo + (hi - lo) * (at % 1), (k, name)
