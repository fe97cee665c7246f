"""Scalar traps of the reference SQL on literal rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from claimlens.functions import exprs as X


def test_ratio_rounds_half_away_from_zero(spark):
    # quotients 2.675, 1.005, 0.285, -2.675 exactly
    df = spark.createDataFrame(
        [(D("2.675"), D("1")), (D("1.005"), D("1")), (D("0.285"), D("1")), (D("-2.675"), D("1"))],
        "a decimal(12,4), b decimal(12,2)")
    got = [r[0] for r in df.select(X.ratio("a", "b")).collect()]
    assert got == [D("2.68"), D("1.01"), D("0.29"), D("-2.68")]


def test_ratio_is_not_rounded_twice(spark):
    # 1/3 * 100 = 33.333.. -> 33.3; 2.0049999999 must not become 2.01
    df = spark.createDataFrame([(D("1.0000"), D("3.00")), (D("20.0499"), D("10.00"))],
                               "a decimal(22,4), b decimal(22,2)")
    got = [r[0] for r in df.select(X.ratio("a", "b", 1, times=100)).collect()]
    assert got == [D("33.3"), D("200.5")]
    got2 = [r[0] for r in df.select(X.ratio("a", "b", 2)).collect()]
    assert got2 == [D("0.33"), D("2.00")]


def test_ratio_is_exact_for_large_denominators(spark):
    rows = [(D("499999999.99"), D("100000000000")), (D("500000000.00"), D("100000000000")), (D("-499999999.99"), D("100000000000")),
            (D("-500000000.00"), D("100000000000")), (D("9999999999999999999999.9999"), D("0.0100"))]
    df = spark.createDataFrame(rows, "a decimal(26,4), b decimal(22,4)")
    got = [r[0] for r in df.select(X.ratio("a", "b")).collect()]
    assert got == [D("0.00"), D("0.01"), D("0.00"), D("-0.01"), D("999999999999999999999999.99")]


def test_ratio_without_guard_raises_on_zero(spark):
    df = spark.createDataFrame([(D("5"), D("0"))], "a decimal(12,2), b decimal(12,2)")
    with pytest.raises(Exception):
        df.select(X.ratio("a", "b", guard=False)).collect()


def test_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(D("5"), D("0")), (D("5"), None), (None, D("2"))], "a decimal(12,2), b decimal(12,2)")
    assert [r[0] for r in df.select(X.ratio("a", "b")).collect()] == [None, None, None]


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(X.blank_to_null("s")).collect()] == [None, "x", None]


def test_names_concat_treats_null_as_empty(spark):
    df = spark.createDataFrame(
        [("I", "A", "B"), ("I", None, "B"), ("I", "A", None), ("O", "A", "Org"), (None, "A", "Org")],
        "t string, f string, l string")
    full = [r[0] for r in df.select(X.full_name("f", "l")).collect()]
    assert full == ["A B", " B", "A ", "A Org", "A Org"]
    disp = [r[0] for r in df.select(X.display_name("t", "f", "l")).collect()]
    assert disp == ["A B", " B", "A ", "Org", "Org"]


def test_code_type_null_falls_to_else(spark):
    df = spark.createDataFrame([("Y",), ("N",), (None,)], "d string")
    got = [r[0] for r in df.select(X.code_type("d", X.DRUG_LABEL_RANKING)).collect()]
    assert got == ["Part B Drug (ASP-based)", "Professional Service", "Professional Service"]


def test_outlier_flag_and_tier(spark):
    df = spark.createDataFrame([(D("50.1"),), (D("-50.1"),), (D("50.0"),), (None,)], "p decimal(5,1)")
    got = [r[0] for r in df.select(X.outlier_flag("p", 50)).collect()]
    assert got == ["HIGH OUTLIER", "LOW OUTLIER", "Within Range", "Within Range"]
    t = spark.createDataFrame([(D("3"), D("1"), D("2")), (D("0"), D("1"), D("2")), (D("1"), D("1"), D("2")),
                               (None, D("1"), D("2")), (D("5"), None, None)], "v decimal(5,0), a decimal(5,0), b decimal(5,0)")
    tiers = [r[0] for r in t.select(X.efficiency_tier("v", "a", "b")).collect()]
    assert tiers == [X.ABOVE_IQR, X.BELOW_IQR, X.WITHIN_IQR, X.WITHIN_IQR, X.WITHIN_IQR]


def test_round_stat_goes_through_six_places(spark):
    # doubles just below an exact x.xx5 (interpolation noise) round as the exact value
    df = spark.createDataFrame([(2.0049999999999999,), (0.285,), (1.0 + 2e-16,)], "x double")
    got = [r[0] for r in df.select(X.round_stat("x")).collect()]
    assert got == [D("2.01"), D("0.29"), D("1.00")]


def test_division_by_zero_raises_without_guard(spark):
    df = spark.createDataFrame([(D("1.00"), D("0.00"))], "a decimal(12,2), b decimal(12,2)")
    with pytest.raises(Exception):
        df.select((F.col("a") / F.col("b")).alias("q")).collect()


def _exact_sd(values):
    """ROUND(STDDEV_SAMP, 2) with exact decimal arithmetic (60 digits)."""
    import decimal
    ctx = decimal.Context(prec=60, rounding=decimal.ROUND_HALF_UP)
    xs = [v for v in values if v is not None]
    n = len(xs)
    if n < 2:
        return None
    mean = ctx.divide(sum(xs), n)
    var = ctx.divide(sum(ctx.multiply(x - mean, x - mean) for x in xs), n - 1)
    return ctx.sqrt(var).quantize(D("0.01"), rounding=decimal.ROUND_HALF_UP)


def test_exact_stddev_matches_decimal_arithmetic(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for g in range(60):
        size = rnd.choice([1, 2, 3, 5, 17, 40])
        spread = rnd.choice([1, 100, 100000, 10**9])
        for _ in range(size):
            rows.append((g, None if rnd.random() < 0.05 else D(rnd.randint(0, spread)) / 100))
    # values whose stddev sits exactly on / next to a rounding boundary
    rows += [(1000, D("0.00")), (1000, D("0.01")), (1001, D("1.00")), (1001, D("1.00"))]
    df = spark.createDataFrame(rows, "g int, x decimal(14,2)")
    got = {r.g: r.sd for r in df.groupBy("g").agg(*X.stddev_parts("x"))
           .select("g", X.stddev_rounded().alias("sd")).collect()}
    by_g = {}
    for g, x in rows:
        by_g.setdefault(g, []).append(x)
    assert got == {g: _exact_sd(v) for g, v in by_g.items()}


@pytest.mark.parametrize("k,times", [(2, 1), (1, 100), (2, 100)])
def test_ratio_matches_exact_decimal_arithmetic(spark, k, times):
    import decimal
    import random
    rnd = random.Random(k * 1000 + times)
    rows = []
    for _ in range(4000):
        a = D(rnd.randint(-10**13, 10**13)) / D(10**4)          # like SUM(avg * services)
        b = D(rnd.choice([rnd.randint(1, 999), rnd.randint(1, 10**12)])) / D(100)
        rows.append((a, b))
    # values that land exactly on a half
    rows += [(D("1.0050"), D("1.00")), (D("-2.6750"), D("1.00")), (D("0.0001"), D("0.02"))]
    df = spark.createDataFrame(rows, "a decimal(22,4), b decimal(20,2)")
    got = [r[0] for r in df.select(X.ratio("a", "b", k, times=times)).collect()]
    q = D(1).scaleb(-k)
    ctx = decimal.Context(prec=80)
    want = [ctx.divide(a * times, b).quantize(q, rounding=decimal.ROUND_HALF_UP) for a, b in rows]
    assert got == want


def test_ratio_handles_national_scale_sums(spark):
    # sums far beyond one state's year: 10^21 dollars over 10^17 services
    a, b = D("123456789012345678901.2345"), D("98765432109876543.21")
    df = spark.createDataFrame([(a, b)], "a decimal(35,4), b decimal(32,2)")
    r = df.select(X.ratio("a", "b").alias("r"), X.ratio("a", "b", 1, times=100).alias("p")).first()
    import decimal
    ctx = decimal.Context(prec=60)
    assert r.r == ctx.divide(a, b).quantize(D("0.01"), rounding=decimal.ROUND_HALF_UP)
    assert r.p == ctx.divide(a * 100, b).quantize(D("0.1"), rounding=decimal.ROUND_HALF_UP)
