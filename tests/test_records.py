"""Parallel scan of quoted multi-line CSV: the same rows as the unsplit reader, in several tasks."""

import os
import random

import pytest

from claimlens.schema import STAGING_COLUMNS
from claimlens.sources import loaders, records, staging
from tests.conftest import assert_same
from tests.test_sources import HEADER, _csv_field, _line, _write


@pytest.fixture()
def small_splits(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _random_rows(seed, n):
    r = random.Random(seed)
    bits = ["a", "b,", '"', '""', "\n", "\n\n", "é", " ", "x" * 30, "\r\n", "end"]
    rows = []
    for i in range(n):
        over = {"Rndrng_NPI": str(i)}
        for c in r.sample(STAGING_COLUMNS[1:], 6):
            if c != "Rndrng_Prvdr_State_Abrvtn":
                over[c] = r.choice([None, "", "plain", "".join(r.choices(bits, k=r.randrange(1, 8)))])
        rows.append(_line(**over))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_random_quoted_newlines_equal_the_unsplit_reader(spark, scratch, small_splits, seed):
    p = os.path.join(scratch, "x.csv")
    rows = _random_rows(seed, 120)
    _write(p, rows)
    want = sorted(tuple(r[c] for c in STAGING_COLUMNS) for r in rows)
    key = lambda t: tuple((v is not None, v or "") for v in t)
    for size in ("700", "4k", "1m"):  # records cross many borders, some, none
        small_splits(size)
        df = staging.read_staging(spark, p)
        assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
        if size == "700":
            assert df.rdd.getNumPartitions() > 10
    assert_same(df, staging.read_staging(spark, p, multi_line=True))


def test_a_field_that_spans_whole_splits(spark, scratch, small_splits):
    p = os.path.join(scratch, "long.csv")
    long_text = "\n".join(f"line {i}" for i in range(2000))  # no quote in many splits
    _write(p, [_line(Rndrng_NPI="1"), _line(Rndrng_NPI="2", HCPCS_Desc=long_text), _line(Rndrng_NPI="3")])
    small_splits("1k")
    got = {r["Rndrng_NPI"]: r["HCPCS_Desc"] for r in staging.read_staging(spark, p).collect()}
    assert got == {"1": "Office visit", "2": long_text, "3": "Office visit"}


def test_carriage_returns_blank_lines_and_several_files(spark, scratch, small_splits):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    for f in range(3):
        with open(os.path.join(src, f"{f}.csv"), "w", encoding="utf-8", newline="") as fh:
            fh.write("\r\n" + HEADER + "\r\n")
            for i in range(20):
                r = _line(Rndrng_NPI=str(100 * f + i), HCPCS_Desc="two\r\nlines" if i % 3 else "one")
                fh.write(",".join(_csv_field(r[c]) for c in STAGING_COLUMNS) + "\r\n" + ("\r\n" if i % 5 == 0 else ""))
    for size in ("600", "1m"):
        small_splits(size)
        got = {(r["Rndrng_NPI"], r["HCPCS_Desc"], r["Avg_Mdcr_Stdzd_Amt"]) for r in staging.read_staging(spark, src).collect()}
        assert got == {(str(100 * f + i), "two\r\nlines" if i % 3 else "one", "72.00") for f in range(3) for i in range(20)}


@pytest.mark.parametrize("n_fields", [27, 29])
def test_malformed_record_among_multi_line_ones_raises(spark, scratch, small_splits, n_fields):
    p = os.path.join(scratch, "bad.csv")
    other = _line(Rndrng_NPI="2", Rndrng_Prvdr_State_Abrvtn="WI", HCPCS_Desc="two\nlines")
    fields = ([_csv_field(other[c]) for c in STAGING_COLUMNS] + ["extra"])[:n_fields]
    _write(p, [_line(HCPCS_Desc="a\nb") for _ in range(30)], raw_lines=[",".join(fields)])
    small_splits("600")
    with pytest.raises(Exception, match="malformed extract line"):
        loaders.load_star(staging.read_staging(spark, p), "IL")


def test_bad_bytes_and_open_quotes_raise(spark, scratch, small_splits):
    p = os.path.join(scratch, "enc.csv")
    _write(p, [_line(HCPCS_Desc="two\nlines")])
    with open(p, "ab") as fh:
        fh.write(b"SM\xffITH\n")
    small_splits("300")
    with pytest.raises(staging.ExtractError, match="UTF-8"):
        staging.read_staging(spark, p)
    q = os.path.join(scratch, "open.csv")
    _write(q, [_line()], raw_lines=['1,"never closed'])
    with pytest.raises(staging.ExtractError, match="never closed"):
        staging.read_staging(spark, q)


def test_states_are_composed_in_block_order():
    blocks = [("b", 0, 2), ("a", 200, 0), ("a", 0, 1), ("a", 100, 0), ("a", 300, 2), ("a", 400, 1)]
    got = records.compose(blocks)
    assert got == {("a", 0): (False, -1), ("a", 100): (True, 0), ("a", 200): (True, 0), ("a", 300): (True, 0), ("a", 400): (True, 300), ("b", 0): (False, -1)}
    assert records.unfinished(blocks) == [] and records.unfinished([("a", 0, 1)]) == ["a"]


def test_changed_splits_are_refused(spark, scratch, small_splits):
    p = os.path.join(scratch, "x.csv")
    _write(p, [_line(Rndrng_NPI=str(i), HCPCS_Desc="a\nb") for i in range(50)])
    small_splits("700")
    df = staging.read_staging(spark, p)
    small_splits("555")
    with pytest.raises(Exception, match="splits of .* changed"):
        df.collect()
