"""End-to-end: extract CSV -> load job -> report job, and the command line."""

import os

import pytest

from claimlens import __main__ as cli
from claimlens.jobs import KPI_QUERIES, LoadError, load_job, report_job
from claimlens.operators.summaries import VIEWS
from claimlens.sources import sinks
from tests.test_sources import _line, _write


def _extract(path):
    rows = []
    for npi, spec, pay in [(1, "CARD", "100.00"), (2, "CARD", "120.00"), (3, "CARD", "400.00"),
                           (4, "DERM", "50.00"), (5, "DERM", "55.00")]:
        for code in ["A1", "B2"]:
            rows.append(_line(Rndrng_NPI=str(npi), Rndrng_Prvdr_Type=spec, HCPCS_Cd=code,
                              Avg_Mdcr_Pymt_Amt=pay, Tot_Srvcs="20", Tot_Benes="12"))
    rows.append(_line(Rndrng_NPI="9", Rndrng_Prvdr_State_Abrvtn="WI"))
    _write(path, rows)


def test_load_then_report(spark, scratch):
    src = os.path.join(scratch, "extract.csv")
    _extract(src)
    star_root = os.path.join(scratch, "star")
    checks = load_job(spark, src, star_root)
    assert checks and not any(checks.values())
    out = report_job(spark, star_root, os.path.join(scratch, "report"))
    assert set(out) == set(KPI_QUERIES) | set(VIEWS)
    spend = spark.read.parquet(out["specialty_spend"]).collect()
    assert {r.specialty: r.provider_count for r in spend} == {"CARD": 3, "DERM": 2}
    outliers = spark.read.parquet(out["provider_outliers"]).collect()
    # CARD mean 206.67: 400 is +93.5 %, 100 is -51.6 %, 120 stays inside
    assert {(r.npi, r.outlier_flag) for r in outliers} == {(3, "HIGH OUTLIER"), (1, "LOW OUTLIER")}


@pytest.mark.parametrize("bad", [
    [{"Rndrng_NPI": "1"}, {"Rndrng_NPI": "01"}],   # one key from two texts
    [{"Rndrng_Prvdr_Zip5": "60601-1234"}],         # over its length
    [{"HCPCS_Cd": None}],                          # no code
])
def test_a_violating_load_publishes_nothing(spark, scratch, bad):
    good, wrong = os.path.join(scratch, "good.csv"), os.path.join(scratch, "wrong.csv")
    _write(good, [_line()])
    _write(wrong, [_line(**b) for b in bad])
    root = os.path.join(scratch, "star")
    load_job(spark, good, root)
    with pytest.raises(LoadError, match="violates"):
        load_job(spark, wrong, root)
    assert [r.npi for r in sinks.read_star(spark, root).providers.collect()] == [1000000001]


def test_a_second_load_keeps_the_known_codes(spark, scratch):
    root = os.path.join(scratch, "star")
    for name, lines in (("a", [_line(HCPCS_Cd="A1", HCPCS_Desc="old")]), ("b", [_line(HCPCS_Cd="A1", HCPCS_Desc="new"), _line(HCPCS_Cd="B2")])):
        _write(os.path.join(scratch, name), lines)
        load_job(spark, os.path.join(scratch, name), root)
    star = sinks.read_star(spark, root)
    assert {r.hcpcs_cd: r.hcpcs_desc for r in star.codes.collect()} == {"A1": "old", "B2": "Office visit"}
    assert star.utilization.count() == 2


def test_command_line(spark, scratch, capsys):
    src = os.path.join(scratch, "extract.csv")
    _extract(src)
    star_root = os.path.join(scratch, "star")
    cli.main(["load", "--extract", src, "--star", star_root])
    cli.main(["report", "--star", star_root, "--out", os.path.join(scratch, "rep"), "--format", "csv"])
    printed = capsys.readouterr().out
    assert "specialty_spend" in printed and "providers.unique.npi" in printed
    assert os.path.isdir(os.path.join(scratch, "rep", "vw_provider_kpi"))
