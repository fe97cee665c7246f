"""Views through SQL over the published version, ordered exports in parts, collated text order."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from claimlens.jobs import load_job
from claimlens.operators import kpis, summaries
from claimlens.plans.base import specialty_codes
from claimlens.plans.materialize import small_partitions
from claimlens.sources import loaders, sinks
from tests.conftest import assert_same
from tests.test_sources import _line, _stg, _write


def test_a_later_load_shows_through_the_views(spark, scratch):
    root = os.path.join(scratch, "star")
    views = summaries.PublishedViews(spark, root)
    with pytest.raises(FileNotFoundError):
        views.sql("select 1")
    for name, lines in (("a", [_line()]), ("b", [_line(), _line(Rndrng_NPI="2", HCPCS_Cd="B2", Rndrng_Prvdr_Type="Zoology")])):
        _write(os.path.join(scratch, name), lines)
        load_job(spark, os.path.join(scratch, name), root)
        star = sinks.read_star(spark, root)
        for view, fn in summaries.VIEWS.items():
            assert_same(views.sql(f"select * from {view}"), fn(star))
        got = views.sql("select s.specialty, p.npi from vw_specialty_summary s join vw_provider_kpi p on p.specialty = s.specialty order by p.npi").collect()
        assert [tuple(r) for r in got] == [("Zoology", 2), ("Cardiology", 1000000001)][0 if name == "b" else 1:]
        assert views.sql("select count(*) from utilization u join providers using (npi) join hcpcs_codes using (hcpcs_cd)").first()[0] == len(lines)


def _star(spark, n):
    return loaders.load_star(_stg(spark, [_line(Rndrng_NPI=str(i), HCPCS_Cd=f"C{i:04d}", Tot_Srvcs=str(1 + (i * 37) % 91),
                                                Rndrng_Prvdr_Last_Org_Name='A"B, C') for i in range(n)]), stage=False)


def test_parts_in_manifest_order_are_the_ordered_view(spark, scratch):
    star = _star(spark, 600)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = summaries.export_views(star, os.path.join(scratch, "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name in ("vw_procedure_summary", "vw_provider_kpi"):
        parts = sinks.exported_parts(spark, paths[name])
        assert len(parts) > 1  # no single task wrote it
        want = [[str(v) if v is not None else "" for v in r] for r in summaries.VIEWS[name](star).orderBy(*summaries.view_order(name)).collect()]
        got = [row for p in parts for row in list(csv.reader(open(p, encoding="utf-8", newline="")))[1:]]
        assert got == want
        whole = os.path.join(scratch, f"{name}.csv")
        sinks.join_parts(spark, paths[name], whole, chunk=100)
        lines = list(csv.reader(open(whole, encoding="utf-8", newline="")))
        assert lines == [summaries.VIEWS[name](star).columns, *want]
    assert len(sinks.exported_parts(spark, paths["vw_specialty_summary"])) == 1


def test_text_order_by_collation(spark):
    names = ["zebra", "Äpfel", "apple", "Zoo", "éclair", "Eagle", "apfel", None]
    rows = [_line(Rndrng_NPI=str(10 * k + i), Rndrng_Prvdr_Type=t, Avg_Mdcr_Pymt_Amt=str(10 + 90 * i)) for k, t in enumerate(names, 1) for i in range(3)]
    star = loaders.load_star(_stg(spark, rows), stage=False)

    def order(df):
        seen = [r["specialty"] for r in df.collect()]
        return [t for i, t in enumerate(seen) if i == 0 or seen[i - 1] != t]

    icu = ["apfel", "Äpfel", "apple", "Eagle", "éclair", "zebra", "Zoo"]
    binary = sorted((n for n in names if n), key=lambda t: t.encode())
    for fn in (kpis.provider_outliers, kpis.provider_efficiency):
        tail = [None] if fn is kpis.provider_outliers else []
        assert order(fn(star)) == binary + tail
        assert order(fn(star, collation="UNICODE")) == icu + tail
        assert_same(fn(star), fn(star, collation="UNICODE"))
    assert [c for c in order(summaries.vw_specialty_summary(star).orderBy(F.col("total_payment").desc(), summaries.text_order("specialty", "UNICODE")))] == icu + [None]


def _broadcast_scans(df):
    """The file scans of a plan whose rows pass through the driver to be broadcast."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [a for a in above if a < depth]
        if "BroadcastExchange" in line:
            above.append(depth)
        elif "FileScan" in line and above:
            found.append(line.strip(" :+-*"))
    return found


def test_providers_are_joined_without_a_broadcast(spark, scratch):
    sinks.write_star(_star(spark, 60), scratch)
    star = sinks.read_star(spark, scratch)
    for df, rows in ((summaries.vw_provider_kpi(star), 60), (specialty_codes(star.utilization, star.providers), 60)):
        assert _broadcast_scans(df) == []  # tables of any number of rows, small as files
        assert df.count() == rows


def test_codes_are_joined_without_a_broadcast(spark, scratch):
    sinks.write_star(_star(spark, 60), scratch)
    df = summaries.vw_procedure_summary(sinks.read_star(spark, scratch))
    assert _broadcast_scans(df) == []
    assert df.count() == 60


def test_specialty_view_exports_without_a_broadcast_of_providers(spark, scratch):
    sinks.write_star(_star(spark, 60), os.path.join(scratch, "star"))
    star = sinks.read_star(spark, os.path.join(scratch, "star"))
    view = summaries.vw_specialty_summary(star)
    assert not [scan for scan in _broadcast_scans(view) if "npi" in scan]  # roll-ups of a row a specialty may be
    path = summaries.export_views(star, os.path.join(scratch, "out"))["vw_specialty_summary"]
    (part,) = sinks.exported_parts(spark, path)
    (row,) = csv.DictReader(open(part, encoding="utf-8", newline=""))
    assert (row["provider_count"], row["distinct_procedures"]) == ("60", "60")


def test_sql_specialty_view_without_a_broadcast_of_providers(spark, scratch):
    sinks.write_star(_star(spark, 60), scratch)
    df = summaries.PublishedViews(spark, scratch).sql("select * from vw_specialty_summary")
    assert not [scan for scan in _broadcast_scans(df) if "npi" in scan]
    (row,) = df.collect()
    assert (row["provider_count"], row["distinct_procedures"]) == (60, 60)


def test_small_partitions_leave_the_session_as_it_was(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)  # other tests of the session may have set it
    try:
        for own, inside in ((None, "16m"), ("256m", "16m"), ("8m", "8m")):
            spark.conf.set(key, own) if own else spark.conf.unset(key)
            with pytest.raises(ZeroDivisionError), small_partitions(spark):
                assert spark.conf.get(key) == inside
                1 / 0
            assert spark.conf.get(key, None) == own
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
