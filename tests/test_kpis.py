"""KPI and view operators on a hand-made star with every edge case of
FIXTURES.md section 4, checked against plain forms and hand-computed values."""

from decimal import Decimal as D

import pytest

from __spark_entry__ import edge
from claimlens.operators import kpis, summaries
from claimlens.plans.base import Star, roll_up, specialty_codes
from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA
from scripts.naive import NAIVE
from tests.conftest import assert_same


def _prov(npi, specialty, first="F", last=None, etype="I", cred="MD"):
    return (npi, last or f"LAST{npi}", first, None, cred, etype, "1 ST", None, "CITY", "IL", 17, "60601",
            D("1.0"), "Metro", "US", specialty, "Y")


def _fact(npi, code, srv, pay, benes=12, alw=None, sub=None, std=None):
    srv = None if srv is None else D(srv)
    pay = None if pay is None else D(pay)
    alw = D(alw) if alw is not None else (pay * 2 if pay is not None else D("1.00"))
    sub = D(sub) if sub is not None else (pay * 3 if pay is not None else D("3.00"))
    std = D(std) if std is not None else (pay if pay is not None else D("1.00"))
    return (npi, code, "O", benes, srv, srv, sub, alw, pay, std)


@pytest.fixture(scope="module")
def edge_star(spark):
    providers = [
        _prov(1, "CARD"), _prov(2, "CARD"), _prov(3, "CARD", first=None),
        _prov(4, "CARD"), _prov(5, "CARD"), _prov(6, "CARD", etype="O"),
        _prov(7, None, etype=None),
        _prov(8, "ONE"), _prov(9, "LOW"),
        _prov(10, "EDGE"), _prov(11, "EDGE"), _prov(12, "EDGE"),
    ]
    facts = [
        _fact(1, "A", "20", "100.00"), _fact(2, "A", "20", "100.00"),
        _fact(3, "B", "10", "300.00", benes=10),              # exactly 10 services / beneficiaries
        _fact(4, "A", "15", None), _fact(4, "B", "5", None),  # all payments NULL
        _fact(5, "A", "0", "80.00"),                          # zero services
        _fact(6, "A", "5", None), _fact(6, "C", "5", "50.00"),  # one NULL payment among two
        _fact(7, "C", "12", "40.00"),
        _fact(8, "A", "30", "60.00", benes=15),
        _fact(9, "A", "30", "60.00", benes=5),
        _fact(10, "A", "10", "150.00"), _fact(11, "A", "10", "50.00"), _fact(12, "B", "10", "100.00"),
        _fact(999, "A", "10", "10.00"), _fact(1, "ZZZ", "10", "10.00"),  # orphans: dropped by joins
        _fact(2, "A", "3", "100.00", benes=None),              # duplicate provider x code line
    ]
    codes = [("A", "Visit", "N"), ("B", "Drug", "Y"), ("C", "Other", None)]
    return Star(spark.createDataFrame(providers, PROVIDERS_SCHEMA),
                spark.createDataFrame(codes, CODES_SCHEMA),
                spark.createDataFrame(facts, UTILIZATION_SCHEMA))


SHAPED = {
    "specialty_spend": kpis.specialty_spend,
    "specialty_unit_cost": kpis.specialty_unit_cost,
    "provider_outliers": kpis.provider_outliers,
    "top_procedures": lambda s: kpis.top_procedures(s, 2),
    "specialty_distribution": kpis.specialty_distribution,
    "provider_efficiency": kpis.provider_efficiency,
    "vw_specialty_summary": summaries.vw_specialty_summary,
    "vw_procedure_summary": summaries.vw_procedure_summary,
    "vw_provider_kpi": summaries.vw_provider_kpi,
}


@pytest.fixture(scope="module")
def rolled(edge_star):
    u = edge_star.utilization
    return Star(edge_star.providers, edge_star.codes, u, roll_up(u, "npi"), roll_up(u, "hcpcs_cd"), specialty_codes(u, edge_star.providers))


@pytest.mark.parametrize("name", sorted(NAIVE))
def test_shaped_equals_naive_on_edge_cases(edge_star, name):
    naive = NAIVE[name](edge_star, 2) if name == "top_procedures" else NAIVE[name](edge_star)
    assert_same(edge(SHAPED[name](edge_star)), edge(naive))


@pytest.mark.parametrize("name", sorted(NAIVE))
def test_stored_rollups_give_identical_results(edge_star, rolled, name):
    assert_same(edge(SHAPED[name](rolled)), edge(SHAPED[name](edge_star)))


@pytest.mark.parametrize("name", sorted(NAIVE))
def test_salted_joins_give_identical_results(edge_star, monkeypatch, name):
    """Beyond the broadcast bound specialty tables are attached by a salted join."""
    want = SHAPED[name](edge_star)
    rows = sorted(want.collect(), key=str)  # not every query has an order
    monkeypatch.setattr("claimlens.plans.materialize.DEFAULT_BROADCAST_ROWS", 0)
    assert sorted(SHAPED[name](edge_star).collect(), key=str) == rows


def test_plans_gather_no_group_in_one_task(rolled):
    """No window by bare specialty, and no code list in a single partition."""
    for name in ("provider_outliers", "provider_efficiency", "specialty_distribution"):
        plan = SHAPED[name](rolled)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_slice" in line or "_bn" in line or "_bk" in line, line
    plan = kpis.top_procedures(rolled)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_outliers_edge_cases(edge_star):
    rows = {r.npi: r for r in kpis.provider_outliers(edge_star).collect()}
    # 4 (all NULL pay) and 5 (0 services) have NULL price: rank 1 ahead of everyone, never reported
    assert set(rows) == {3, 6}
    assert rows[6].outlier_flag == "LOW OUTLIER" and rows[6].specialty_rank == 6
    r = rows[3]
    assert r.specialty_rank == 3 and r.outlier_flag == "HIGH OUTLIER"
    assert r.provider_name == " LAST3"            # NULL first name -> leading space
    assert r.total_services == D("10.00")          # exactly 10 services is kept
    # EDGE: +50.0 % and -50.0 % exactly are not outliers
    assert all(x.specialty != "EDGE" for x in rows.values())


def test_partial_null_payment_keeps_services(edge_star):
    pm = {r.npi: r for r in kpis.provider_metrics(edge_star).collect()}
    assert pm[6].provider_pay_per_svc == D("25.00")   # 250 / 10, NULL payment's 5 services stay
    assert pm[4].provider_pay_per_svc is None and pm[5].provider_pay_per_svc is None
    assert pm[7].specialty is None and pm[7].specialty_avg_pay_per_svc == D("40.00")


def test_null_specialty_in_tables_but_not_in_efficiency(edge_star):
    assert None in [r.specialty for r in kpis.specialty_spend(edge_star).collect()]
    assert None in [r.specialty for r in summaries.vw_specialty_summary(edge_star).collect()]
    eff = kpis.provider_efficiency(edge_star).collect()
    assert all(r.specialty is not None for r in eff)
    assert {r.specialty for r in eff} == {"CARD", "ONE", "EDGE"}   # LOW has nobody at 10 beneficiaries


def test_one_provider_specialty(edge_star):
    one = [r for r in kpis.provider_efficiency(edge_star).collect() if r.specialty == "ONE"][0]
    assert one.specialty_stddev is None and one.z_score is None
    assert one.efficiency_tier == "Within IQR (Typical)"
    dist = {r.specialty: r for r in kpis.specialty_distribution(edge_star).collect()}
    assert dist["ONE"].provider_count == 1 and dist["ONE"].median_pay_per_bene == D("120.00")


def test_code_labels_differ_between_ranking_and_view(edge_star):
    top = {r.hcpcs_cd: r.code_type for r in kpis.top_procedures(edge_star, 10).collect()}
    view = {r.hcpcs_cd: r.code_type for r in summaries.vw_procedure_summary(edge_star).collect()}
    assert top["B"] == "Part B Drug (ASP-based)" and view["B"] == "Part B Drug"
    assert top["C"] == view["C"] == "Professional Service"


def test_provider_kpi_names(edge_star):
    names = {r.npi: r.provider_name for r in summaries.vw_provider_kpi(edge_star).collect()}
    assert names[1] == "F LAST1" and names[6] == "LAST6" and names[7] == "LAST7"


def test_all_zero_spend_raises_like_reference(spark, edge_star):
    zero = edge_star.utilization.withColumn("avg_medicare_payment", edge_star.utilization.tot_srvcs * 0)
    star = Star(edge_star.providers, edge_star.codes, zero)
    with pytest.raises(Exception):
        kpis.top_procedures(star).collect()


def test_views_register(spark, edge_star):
    names = summaries.register_views(spark, edge_star)
    assert spark.table("vw_specialty_summary").count() == 5
    assert set(names) == set(summaries.VIEWS)


def test_export_views(spark, edge_star, scratch):
    import os
    paths = summaries.export_views(edge_star, os.path.join(scratch, "export"))
    assert set(paths) == set(summaries.VIEWS)
    spec = [f for f in os.listdir(paths["vw_specialty_summary"]) if f.endswith(".csv")]
    assert len(spec) == 1
    back = spark.read.option("header", "true").csv(paths["vw_provider_kpi"])
    assert back.count() == summaries.vw_provider_kpi(edge_star).count()
    pays = [float(r.total_payment) if r.total_payment is not None else None
            for r in spark.read.option("header", "true").csv(paths["vw_procedure_summary"]).collect()]
    assert pays == sorted(pays, key=lambda p: (p is not None, -(p or 0)))   # NULL first, then descending


def test_percentile_fixture_through_the_distribution(spark):
    # payment per beneficiary 1.00, 1.01, 3.00, 8.07 and NULL in one specialty
    pe = spark.createDataFrame(
        [("S", 20, D("1.00")), ("S", 20, D("1.01")), ("S", 20, D("3.00")), ("S", 20, D("8.07")),
         ("S", 20, None)],
        "specialty string, total_beneficiaries bigint, payment_per_beneficiary decimal(38,2)")
    providers = spark.createDataFrame([_prov(i, "S") for i in range(5)], PROVIDERS_SCHEMA)
    star = Star(providers, None, None)
    r = kpis.specialty_distribution_of(pe, star).collect()[0]
    assert r.provider_count == 5
    assert (r.mean_pay_per_bene, r.stddev_pay_per_bene) == (D("3.27"), D("3.34"))
    assert (r.median_pay_per_bene, r.p25_pay_per_bene, r.p75_pay_per_bene) == (D("2.01"), D("1.01"), D("4.27"))
    assert (r.min_pay_per_bene, r.max_pay_per_bene) == (D("1.00"), D("8.07"))


def test_exactly_ten_beneficiaries_is_kept(edge_star):
    eff = {r.npi for r in kpis.provider_efficiency(edge_star).collect()}
    assert 3 in eff          # 10 beneficiaries exactly
    assert 9 not in eff      # 5 beneficiaries
