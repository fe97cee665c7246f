"""Constraint checks (C16-C19) find what PostgreSQL would have rejected."""

from decimal import Decimal as D

from claimlens.operators import quality
from claimlens.plans.base import Star
from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA


def _p(npi, last="X", state="IL"):
    return (npi, last, "F", None, None, "I", "1 ST", None, "C", state, 17, "60601", None, None, "US", "S", "Y")


def _u(npi, code):
    return (npi, code, "O", 1, D("1.00"), D("1.00"), D("1.00"), D("1.00"), D("1.00"), D("1.00"))


def _star(spark, providers, codes, facts, nullable=False):
    u_schema = UTILIZATION_SCHEMA
    if nullable:
        from pyspark.sql import types as T
        u_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in UTILIZATION_SCHEMA.fields])
    from pyspark.sql import types as T
    p_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in PROVIDERS_SCHEMA.fields])
    c_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in CODES_SCHEMA.fields])
    return Star(spark.createDataFrame(providers, p_schema), spark.createDataFrame(codes, c_schema),
                spark.createDataFrame(facts, u_schema))


def _report(star):
    return {(r.table_name, r.check_name, r.column_name): r for r in quality.quality_report(star).collect()}


def test_clean_star_has_no_violations(spark):
    star = _star(spark, [_p(1), _p(2)], [("A", "a", "N")], [_u(1, "A"), _u(2, "A")])
    rep = _report(star)
    assert rep[("providers", "unique", "npi")].violations == 0
    assert rep[("utilization", "references", "npi")].violations == 0
    assert rep[("utilization", "references", "hcpcs_cd")].violations == 0
    assert rep[("utilization", "not_null", "npi")].violations == 0
    assert rep[("providers", "length", "state")].max_length == 2


def test_violations_are_counted_and_listed(spark):
    star = _star(
        spark,
        [_p(1), _p(1, "DUP"), _p(None), _p(3, "Y" * 101, state="ILL")],
        [("A", "a", "N"), ("A", "b", "N"), ("TOO_LONG_CODE", "c", "YY")],
        [_u(1, "A"), _u(7, "A"), _u(1, "Q"), _u(None, "A"), _u(1, None)],
        nullable=True)
    rep = _report(star)
    assert rep[("providers", "unique", "npi")].violations == 2          # npi 1 twice + one NULL key
    assert rep[("hcpcs_codes", "unique", "hcpcs_cd")].violations == 1
    assert rep[("utilization", "references", "npi")].violations == 1    # 7 (NULL is not an orphan)
    assert rep[("utilization", "references", "hcpcs_cd")].violations == 1  # Q
    assert rep[("utilization", "not_null", "npi")].violations == 1
    assert rep[("utilization", "not_null", "hcpcs_cd")].violations == 1
    assert rep[("providers", "length", "last_org_name")].violations == 1
    assert rep[("providers", "length", "last_org_name")].max_length == 101
    assert rep[("providers", "length", "state")].violations == 1
    assert rep[("hcpcs_codes", "length", "hcpcs_cd")].violations == 1
    assert rep[("hcpcs_codes", "length", "drug_indicator")].violations == 1
    # detail functions return the offending rows
    assert [r.npi for r in quality.orphans(star.utilization, star.providers, "npi").collect()] == [7]
    assert sorted(r.npi for r in quality.duplicate_keys(star.providers, ["npi"]).collect()) == [1]
    assert quality.too_long(star.providers, {"last_org_name": 100}).count() == 1


def test_report_scans_each_table_a_few_times(spark, scratch):
    from claimlens.sources import sinks
    star = _star(spark, [_p(1), _p(2)], [("A", "a", "N")], [_u(1, "A"), _u(2, "A")])
    sinks.write_star(star, scratch + "/star", with_rollups=False)
    report = quality.quality_report(sinks.read_star(spark, scratch + "/star"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8
    assert all(r.violations == 0 for r in report.collect())
