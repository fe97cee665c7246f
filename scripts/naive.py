"""Plain forms of the nine report queries: join the facts first, group by every
attribute, use window functions over whole groups. The bench times them beside
the shaped plans, and tests compare the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions import exprs as X
from claimlens.plans.base import Star

def _paid(column: str):
    return F.sum(F.col("tot_srvcs") * F.col(column))


def _grouped(star: Star, *by: str) -> DataFrame:
    facts = star.utilization.join(star.codes if by[0] == "hcpcs_cd" else star.providers, "hcpcs_cd" if by[0] == "hcpcs_cd" else "npi")
    return facts.groupBy(*by).agg(
        F.count_distinct("npi").alias("n_npi"), F.count_distinct("hcpcs_cd").alias("n_code"), F.sum("tot_srvcs").alias("srv"),
        F.sum("tot_benes").alias("ben"), _paid("avg_medicare_payment").alias("pay"),
        _paid("avg_medicare_allowed").alias("alw"), _paid("avg_submitted_charge").alias("sub"), _paid("avg_medicare_standardized").alias("std"))


def _cols(df: DataFrame, keep: list[str], **new) -> DataFrame:
    volume = {"total_services": F.col("srv"), "total_beneficiaries": F.col("ben")}
    return df.select(*keep, *[c.alias(n) for n, c in {**volume, **new}.items()])


def _money(c: str):
    return F.round(c, 2)


def specialty_spend(star: Star) -> DataFrame:
    return _cols(_grouped(star, "provider_type").withColumnRenamed("provider_type", "specialty"), ["specialty"],
                 provider_count=F.col("n_npi"), total_medicare_payment=_money("pay"), total_medicare_allowed=_money("alw"),
                 total_submitted_charges=_money("sub"), pct_allowed_paid_by_medicare=X.ratio("pay", "alw", 1, times=100))


def specialty_unit_cost(star: Star) -> DataFrame:
    return _cols(_grouped(star, "provider_type").withColumnRenamed("provider_type", "specialty"), ["specialty"],
                 provider_count=F.col("n_npi"), avg_payment_per_service=X.ratio("pay", "srv"), avg_allowed_per_service=X.ratio("alw", "srv"),
                 avg_standardized_per_service=X.ratio("std", "srv"), avg_payment_per_beneficiary=X.ratio("pay", "ben"))


_PERSON = ["npi", "provider_type", "first_name", "last_org_name", "city", "credentials", "medicare_participates", "entity_type", "zip5"]


def _people(star: Star) -> DataFrame:
    return _grouped(star, *_PERSON).withColumnRenamed("provider_type", "specialty")


def provider_outliers(star: Star) -> DataFrame:
    field = Window.partitionBy("specialty")
    df = _people(star).withColumn("own", X.ratio("pay", "srv")).withColumn(
        "usual", X.ratio(F.sum("pay").over(field), F.sum("srv").over(field)))
    df = df.withColumn("gap", F.col("own") - F.col("usual")).withColumn("pct", X.ratio("gap", "usual", 1, times=100)) \
        .withColumn("place", F.rank().over(field.orderBy(F.col("own").desc_nulls_first())).cast("bigint"))
    return _cols(df.where("abs(pct) > 50 and srv >= 10"), ["specialty", "npi", "credentials", "city"],
                 provider_name=X.full_name("first_name", "last_org_name"), specialty_rank=F.col("place"), total_payment=_money("pay"),
                 provider_pay_per_svc=F.col("own"), specialty_avg_pay_per_svc=F.col("usual"), deviation_from_avg=F.col("gap"),
                 pct_deviation=F.col("pct"), outlier_flag=X.outlier_flag("pct", 50))


def top_procedures(star: Star, k: int = 25) -> DataFrame:
    df = _grouped(star, "hcpcs_cd", "hcpcs_desc", "drug_indicator").withColumn("total", _money("pay"))
    order = Window.orderBy(F.col("total").desc_nulls_first())
    df = df.withColumn("place", F.rank().over(order).cast("bigint")).withColumn("run", F.sum("total").over(order)) \
        .withColumn("all", F.sum("total").over(Window.partitionBy()))
    return _cols(df.orderBy("place", "hcpcs_cd").limit(k), ["hcpcs_cd", "hcpcs_desc"], cost_rank=F.col("place"),
                 code_type=X.code_type("drug_indicator", X.DRUG_LABEL_RANKING), provider_count=F.col("n_npi"), total_payment=F.col("total"),
                 avg_payment_per_svc=X.ratio("pay", "srv"), cumulative_pct_of_spend=X.ratio("run", "all", 1, times=100, guard=False))


def _spread(star: Star) -> tuple[DataFrame, DataFrame]:
    people = _people(star).withColumn("each", X.ratio("pay", "ben")).where("ben >= 10")
    q = [F.percentile("each", p).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    stats = people.groupBy("specialty").agg(F.count("*").alias("n"), F.sum("each").alias("s"), F.count("each").alias("c"),
                                            F.min("each").alias("low"), F.max("each").alias("high"), *X.stddev_parts("each"), *q)
    stats = stats.select("specialty", F.col("n").alias("provider_count"), X.ratio("s", "c").alias("mean"), X.stddev_rounded().alias("sd"),
                         _money("low").alias("low"), _money("high").alias("high"), *[X.round_stat(x).alias(x) for x in ("q1", "q2", "q3")])
    return people, stats


def specialty_distribution(star: Star) -> DataFrame:
    names = {"mean": "mean", "sd": "stddev", "low": "min", "high": "max", "q1": "p25", "q2": "median", "q3": "p75"}
    return _spread(star)[1].select("specialty", "provider_count", *[F.col(a).alias(f"{b}_pay_per_bene") for a, b in names.items()])


def provider_efficiency(star: Star) -> DataFrame:
    people, stats = _spread(star)
    df = people.join(stats, "specialty")
    return _cols(df, ["specialty", "npi", "city", "medicare_participates"], provider_name=X.full_name("first_name", "last_org_name"),
                 distinct_procedures=F.col("n_code"), srvcs_per_beneficiary=X.ratio("srv", "ben"), payment_per_beneficiary=F.col("each"),
                 charge_to_payment_ratio=X.ratio("sub", "pay"), specialty_mean=F.col("mean"), specialty_median=F.col("q2"),
                 specialty_stddev=F.col("sd"), specialty_p25=F.col("q1"), specialty_p75=F.col("q3"),
                 z_score=X.ratio(F.col("each") - F.col("mean"), "sd"), efficiency_tier=X.efficiency_tier("each", "q1", "q3"))


def _rates() -> dict:
    return {"avg_payment_per_svc": X.ratio("pay", "srv"), "avg_payment_per_bene": X.ratio("pay", "ben")}


def vw_specialty_summary(star: Star) -> DataFrame:
    return _cols(_grouped(star, "provider_type").withColumnRenamed("provider_type", "specialty"), ["specialty"],
                 provider_count=F.col("n_npi"), distinct_procedures=F.col("n_code"), total_submitted=_money("sub"), total_allowed=_money("alw"),
                 total_payment=_money("pay"), total_standardized=_money("std"), charge_to_payment_ratio=X.ratio("sub", "pay"), **_rates())


def vw_procedure_summary(star: Star) -> DataFrame:
    return _cols(_grouped(star, "hcpcs_cd", "hcpcs_desc", "drug_indicator"), ["hcpcs_cd", "hcpcs_desc"],
                 code_type=X.code_type("drug_indicator", X.DRUG_LABEL_SUMMARY), provider_count=F.col("n_npi"),
                 total_payment=_money("pay"), total_allowed=_money("alw"), **_rates())


def vw_provider_kpi(star: Star) -> DataFrame:
    return _cols(_people(star), ["npi", "credentials", "entity_type", "city", "zip5", "specialty", "medicare_participates"],
                 provider_name=X.display_name("entity_type", "first_name", "last_org_name"), distinct_procedures=F.col("n_code"),
                 total_payment=_money("pay"), total_allowed=_money("alw"), total_submitted=_money("sub"),
                 srvcs_per_beneficiary=X.ratio("srv", "ben"), charge_to_payment_ratio=X.ratio("sub", "pay"), **_rates())


NAIVE = {f.__name__: f for f in (specialty_spend, specialty_unit_cost, provider_outliers, top_procedures, specialty_distribution,
                                 provider_efficiency, vw_specialty_summary, vw_procedure_summary, vw_provider_kpi)}
