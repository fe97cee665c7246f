"""The five KPI queries (and the two CTEs that are useful on their own).

Plan shape shared by all of them (eager aggregation): facts are reduced to
one row per provider (or per code) *before* the dimension join, so the join
sees one row per key instead of one per fact, and the join reuses the
aggregate's hash partitioning on the key (no second shuffle of facts).

One plan each, whatever the size: specialty totals are attached to providers
by a checked broadcast (salted beyond its bound), ranks and percentiles come
from value slices, and the procedure ranking from a distributed top-k
(:mod:`claimlens.plans.ranking`). No task ever holds a whole specialty or the
whole code list. Inputs are the roll-ups of :class:`claimlens.plans.base.Star`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exprs import (
    DRUG_LABEL_RANKING,
    code_type,
    efficiency_tier,
    full_name,
    outlier_flag,
    ratio,
    round_stat,
    stddev_rounded,
    text_order,
)
from claimlens.plans.base import SUM_COLS, Star
from claimlens.plans.materialize import attach, join_grown, reliable
from claimlens.plans.ranking import distribution, rank_within, top_k_ranked

# Default parameters of the reference analysis.
OUTLIER_PCT = 50        # |% deviation| above which a provider is an outlier
MIN_SERVICES = 10       # minimum services for an outlier to be reported
MIN_BENEFICIARIES = 10  # minimum beneficiaries for the efficiency statistics
TOP_K = 25              # procedures listed in the spend ranking

_PCTS = {"_p50": "0.5", "_p25": "0.25", "_p75": "0.75"}


def provider_totals(star: Star, attrs: list[str]) -> DataFrame:
    """Per-provider sums (+ distinct code count ``n_other``) joined to ``attrs``."""
    totals = star.rollup("npi")
    return join_grown(totals, star.providers.select("npi", *attrs), "npi")


def specialty_totals(star: Star) -> DataFrame:
    """Per-specialty sums; ``provider_count`` = distinct NPIs (one row each)."""
    pt = provider_totals(star, ["provider_type"])
    return pt.groupBy(F.col("provider_type").alias("specialty")).agg(
        F.count(F.lit(1)).alias("provider_count"),
        *[F.sum(c).alias(c) for c in SUM_COLS])


# -- C5 --------------------------------------------------------------------

def specialty_spend(star: Star) -> DataFrame:
    """Spend funnel per specialty (paid, allowed, submitted, % of allowed paid)."""
    t = specialty_totals(star)
    return t.select(
        "specialty", "provider_count",
        F.col("srv").alias("total_services"),
        F.col("benes").alias("total_beneficiaries"),
        F.round("pay", 2).alias("total_medicare_payment"),
        F.round("alw", 2).alias("total_medicare_allowed"),
        F.round("sub", 2).alias("total_submitted_charges"),
        ratio("pay", "alw", 1, times=100).alias("pct_allowed_paid_by_medicare"),
    ).orderBy(F.col("total_medicare_payment").desc_nulls_first(), F.col("specialty").asc_nulls_last())


# -- C6 --------------------------------------------------------------------

def specialty_unit_cost(star: Star) -> DataFrame:
    """Per-service and per-beneficiary payment by specialty."""
    t = specialty_totals(star)
    return t.select(
        "specialty", "provider_count",
        F.col("srv").alias("total_services"),
        F.col("benes").alias("total_beneficiaries"),
        ratio("pay", "srv").alias("avg_payment_per_service"),
        ratio("alw", "srv").alias("avg_allowed_per_service"),
        ratio("std", "srv").alias("avg_standardized_per_service"),
        ratio("pay", "benes").alias("avg_payment_per_beneficiary"),
    ).orderBy(F.col("avg_payment_per_service").desc_nulls_first(), F.col("specialty").asc_nulls_last())


# -- C7 / C8 ---------------------------------------------------------------

def provider_metrics(star: Star) -> DataFrame:
    """Each provider's payment per service beside its specialty's weighted mean
    (the reference's ``SUM(SUM(x)) OVER (PARTITION BY specialty)``)."""
    pt = provider_totals(star, ["first_name", "last_org_name", "credentials", "city", "provider_type"])
    pt = star.settled(pt.withColumnRenamed("provider_type", "specialty"))
    spec = pt.groupBy("specialty").agg(F.sum("pay").alias("_spay"), F.sum("srv").alias("_ssrv"))
    spec = spec.select("specialty", ratio("_spay", "_ssrv").alias("specialty_avg_pay_per_svc"))
    return attach(pt, spec, ["specialty"], star.specialty_profile()[0], ["npi"]).select(
        "npi", "first_name", "last_org_name", "credentials", "city", "specialty",
        F.col("srv").alias("total_services"),
        F.col("benes").alias("total_beneficiaries"),
        F.round("pay", 2).alias("total_payment"),
        ratio("pay", "srv").alias("provider_pay_per_svc"),
        "specialty_avg_pay_per_svc",
    )


def provider_outliers(star: Star, pct_threshold: int = OUTLIER_PCT,
                      min_services: int = MIN_SERVICES, collation: str | None = None) -> DataFrame:
    """Providers whose payment per service deviates > ``pct_threshold`` % from
    their specialty mean, with their rank in the specialty (all providers,
    highest first, NULL first as in PostgreSQL)."""
    pm = provider_metrics(star)
    pps, avg = F.col("provider_pay_per_svc"), F.col("specialty_avg_pay_per_svc")
    # read twice, by the ranks and by the rows: written once, a row a provider
    dev = reliable(pm.select(
        "*",
        F.round(pps - avg, 2).alias("deviation_from_avg"),
        ratio(pps - avg, avg, 1, times=100).alias("pct_deviation"),
    ))
    # ranks of all providers; the filter below reads only ``dev`` columns, so
    # Catalyst applies it before the rank join
    ranked = rank_within(dev, ["specialty"], "provider_pay_per_svc", "specialty_rank")
    out = ranked.where((F.abs("pct_deviation") > F.lit(pct_threshold))
                       & (F.col("total_services") >= F.lit(min_services)))
    return out.select(
        "specialty", F.col("specialty_rank").cast("bigint").alias("specialty_rank"), "npi",
        full_name("first_name", "last_org_name").alias("provider_name"),
        "credentials", "city", "total_services", "total_beneficiaries", "total_payment",
        "provider_pay_per_svc", "specialty_avg_pay_per_svc", "deviation_from_avg", "pct_deviation",
        outlier_flag("pct_deviation", pct_threshold).alias("outlier_flag"),
    ).orderBy(text_order("specialty", collation), F.col("pct_deviation").desc_nulls_first(),
              F.col("npi"))  # tie-breaker: lets the range sort split a tie group


# -- C9 --------------------------------------------------------------------

def procedure_spend(star: Star) -> DataFrame:
    """Per-code totals (the CTE of the procedure ranking)."""
    totals = star.rollup("hcpcs_cd")
    proc = totals.join(star.codes, "hcpcs_cd")
    return proc.select(
        "hcpcs_cd", "hcpcs_desc", "drug_indicator",
        F.col("n_other").alias("provider_count"),
        F.col("benes").alias("total_beneficiaries"),
        F.col("srv").alias("total_services"),
        F.round("pay", 2).alias("total_payment"),
        F.round("alw", 2).alias("total_allowed"),
        F.round("sub", 2).alias("total_submitted"),
        ratio("pay", "srv").alias("avg_payment_per_svc"),
    )


def top_procedures(star: Star, k: int = TOP_K) -> DataFrame:
    """Top ``k`` codes by payment with global rank and cumulative % of spend.

    The share divides by the grand total without a zero guard, as the
    reference does: an all-zero table raises (ANSI) instead of returning rows.
    """
    v = F.col("total_payment")
    # rank and running share from the k rows and two scalars
    top = top_k_ranked(star.settled(procedure_spend(star)), "total_payment", ["hcpcs_cd"], k)
    share = ratio("_run_sum", "_grand", 1, times=100, guard=False)
    return top.select(
        F.col("_rank").alias("cost_rank"),
        "hcpcs_cd", "hcpcs_desc",
        code_type("drug_indicator", DRUG_LABEL_RANKING).alias("code_type"),
        "provider_count", "total_beneficiaries", "total_services", "total_payment",
        "avg_payment_per_svc",
        share.alias("cumulative_pct_of_spend"),
    ).orderBy(v.desc_nulls_first(), F.col("hcpcs_cd"))


# -- C10 / C11 -------------------------------------------------------------

def provider_efficiency_base(star: Star) -> DataFrame:
    """Per-provider efficiency ratios (the CTE used twice by C11)."""
    pt = provider_totals(star, ["first_name", "last_org_name", "city", "provider_type",
                                "medicare_participates"])
    return pt.select(
        "npi", "first_name", "last_org_name", "city",
        F.col("provider_type").alias("specialty"), "medicare_participates",
        F.col("n_other").alias("distinct_procedures"),
        F.col("benes").alias("total_beneficiaries"),
        F.col("srv").alias("total_services"),
        F.round("pay", 2).alias("total_payment"),
        ratio("srv", "benes").alias("srvcs_per_beneficiary"),
        ratio("pay", "benes").alias("payment_per_beneficiary"),
        ratio("sub", "pay").alias("charge_to_payment_ratio"),
    )


def _stat_columns(prefix: str = "") -> list:
    """Rounded statistics from the raw aggregate columns ``_sum`` .. ``_p75``."""
    return [
        ratio("_sum", "_cnt").alias(prefix + "mean_pay_per_bene"),
        stddev_rounded().alias(prefix + "stddev_pay_per_bene"),
        F.round("_min", 2).alias(prefix + "min_pay_per_bene"),
        F.round("_max", 2).alias(prefix + "max_pay_per_bene"),
        round_stat("_p50").alias(prefix + "median_pay_per_bene"),
        round_stat("_p25").alias(prefix + "p25_pay_per_bene"),
        round_stat("_p75").alias(prefix + "p75_pay_per_bene"),
    ]


def specialty_distribution_of(pe: DataFrame, star: Star | None = None, min_beneficiaries: int = MIN_BENEFICIARIES) -> DataFrame:
    """Distribution of payment per beneficiary per specialty (providers with
    at least ``min_beneficiaries``): count, exact mean, sample stddev, min,
    max and exact continuous percentiles, all from one histogram."""
    f = pe.where(F.col("total_beneficiaries") >= F.lit(min_beneficiaries)).select("specialty", "payment_per_beneficiary")
    stats = distribution(f, "specialty", "payment_per_beneficiary", _PCTS)
    return stats.select("specialty", F.col("_rows").alias("provider_count"), *_stat_columns())


def specialty_distribution(star: Star, min_beneficiaries: int = MIN_BENEFICIARIES) -> DataFrame:
    return specialty_distribution_of(provider_efficiency_base(star), star, min_beneficiaries)


def provider_efficiency(star: Star, min_beneficiaries: int = MIN_BENEFICIARIES, collation: str | None = None) -> DataFrame:
    """Each provider's payment per beneficiary against its specialty's
    distribution: z-score and IQR tier. NULL specialty drops out (plain
    equality join in the reference)."""
    pe = star.settled(provider_efficiency_base(star))
    ppb = F.col("payment_per_beneficiary")
    volume = F.col("total_beneficiaries") >= F.lit(min_beneficiaries)
    ss = specialty_distribution_of(pe, star, min_beneficiaries)
    ss = ss.where("specialty is not null").select("specialty", *[
        F.col(c).alias("specialty_" + c) for c in ss.columns if c.endswith("_pay_per_bene")])
    j = attach(pe.where(volume & F.col("specialty").isNotNull()), ss, ["specialty"], star.specialty_profile()[0], ["npi"])
    return j.select(
        "specialty", "npi",
        full_name("first_name", "last_org_name").alias("provider_name"),
        "city", "medicare_participates", "total_beneficiaries", "total_services",
        "distinct_procedures", "srvcs_per_beneficiary", "payment_per_beneficiary",
        "charge_to_payment_ratio",
        F.col("specialty_mean_pay_per_bene").alias("specialty_mean"),
        F.col("specialty_median_pay_per_bene").alias("specialty_median"),
        F.col("specialty_stddev_pay_per_bene").alias("specialty_stddev"),
        F.col("specialty_p25_pay_per_bene").alias("specialty_p25"),
        F.col("specialty_p75_pay_per_bene").alias("specialty_p75"),
        ratio(ppb - F.col("specialty_mean_pay_per_bene"), "specialty_stddev_pay_per_bene").alias("z_score"),
        efficiency_tier(ppb, "specialty_p25_pay_per_bene", "specialty_p75_pay_per_bene").alias("efficiency_tier"),
    ).orderBy(text_order("specialty", collation), ppb.desc_nulls_first(),
              F.col("npi"))  # tie-breaker: lets the range sort split a tie group
