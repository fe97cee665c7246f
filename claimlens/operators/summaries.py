"""Export-ready summary views (specialty, procedure, provider).

Each function returns an unsorted DataFrame (a view's ORDER BY guarantees
nothing once the view feeds another query); :data:`VIEW_ORDER` holds the
order the export step applies. :func:`register_views` exposes them as temp
views under their reference names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.exprs import DRUG_LABEL_SUMMARY, code_type, display_name, ratio, text_order
from claimlens.operators.kpis import provider_totals, specialty_totals
from claimlens.plans.base import Star
from claimlens.plans.materialize import join_grown, join_null_safe
from claimlens.sources import sinks, versions


def specialty_code_counts(star: Star) -> DataFrame:
    """``COUNT(DISTINCT hcpcs_cd)`` per specialty: a row count over the distinct
    pairs, map-side combined, so a hot specialty is never gathered."""
    return star.specialty_codes().groupBy("specialty").agg(F.count("hcpcs_cd").alias("distinct_procedures"))


def vw_specialty_summary(star: Star) -> DataFrame:
    t = specialty_totals(star)
    # both sides hold one row per specialty: no skew, any join strategy is fine
    j = join_null_safe(t, specialty_code_counts(star), ["specialty"], "left")
    return j.select(
        "specialty", "provider_count",
        F.coalesce("distinct_procedures", F.lit(0)).cast("bigint").alias("distinct_procedures"),
        F.col("benes").alias("total_beneficiaries"),
        F.col("srv").alias("total_services"),
        F.round("sub", 2).alias("total_submitted"),
        F.round("alw", 2).alias("total_allowed"),
        F.round("pay", 2).alias("total_payment"),
        F.round("std", 2).alias("total_standardized"),
        ratio("pay", "srv").alias("avg_payment_per_svc"),
        ratio("pay", "benes").alias("avg_payment_per_bene"),
        ratio("sub", "pay").alias("charge_to_payment_ratio"),
    )


def vw_procedure_summary(star: Star) -> DataFrame:
    totals = star.rollup("hcpcs_cd")
    j = join_grown(totals, star.codes, "hcpcs_cd")
    return j.select(
        "hcpcs_cd", "hcpcs_desc",
        code_type("drug_indicator", DRUG_LABEL_SUMMARY).alias("code_type"),
        F.col("n_other").alias("provider_count"),
        F.col("benes").alias("total_beneficiaries"),
        F.col("srv").alias("total_services"),
        F.round("pay", 2).alias("total_payment"),
        F.round("alw", 2).alias("total_allowed"),
        ratio("pay", "srv").alias("avg_payment_per_svc"),
        ratio("pay", "benes").alias("avg_payment_per_bene"),
    )


def vw_provider_kpi(star: Star) -> DataFrame:
    pt = provider_totals(star, ["first_name", "last_org_name", "credentials", "entity_type",
                                "city", "zip5", "provider_type", "medicare_participates"])
    return pt.select(
        "npi",
        display_name("entity_type", "first_name", "last_org_name").alias("provider_name"),
        "credentials", "entity_type", "city", "zip5",
        F.col("provider_type").alias("specialty"),
        "medicare_participates",
        F.col("n_other").alias("distinct_procedures"),
        F.col("benes").alias("total_beneficiaries"),
        F.col("srv").alias("total_services"),
        F.round("pay", 2).alias("total_payment"),
        F.round("alw", 2).alias("total_allowed"),
        F.round("sub", 2).alias("total_submitted"),
        ratio("pay", "srv").alias("avg_payment_per_svc"),
        ratio("pay", "benes").alias("avg_payment_per_bene"),
        ratio("srv", "benes").alias("srvcs_per_beneficiary"),
        ratio("sub", "pay").alias("charge_to_payment_ratio"),
    )


VIEWS = {
    "vw_specialty_summary": vw_specialty_summary,
    "vw_procedure_summary": vw_procedure_summary,
    "vw_provider_kpi": vw_provider_kpi,
}

# The views' ORDER BY (column, descending), applied when exporting, plus the
# view's key as a tie-breaker: the reference leaves tie order open, and the key
# lets the distributed range sort split a group of equal totals.
VIEW_ORDER = {
    "vw_specialty_summary": [("total_payment", True), ("specialty", False)],
    "vw_procedure_summary": [("total_payment", True), ("hcpcs_cd", False)],
    "vw_provider_kpi": [("total_payment", True), ("npi", False)],
}


_TEXT = {"specialty", "hcpcs_cd"}


def view_order(name: str, collation: str | None = None) -> list:
    """Sort columns for a view, NULLs first on DESC and last on ASC (PostgreSQL); texts in binary order or by ``collation``."""
    return [F.col(c).desc_nulls_first() if desc else text_order(c, collation) if c in _TEXT else F.col(c).asc_nulls_last()
            for c, desc in VIEW_ORDER[name]]


def register_views(spark: SparkSession, star: Star) -> list[str]:
    """``CREATE OR REPLACE VIEW`` equivalents: lazily evaluated temp views."""
    for name, fn in VIEWS.items():
        fn(star).createOrReplaceTempView(name)
    return list(VIEWS)


class PublishedViews:
    """The star's tables and summary views as SQL names over whatever version is published.

    A temporary view is bound to the files it was made over, so every statement
    first looks up the published version and makes the names anew if it changed.
    """

    TABLES = ("providers", "hcpcs_codes", "utilization")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.at = spark, root, None

    def refresh(self) -> None:
        at = versions.published(self.spark, self.root)
        if at is None:
            raise FileNotFoundError(f"no published star under {self.root}")
        if at != self.at:
            star = sinks.read_star(self.spark, self.root, version=at.version)
            for name, df in zip(self.TABLES, (star.providers, star.codes, star.utilization)):
                df.createOrReplaceTempView(name)
            register_views(self.spark, star)
            self.at = at

    def sql(self, statement: str) -> DataFrame:
        self.refresh()
        return self.spark.sql(statement)


# The one view small enough to hand over as one file: a row per specialty. The
# others grow with the code and provider tables and stay in ordered parts.
SINGLE_FILE_VIEWS = {"vw_specialty_summary"}


def export_views(star: Star, root: str, fmt: str = "csv", collation: str | None = None) -> dict[str, str]:
    """C15: write every summary view, sorted by its ORDER BY, under ``root``."""
    from claimlens.sources.sinks import export_summary

    out = {}
    for name, fn in VIEWS.items():
        path = f"{root.rstrip('/')}/{name}"
        export_summary(fn(star), path, fmt, order_by=view_order(name, collation),
                       single_file=name in SINGLE_FILE_VIEWS)
        out[name] = path
    return out
