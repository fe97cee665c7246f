"""Map the driver's TPC-H-style tables onto the claims star schema.

The driver ships no claims extract, so every registered query derives its
providers / procedure codes / utilization facts from the given tables with
the deterministic rules below (specified in FIXTURES.md section 3). The
DuckDB oracle in :mod:`claimlens.oracle` states the same rules in SQL.

Sizes: providers grow with ``customer``, codes with ``part``, facts with
``lineitem``. Only ``nation`` (25 rows) and ``region`` (5 rows) are fixed
reference tables and are broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.plans.materialize import broadcast_if
from claimlens.schema import STAGING_COLUMNS

MONEY_T = "decimal(12,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(v: str):
    return F.lit(Decimal(v))


# --------------------------------------------------------------------------
# provider attributes as columns of ``customer`` joined to nation/region
# --------------------------------------------------------------------------

def _customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).drop("r_regionkey")
    # nation x region is the fixed 25-row geography; broadcast after counting it
    return cust.join(broadcast_if(geo, geo.count()), cust.c_nationkey == geo.n_nationkey)


def _provider_columns(k, raw_blank: bool):
    """Provider attribute expressions keyed by star-schema name.

    ``raw_blank`` renders "missing" as '' (staging text) instead of NULL.
    """
    blank = F.lit("") if raw_blank else F.lit(None).cast("string")
    kk = F.col(k)
    return {
        "first_name": F.when((kk % 5 == 0) | (kk % 7 == 0), blank)
                       .otherwise(F.concat(F.lit("F"), (kk % 97).cast("string"))),
        "middle_initial": F.when(kk % 3 == 0, blank)
                           .otherwise(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (kk % 26 + 1).cast("int"), 1)),
        "credentials": F.when(kk % 4 == 0, F.lit("MD")).when(kk % 4 == 1, F.lit("DO"))
                        .when(kk % 4 == 2, F.lit("NP")).otherwise(blank),
        "entity_type": F.when(kk % 5 == 0, F.lit("O")).otherwise(F.lit("I")),
        "zip5": (F.lit(60000) + kk % 3000).cast("string"),
        "ruca_description": F.concat(F.lit("RUCA "), (kk % 10 + 1).cast("string")),
        "country": F.lit("US"),
        "provider_type": F.when(kk % 401 == 0, F.lit(None).cast("string"))
                          .otherwise(F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("r_name"))),
        "medicare_participates": F.when(F.col("c_acctbal") < 0, F.lit("N")).otherwise(F.lit("Y")),
        "state": F.when(F.col("n_regionkey").isin(0, 1, 2), F.lit("IL")).otherwise(F.lit("WI")),
    }


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star-schema ``providers``: one row per ``c_custkey``."""
    cg = _customer_geo(spark, sf_dir)
    pc = _provider_columns("c_custkey", raw_blank=False)
    k = F.col("c_custkey")
    return cg.select(
        k.alias("npi"),
        F.col("c_name").alias("last_org_name"),
        pc["first_name"].alias("first_name"),
        pc["middle_initial"].alias("middle_initial"),
        pc["credentials"].alias("credentials"),
        pc["entity_type"].alias("entity_type"),
        F.concat(k.cast("string"), F.lit(" MAIN ST")).alias("street_1"),
        F.when(k % 2 == 0, F.concat(F.lit("STE "), (k % 50).cast("string"))).alias("street_2"),
        F.col("n_name").alias("city"),
        pc["state"].alias("state"),
        F.when(pc["state"] == "IL", F.lit(17)).otherwise(F.lit(55)).cast("smallint").alias("state_fips"),
        pc["zip5"].alias("zip5"),
        F.when(k % 13 == 0, F.lit(None)).otherwise((k % 10 + 1).cast("decimal(4,1)")).alias("ruca_code"),
        pc["ruca_description"].alias("ruca_description"),
        pc["country"].alias("country"),
        pc["provider_type"].alias("provider_type"),
        pc["medicare_participates"].alias("medicare_participates"),
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star-schema ``hcpcs_codes``: one row per ``p_partkey``."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return part.select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("hcpcs_cd"),
        F.col("p_name").alias("hcpcs_desc"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.lit("Y")).otherwise(F.lit("N")).alias("drug_indicator"),
    )


def _fact_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_linestatus")
    return li, read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def _fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = _fact_sides(spark, sf_dir)
    # orders grows with the data: a shuffle (sort-merge) join, AQE may re-plan.
    return li.join(orders, li.l_orderkey == orders.o_orderkey)


def _fact_columns():
    o = F.col("o_custkey")
    ep = F.col("l_extendedprice").cast(MONEY_T)
    base = ep * (F.lit(1) - F.col("l_discount").cast(MONEY_T))
    factor = (F.when(o % 11 == 0, _dec("2.40"))
               .when(o % 13 == 0, _dec("0.30"))
               .otherwise(_dec("1.00")))
    qty = F.col("l_quantity").cast(MONEY_T)
    return {
        "npi": o,
        "hcpcs_cd": F.concat(F.lit("H"), F.col("l_partkey").cast("string")),
        "place_of_service": F.col("l_linestatus"),
        "tot_benes": F.nullif(F.col("l_linenumber"), F.lit(7)).cast("int"),
        "tot_srvcs": F.when(o % 499 == 0, F.lit(0).cast(MONEY_T)).otherwise(qty).cast(MONEY_T),
        "tot_bene_day_srvcs": qty,
        "avg_submitted_charge": (ep * F.lit(3)).cast(MONEY_T),
        "avg_medicare_allowed": F.round(base, 2).cast(MONEY_T),
        "avg_medicare_payment": F.when(o % 499 == 7, F.lit(None).cast(MONEY_T))
                                 .otherwise(F.round(F.round(base * _dec("0.78"), 2) * factor, 2)).cast(MONEY_T),
        "avg_medicare_standardized": F.round(base * _dec("0.80"), 2).cast(MONEY_T),
    }


def utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star-schema ``utilization``: one fact per lineitem row."""
    cols = _fact_columns()
    return _fact_rows(spark, sf_dir).select(*[v.alias(k) for k, v in cols.items()])


def with_ties(util: DataFrame) -> DataFrame:
    """The facts with one service each and payments rounded to 20,000, so that
    many providers and many codes have equal totals."""
    paid = F.col("avg_medicare_payment")
    return util.withColumn("tot_srvcs", F.when(F.col("tot_srvcs") > 0, F.lit(3)).otherwise(F.lit(0)).cast(MONEY_T)) \
        .withColumn("avg_medicare_payment", (F.round(paid / F.lit(Decimal("20000")), 0) * F.lit(20000)).cast(MONEY_T))


def star(spark: SparkSession, sf_dir: str):
    """(providers, codes, utilization) for the KPI queries."""
    return providers(spark, sf_dir), codes(spark, sf_dir), utilization(spark, sf_dir)


# --------------------------------------------------------------------------
# staging extract (28 text columns) for the load operators
# --------------------------------------------------------------------------

def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw extract as text, one line per fact row, all providers (IL + WI).

    Each provider appears on many lines with two street variants and each code
    with two description variants, so that the load's one-row-per-key pick is
    exercised. Missing values are '' as in the CSV.
    """
    li, orders = _fact_sides(spark, sf_dir)
    cg = _customer_geo(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # the provider's wide columns join the orders, so that they are shuffled once an order, not once a line;
    # a line crosses the shuffles with its own columns and its code's
    rows = (li.join(part, li.l_partkey == part.p_partkey)
            .join(orders.join(cg, orders.o_custkey == cg.c_custkey), li.l_orderkey == orders.o_orderkey))
    fc = _fact_columns()
    pc = _provider_columns("c_custkey", raw_blank=True)
    k = F.col("c_custkey")
    alt = F.col("l_linenumber") % 2 == 0

    def txt(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    out = {
        "Rndrng_NPI": k.cast("string"),
        "Rndrng_Prvdr_Last_Org_Name": F.col("c_name"),
        "Rndrng_Prvdr_First_Name": pc["first_name"],
        "Rndrng_Prvdr_MI": pc["middle_initial"],
        "Rndrng_Prvdr_Crdntls": pc["credentials"],
        "Rndrng_Prvdr_Ent_Cd": pc["entity_type"],
        "Rndrng_Prvdr_St1": F.concat(k.cast("string"), F.when(alt, F.lit(" MAIN ST")).otherwise(F.lit(" OAK AVE"))),
        "Rndrng_Prvdr_St2": F.when(k % 2 == 0, F.concat(F.lit("STE "), (k % 50).cast("string"))).otherwise(F.lit("")),
        "Rndrng_Prvdr_City": F.col("n_name"),
        "Rndrng_Prvdr_State_Abrvtn": pc["state"],
        "Rndrng_Prvdr_State_FIPS": F.when(pc["state"] == "IL", F.lit("17")).otherwise(F.lit("55")),
        "Rndrng_Prvdr_Zip5": pc["zip5"],
        "Rndrng_Prvdr_RUCA": F.when(k % 13 == 0, F.lit("")).otherwise(F.concat((k % 10 + 1).cast("string"), F.lit(".0"))),
        "Rndrng_Prvdr_RUCA_Desc": pc["ruca_description"],
        "Rndrng_Prvdr_Cntry": pc["country"],
        "Rndrng_Prvdr_Type": F.coalesce(pc["provider_type"], F.lit("")),
        "Rndrng_Prvdr_Mdcr_Prtcptg_Ind": pc["medicare_participates"],
        "HCPCS_Cd": fc["hcpcs_cd"],
        "HCPCS_Desc": F.when(alt, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" (alt)"))),
        "HCPCS_Drug_Ind": F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.lit("Y")).otherwise(F.lit("N")),
        "Place_Of_Srvc": fc["place_of_service"],
        "Tot_Benes": txt(fc["tot_benes"]),
        "Tot_Srvcs": txt(fc["tot_srvcs"]),
        "Tot_Bene_Day_Srvcs": txt(fc["tot_bene_day_srvcs"]),
        "Avg_Sbmtd_Chrg": txt(fc["avg_submitted_charge"]),
        "Avg_Mdcr_Alowd_Amt": txt(fc["avg_medicare_allowed"]),
        "Avg_Mdcr_Pymt_Amt": txt(fc["avg_medicare_payment"]),
        "Avg_Mdcr_Stdzd_Amt": txt(fc["avg_medicare_standardized"]),
    }
    return rows.select(*[out[c].alias(c) for c in STAGING_COLUMNS])
