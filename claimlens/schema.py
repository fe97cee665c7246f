"""Declared schemas of the staging extract and the star schema.

Nothing is ever inferred: the staging extract is read as text with
:data:`STAGING_SCHEMA`, typed columns are produced by explicit casts.
"""

from __future__ import annotations

from pyspark.sql import types as T

# CSV header order of the yearly provider-and-service extract.
STAGING_COLUMNS = [
    "Rndrng_NPI",
    "Rndrng_Prvdr_Last_Org_Name",
    "Rndrng_Prvdr_First_Name",
    "Rndrng_Prvdr_MI",
    "Rndrng_Prvdr_Crdntls",
    "Rndrng_Prvdr_Ent_Cd",
    "Rndrng_Prvdr_St1",
    "Rndrng_Prvdr_St2",
    "Rndrng_Prvdr_City",
    "Rndrng_Prvdr_State_Abrvtn",
    "Rndrng_Prvdr_State_FIPS",
    "Rndrng_Prvdr_Zip5",
    "Rndrng_Prvdr_RUCA",
    "Rndrng_Prvdr_RUCA_Desc",
    "Rndrng_Prvdr_Cntry",
    "Rndrng_Prvdr_Type",
    "Rndrng_Prvdr_Mdcr_Prtcptg_Ind",
    "HCPCS_Cd",
    "HCPCS_Desc",
    "HCPCS_Drug_Ind",
    "Place_Of_Srvc",
    "Tot_Benes",
    "Tot_Srvcs",
    "Tot_Bene_Day_Srvcs",
    "Avg_Sbmtd_Chrg",
    "Avg_Mdcr_Alowd_Amt",
    "Avg_Mdcr_Pymt_Amt",
    "Avg_Mdcr_Stdzd_Amt",
]

STAGING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in STAGING_COLUMNS])

MONEY = T.DecimalType(12, 2)

PROVIDERS_SCHEMA = T.StructType([
    T.StructField("npi", T.LongType(), False),
    T.StructField("last_org_name", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("middle_initial", T.StringType()),
    T.StructField("credentials", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("street_1", T.StringType()),
    T.StructField("street_2", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("state_fips", T.ShortType()),
    T.StructField("zip5", T.StringType()),
    T.StructField("ruca_code", T.DecimalType(4, 1)),
    T.StructField("ruca_description", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("provider_type", T.StringType()),
    T.StructField("medicare_participates", T.StringType()),
])

CODES_SCHEMA = T.StructType([
    T.StructField("hcpcs_cd", T.StringType(), False),
    T.StructField("hcpcs_desc", T.StringType()),
    T.StructField("drug_indicator", T.StringType()),
])

UTILIZATION_SCHEMA = T.StructType([
    T.StructField("npi", T.LongType(), False),
    T.StructField("hcpcs_cd", T.StringType(), False),
    T.StructField("place_of_service", T.StringType()),
    T.StructField("tot_benes", T.IntegerType()),
    T.StructField("tot_srvcs", MONEY),
    T.StructField("tot_bene_day_srvcs", MONEY),
    T.StructField("avg_submitted_charge", MONEY),
    T.StructField("avg_medicare_allowed", MONEY),
    T.StructField("avg_medicare_payment", MONEY),
    T.StructField("avg_medicare_standardized", MONEY),
])

# Declared text limits (VARCHAR(n) / CHAR(n)) of the star schema.
PROVIDERS_LENGTHS = {
    "last_org_name": 100, "first_name": 50, "middle_initial": 1, "credentials": 50,
    "entity_type": 1, "street_1": 100, "street_2": 100, "city": 50, "state": 2,
    "zip5": 5, "ruca_description": 100, "country": 2, "provider_type": 100,
    "medicare_participates": 1,
}
CODES_LENGTHS = {"hcpcs_cd": 10, "hcpcs_desc": 256, "drug_indicator": 1}
UTILIZATION_LENGTHS = {"hcpcs_cd": 10, "place_of_service": 1}

# Key columns (PRIMARY KEY / NOT NULL / REFERENCES in the source schema).
PROVIDERS_KEY = ["npi"]
CODES_KEY = ["hcpcs_cd"]
UTILIZATION_NOT_NULL = ["npi", "hcpcs_cd"]
