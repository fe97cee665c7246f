"""Staging extract -> normalised star schema (providers, codes, facts).

Semantics kept from the source load:

* one state only, applied to all three loads, so facts always have their
  dimension rows;
* providers: one row per NPI *text* (before the cast), blanks -> NULL in the
  optional columns, ``state_fips`` cast without a blank guard (raises);
* codes: one row per code, first description wins (``ON CONFLICT DO
  NOTHING``); optionally only codes absent from an existing table;
* facts: every line kept (no key), blanks -> NULL, exact decimals.

The source picks "any" row per key; here the pick is the smallest row in
column order (NULLs first), so reruns agree and an oracle can exist. The pick
is a ``min(struct)`` aggregate: it is combined map-side, so an NPI or code
that appears on a third of all lines costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exprs import blank_to_null
from claimlens.plans.base import Star
from claimlens.plans.materialize import reliable

DEFAULT_STATE = "IL"  # Fixed value: the reference keeps Illinois providers only.

PROVIDER_SRC = [
    "Rndrng_Prvdr_Last_Org_Name", "Rndrng_Prvdr_First_Name", "Rndrng_Prvdr_MI",
    "Rndrng_Prvdr_Crdntls", "Rndrng_Prvdr_Ent_Cd", "Rndrng_Prvdr_St1", "Rndrng_Prvdr_St2",
    "Rndrng_Prvdr_City", "Rndrng_Prvdr_State_Abrvtn", "Rndrng_Prvdr_State_FIPS",
    "Rndrng_Prvdr_Zip5", "Rndrng_Prvdr_RUCA", "Rndrng_Prvdr_RUCA_Desc", "Rndrng_Prvdr_Cntry",
    "Rndrng_Prvdr_Type", "Rndrng_Prvdr_Mdcr_Prtcptg_Ind",
]


CODE_SRC = ["HCPCS_Desc", "HCPCS_Drug_Ind"]


def in_state(stg: DataFrame, state: str = DEFAULT_STATE) -> DataFrame:
    return stg.where(F.col("Rndrng_Prvdr_State_Abrvtn") == F.lit(state))


def provider_candidates(stg: DataFrame, state: str = DEFAULT_STATE) -> DataFrame:
    """Smallest raw row per NPI text of ``state``: ``(Rndrng_NPI, r)``.

    ``min`` is associative, so candidates from separate inputs (files,
    micro-batches) combine with :func:`providers_from_candidates` into exactly
    the pick a single load over all inputs makes.
    """
    s = in_state(stg, state).select("Rndrng_NPI", *PROVIDER_SRC)
    return s.groupBy("Rndrng_NPI").agg(F.min(F.struct(*PROVIDER_SRC)).alias("r"))


def providers_from_candidates(cands: DataFrame) -> DataFrame:
    """Typed provider rows from one or more sets of candidates."""
    pick = cands.groupBy("Rndrng_NPI").agg(F.min("r").alias("r"))
    r = lambda c: F.col("r." + c)
    return pick.select(
        F.col("Rndrng_NPI").cast("bigint").alias("npi"),
        r("Rndrng_Prvdr_Last_Org_Name").alias("last_org_name"),
        r("Rndrng_Prvdr_First_Name").alias("first_name"),
        blank_to_null(r("Rndrng_Prvdr_MI")).alias("middle_initial"),
        blank_to_null(r("Rndrng_Prvdr_Crdntls")).alias("credentials"),
        r("Rndrng_Prvdr_Ent_Cd").alias("entity_type"),
        r("Rndrng_Prvdr_St1").alias("street_1"),
        blank_to_null(r("Rndrng_Prvdr_St2")).alias("street_2"),
        r("Rndrng_Prvdr_City").alias("city"),
        r("Rndrng_Prvdr_State_Abrvtn").alias("state"),
        r("Rndrng_Prvdr_State_FIPS").cast("smallint").alias("state_fips"),
        r("Rndrng_Prvdr_Zip5").alias("zip5"),
        blank_to_null(r("Rndrng_Prvdr_RUCA")).cast("decimal(4,1)").alias("ruca_code"),
        r("Rndrng_Prvdr_RUCA_Desc").alias("ruca_description"),
        r("Rndrng_Prvdr_Cntry").alias("country"),
        r("Rndrng_Prvdr_Type").alias("provider_type"),
        r("Rndrng_Prvdr_Mdcr_Prtcptg_Ind").alias("medicare_participates"),
    )


def load_providers(stg: DataFrame, state: str = DEFAULT_STATE) -> DataFrame:
    """C2: one provider row per NPI of ``state``."""
    return providers_from_candidates(provider_candidates(stg, state))


def code_candidates(stg: DataFrame, state: str = DEFAULT_STATE) -> DataFrame:
    """Smallest (description, drug flag) per code of ``state``: ``(HCPCS_Cd, r)``."""
    s = in_state(stg, state).select("HCPCS_Cd", *CODE_SRC)
    return s.groupBy("HCPCS_Cd").agg(F.min(F.struct(*CODE_SRC)).alias("r"))


def codes_from_candidates(cands: DataFrame) -> DataFrame:
    pick = cands.groupBy("HCPCS_Cd").agg(F.min("r").alias("r"))
    return pick.select(
        F.col("HCPCS_Cd").alias("hcpcs_cd"),
        F.col("r.HCPCS_Desc").alias("hcpcs_desc"),
        F.col("r.HCPCS_Drug_Ind").alias("drug_indicator"),
    )


def load_codes(stg: DataFrame, state: str = DEFAULT_STATE, existing: DataFrame | None = None) -> DataFrame:
    """C3: distinct codes of ``state``, first description per code wins.

    With ``existing``, codes already present there are left out (insert only
    what does not conflict), which makes repeated loads idempotent.
    """
    out = codes_from_candidates(code_candidates(stg, state))
    return out if existing is None else new_codes(out, existing)


def new_codes(codes: DataFrame, existing: DataFrame) -> DataFrame:
    """``ON CONFLICT DO NOTHING``: the codes that are not in the existing table."""
    return codes.join(existing.select("hcpcs_cd"), "hcpcs_cd", "left_anti")


def load_utilization(stg: DataFrame, state: str = DEFAULT_STATE) -> DataFrame:
    """C4: every fact line of ``state``, typed (narrow: no shuffle)."""
    s = in_state(stg, state)

    def dec(c):
        return blank_to_null(c).cast("decimal(12,2)")

    return s.select(
        F.col("Rndrng_NPI").cast("bigint").alias("npi"),
        F.col("HCPCS_Cd").alias("hcpcs_cd"),
        F.col("Place_Of_Srvc").alias("place_of_service"),
        blank_to_null("Tot_Benes").cast("int").alias("tot_benes"),
        dec("Tot_Srvcs").alias("tot_srvcs"),
        dec("Tot_Bene_Day_Srvcs").alias("tot_bene_day_srvcs"),
        dec("Avg_Sbmtd_Chrg").alias("avg_submitted_charge"),
        dec("Avg_Mdcr_Alowd_Amt").alias("avg_medicare_allowed"),
        dec("Avg_Mdcr_Pymt_Amt").alias("avg_medicare_payment"),
        dec("Avg_Mdcr_Stdzd_Amt").alias("avg_medicare_standardized"),
    )


def load_star(stg: DataFrame, state: str = DEFAULT_STATE, stage: bool = True) -> Star:
    """All three loads over one staging frame.

    With ``stage`` the state's staging rows are written once as parquet to the
    checkpoint folder first, so the extract is parsed once (not three times)
    and each load reads only the columns it needs.
    """
    if stage:
        stg = reliable(in_state(stg, state))
    return Star(load_providers(stg, state), load_codes(stg, state), load_utilization(stg, state))
