"""Data-quality checks standing in for the source schema's constraints.

Spark does not enforce PRIMARY KEY / REFERENCES / NOT NULL / VARCHAR(n), so
each becomes a distributed check. ``*_report`` functions return summary rows
``(table_name, check_name, column_name, limit_value, max_length, violations)``;
the other functions return the offending rows themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.plans.base import Star
from claimlens.schema import (
    CODES_KEY,
    CODES_LENGTHS,
    PROVIDERS_KEY,
    PROVIDERS_LENGTHS,
    UTILIZATION_LENGTHS,
    UTILIZATION_NOT_NULL,
)

REPORT_COLUMNS = ["table_name", "check_name", "column_name", "limit_value", "max_length", "violations"]


_REPORT = "array<struct<table_name:string,check_name:string,column_name:string,limit_value:bigint,max_length:bigint,violations:bigint>>"


def _row(table: str, check: str, column: str, limit, max_len, violations):
    return F.struct(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.lit(column).alias("column_name"),
                    F.lit(limit).cast("bigint").alias("limit_value"),
                    (F.lit(None) if max_len is None else max_len).cast("bigint").alias("max_length"),
                    F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))


def _report(agg: DataFrame, rows: list) -> DataFrame:
    """The rows of a one-row aggregate, so that each is not a scan of its own."""
    return agg.select(F.inline(F.array(*rows).cast(_REPORT)))


# -- C16 primary key ---------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once (with their count)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# -- C17 foreign key ---------------------------------------------------------

def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL ``key`` has no parent row."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def key_report(parent: DataFrame, child: DataFrame, key: str, parent_name: str, child_name: str) -> DataFrame:
    """Primary key of the parent (duplicated values, rows with a NULL key) and
    the child's references to it (rows without a parent row).

    Both sides are counted per key before they meet: one scan each, and a key
    on a third of all rows is one row of the join.
    """
    p = parent.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_rows"))
    c = child.groupBy(key).agg(F.count(F.lit(1)).alias("_child_rows"))
    both = c.join(p, c[key] == p["_k"], "full")
    agg = both.agg(F.count_if(F.col("_k").isNotNull() & (F.col("_rows") > 1)).alias("twice"),
                   F.sum(F.when(F.col("_k").isNull(), F.col("_rows"))).alias("no_key"),
                   F.sum(F.when(F.col(key).isNotNull() & F.col("_k").isNull(), F.col("_child_rows"))).alias("orphans"))
    return _report(agg, [_row(parent_name, "unique", key, None, None, F.col("twice") + F.coalesce("no_key", F.lit(0))),
                         _row(child_name, "references", key, None, None, F.col("orphans"))])


# -- C18 NOT NULL, C19 text length ---------------------------------------------

def column_report(df: DataFrame, required: list[str], limits: dict[str, int], table: str) -> DataFrame:
    """NULLs in the columns declared NOT NULL, and the longest text and values
    over the limit of each text column, all in one pass over ``df``."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"{c}__null") for c in required]
    for c, n in limits.items():
        ln = F.char_length(F.col(c))
        aggs += [F.max(ln).alias(f"{c}__max"), F.count_if(ln > F.lit(n)).alias(f"{c}__over")]
    rows = [_row(table, "not_null", c, None, None, F.col(f"{c}__null")) for c in required]
    rows += [_row(table, "length", c, n, F.col(f"{c}__max"), F.col(f"{c}__over")) for c, n in limits.items()]
    return _report(df.agg(*aggs), rows)


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with any text value over its declared limit."""
    cond = reduce(lambda a, b: a | b, [F.char_length(F.col(c)) > F.lit(n) for c, n in limits.items()])
    return df.where(cond)


# -- all of them -----------------------------------------------------------------

def quality_report(star: Star) -> DataFrame:
    """Every constraint of the source schema checked on a loaded star schema."""
    p, c, u = star.providers, star.codes, star.utilization
    parts = [
        key_report(p, u, "npi", "providers", "utilization"),
        key_report(c, u, "hcpcs_cd", "hcpcs_codes", "utilization"),
        column_report(p, PROVIDERS_KEY, PROVIDERS_LENGTHS, "providers"),
        column_report(c, CODES_KEY, CODES_LENGTHS, "hcpcs_codes"),
        column_report(u, UTILIZATION_NOT_NULL, UTILIZATION_LENGTHS, "utilization"),
    ]
    return reduce(DataFrame.unionByName, parts)
