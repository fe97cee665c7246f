"""Reliable materialisation and size-checked broadcasts.

* :func:`reliable` writes a reused intermediate as parquet into the folder the
  cluster names in ``spark.checkpoint.dir`` and reads it back: one job, lineage
  cut (a lost executor does not recompute the upstream aggregate), and unlike
  an RDD checkpoint the table keeps column pruning and file statistics.
* :func:`attach` joins a table of one row per key to rows whose keys may be
  hot: broadcast within a measured bound, salted beyond it, so the rows of one
  key never meet in one task.
* :func:`join_grown` joins two tables that both grow with the data: by a
  shuffle at any size, never through the driver.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import ensure_checkpoint_dir

# Per-key tables in this package (one row per specialty, per specialty x
# slice, per specialty x percentile) are narrow; 200k rows is a few MB.
DEFAULT_BROADCAST_ROWS = 200_000

# Parts that the rows of one key are dealt to where its table is too large to broadcast.
SALTS = 32


def reliable(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet under ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def broadcast_if(df: DataFrame, rows: int, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when ``rows`` (a measured bound) is within the limit."""
    return F.broadcast(df) if rows <= max_rows else df


def join_grown(left: DataFrame, right: DataFrame, key: str, hashed: bool = False) -> DataFrame:
    """Inner join on ``key`` of two tables that both grow with the data.

    Spark would take a table's size from its compressed files and columns' default widths and broadcast it below
    10 MB: by that, millions of providers, many times as large in the driver. ``hashed``: each task holds its part
    of a narrow ``right``, so that a long ``left`` is not sorted.
    """
    return left.join(right.hint("shuffle_hash" if hashed else "merge"), key)


@contextmanager
def small_partitions(spark: SparkSession, most: str = "16m"):
    """Inside, adaptive execution gathers shuffled rows up to ``most`` a task (less where the session says so), not
    64 MB: for an aggregate with about a group a row, which would not fit a task's memory and be sorted by spilling."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    size, own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes, spark.conf.get(key, None)
    if size(spark.conf.get(key)) <= size(most):
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "_r_"):
    """Rename ``right``'s keys and build a NULL-safe equality condition.

    Returns ``(right_renamed, condition, renamed_key_names)``.
    """
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, prefix + k)
    conds: list[Column] = [left[k].eqNullSafe(renamed[prefix + k]) for k in keys]
    cond = reduce(lambda a, b: a & b, conds)
    return renamed, cond, [prefix + k for k in keys]


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``IS NOT DISTINCT FROM``)."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    r, cond, rk = null_safe_on(left, right, keys)
    return left.join(r, cond, how).drop(*rk)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined NULL-safe to ``table`` (one row per key, ``n_rows`` measured).

    Within the broadcast bound the table goes to every task. Beyond it the rows
    of a key are dealt to ``SALTS`` parts by a hash of ``spread`` and the table
    is copied to each part.
    """
    if n_rows <= DEFAULT_BROADCAST_ROWS:
        return join_null_safe(rows, F.broadcast(table), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return join_null_safe(salted, copies, [*keys, "_salt"], how).drop("_salt")
