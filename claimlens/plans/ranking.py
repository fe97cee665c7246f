"""Distributed ``RANK()``, exact percentiles and ranked top-k.

Spark executes ``Window.partitionBy(k).orderBy(v)`` by sending every row of a
key to one task, and an un-partitioned window sends the whole table to one
task. With a hot key (a specialty holding a third of all providers) or no key
at all, that is a single-task stage over an unbounded group. The operators
here compute the same numbers without such a stage:

1. Collapse rows to distinct ``(key, value)`` with their row count
   (map-side combined, so a hot value costs one row per map task).
2. Cut each key's values into slices on a logarithmic scale. The slice is a
   function of the value alone, so it takes no pass over the data and ties never
   straddle a slice; a slice is a few percent wide, so it holds at most a few
   percent of a value's cents as distinct values.
3. Number distinct values inside each ``(key, slice)`` with a small window.
4. Add the row counts / sums of all earlier slices of the same key from a
   table of one row per key and slice that occurs.

``RANK()`` of a value is 1 + rows strictly before it: it depends only on the
value, so the results are exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.plans.materialize import join_null_safe

#: Slices for each factor of e in the value.
DEFAULT_BUCKETS = 32
#: Shifts the logarithm of the smallest decimal above zero: values of one sign have slices of one sign.
_FOLDS = 2 * 120


def value_slice(v, buckets: int):
    """Slice of a decimal: 0 for zero, growing with the value."""
    step = F.lit(1) + F.floor((F.log(F.abs(v).cast("double")) + F.lit(_FOLDS // 4)) * F.lit(buckets))
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0)).cast("bigint")


def value_positions(df: DataFrame, part: list[str], value: str, *, descending: bool = True,
                    nulls_first: bool = True, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row per distinct ``(part, value)`` with its position in the order.

    Columns: ``part..., value, _n`` (rows with this value), ``_rank``
    (SQL RANK), ``_cum_n`` (rows up to and including ties), ``_cum_k``
    (non-NULL rows up to and including ties), ``_run_sum`` (RANGE running
    sum of ``value``; NULL while only NULLs are in the frame) and ``_tot_k``
    (non-NULL rows of the partition). ``part`` may be empty (whole table).
    """
    v = F.col(value)
    keys = list(part)
    d = (df.groupBy(*keys, value)
         .agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"))
         .withColumn("_k", F.when(v.isNull(), F.lit(0)).otherwise(F.col("_n"))))

    ahead = value_slice(v, buckets) * F.lit(-1 if descending else 1)
    null_slice = F.lit(-(1 << 40) if nulls_first else 1 << 40).cast("bigint")
    d = d.withColumn("_slice", F.when(v.isNull(), null_slice).otherwise(ahead))

    # 3. positions inside the slice (one row per distinct value: ROWS == RANGE)
    order = v.desc() if descending else v.asc()
    w = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = (d.withColumn("_ln", F.sum("_n").over(w))
          .withColumn("_lk", F.sum("_k").over(w))
          .withColumn("_ls", F.sum("_s").over(w)))

    # 4. offsets from earlier slices: one row for each slice of a key that occurs
    slices = d.groupBy(*keys, "_slice").agg(
        F.sum("_n").alias("_bn"), F.sum("_k").alias("_bk"), F.sum("_s").alias("_bs"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = slices.select(
        *keys, "_slice",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_bk").over(before), F.lit(0)).alias("_ok"),
        F.sum("_bs").over(before).alias("_os"),
        F.sum("_bk").over(whole).alias("_tot_k"),
    )
    # the window left the distinct values dealt by (key, slice), and no slice is hot: a plain join moves the offsets only
    d = join_null_safe(d, offsets, keys + ["_slice"])

    cum_k = F.col("_ok") + F.col("_lk")
    return d.select(
        *keys, value, "_n",
        (F.col("_on") + F.col("_ln") - F.col("_n") + F.lit(1)).alias("_rank"),
        (F.col("_on") + F.col("_ln")).alias("_cum_n"),
        cum_k.alias("_cum_k"),
        F.when(cum_k == 0, F.lit(None))
         .otherwise(F.coalesce(F.col("_os"), F.lit(0)) + F.coalesce(F.col("_ls"), F.lit(0)))
         .alias("_run_sum"),
        "_tot_k",
    )


def rank_within(df: DataFrame, part: list[str], value: str, out: str, *, descending: bool = True,
                nulls_first: bool = True, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Append ``RANK() OVER (PARTITION BY part ORDER BY value ...)`` as ``out``
    using the sliced form (no task ever holds a whole key)."""
    pos = value_positions(df.select(*part, value), part, value, descending=descending,
                          nulls_first=nulls_first, buckets=buckets)
    pos = pos.select(*part, value, F.col("_rank").alias(out))
    return join_null_safe(df, pos, list(part) + [value], "inner")


def exact_percentiles(df: DataFrame, part: list[str], value: str, ps: dict[str, str], *,
                      buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY value)`` per ``part``, exactly.

    ``ps`` maps output column -> p as a decimal string ("0.5"). NULL values are
    ignored; partitions with no non-NULL value are absent from the result.
    Interpolation is done in decimal arithmetic, so for decimal input the
    result is the exact value PostgreSQL's double interpolation rounds to.
    """
    v = F.col(value)
    pos = value_positions(df.where(v.isNotNull()).select(*part, value), part, value,
                          descending=False, nulls_first=False, buckets=buckets)
    first_idx = F.col("_rank") - F.lit(1)  # 0-based index of the first row with this value
    aggs, finals = [], []
    for name, p in ps.items():
        at = (F.col("_tot_k") - F.lit(1)).cast("decimal(20,0)") * F.lit(Decimal(p))
        lo = F.floor(at).cast("bigint")
        hi = F.ceil(at).cast("bigint")
        frac = at - F.floor(at)
        covers_lo = (first_idx <= lo) & (lo < F.col("_cum_n"))
        covers_hi = (first_idx <= hi) & (hi < F.col("_cum_n"))
        aggs += [F.max(F.when(covers_lo, v)).alias(f"_lo_{name}"),
                 F.max(F.when(covers_hi, v)).alias(f"_hi_{name}"),
                 F.max(frac).alias(f"_fr_{name}")]
        finals.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}"))
                      .alias(name))
    keys = list(part)
    if not keys:
        return pos.agg(*aggs).select(*finals)
    return pos.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def distribution(df: DataFrame, key: str, value: str, ps: dict[str, str], scale: int = 2, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Count, sums, extremes and exact percentiles of ``value`` per ``key`` from one histogram of it.

    The rows are shuffled once, to (key, value, count). Everything else reads
    that histogram or its slice totals: all sums come from the slices, an
    array of slice counts a key says in which slice each percentile's
    neighbours lie, and a window looks only at those slices. A NULL key is a key.

    Columns: ``key``, ``_rows`` (NULL values too), ``_cnt``, ``_sum``, ``_min``, ``_max``, ``_sd_n``, ``_sd_s1``,
    ``_sd_s2`` (the sums of :func:`claimlens.functions.exprs.stddev_parts`) and one per name in ``ps``.
    """
    v = F.col(value)
    x = (v * F.lit(10 ** scale)).cast("decimal(20,0)")
    hist = df.groupBy(F.col(key).alias("_key"), v.alias(value)).agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_slice", F.when(v.isNotNull(), value_slice(v, buckets)))
    n = F.col("_n").cast("decimal(18,0)")
    known = F.when(v.isNotNull(), F.col("_n"))
    slices = hist.groupBy("_key", "_slice").agg(
        F.sum("_n").alias("_rows"), F.sum(known).alias("_cnt"), F.sum(v * n).alias("_sum"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.sum((x * n).cast("decimal(38,0)")).alias("_sd_s1"), F.sum(((x * x).cast("decimal(38,0)") * n).cast("decimal(38,0)")).alias("_sd_s2"))
    counts = F.collect_list(F.when(F.col("_slice").isNotNull(), F.struct("_slice", "_cnt")))  # the scale bounds a key's slices
    per_key = slices.groupBy("_key").agg(
        F.sum("_rows").alias("_rows"), F.coalesce(F.sum("_cnt"), F.lit(0)).alias("_cnt"), F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"),
        F.max("_max").alias("_max"), F.sum("_sd_s1").alias("_sd_s1"), F.sum("_sd_s2").alias("_sd_s2"), F.array_sort(counts).alias("_slices")) \
        .withColumn("_sd_n", F.col("_cnt"))

    def neighbours(name: str, p: str):
        at = (F.col("_cnt") - F.lit(1)).cast("decimal(20,0)") * F.lit(Decimal(p))
        return [F.struct(F.lit(f"{side}{name}").alias("tag"), end.cast("bigint").alias("pos")) for side, end in (("l", F.floor(at)), ("h", F.ceil(at)))]

    def located(t):
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("slice"), F.lit(None).cast("bigint").alias("inside"))
        found = F.aggregate("_slices", start, lambda a, s: F.struct(
            (a["seen"] + s["_cnt"]).alias("seen"), F.coalesce(a["slice"], F.when(a["seen"] + s["_cnt"] > t["pos"], s["_slice"])).alias("slice"),
            F.coalesce(a["inside"], F.when(a["seen"] + s["_cnt"] > t["pos"], t["pos"] - a["seen"])).alias("inside")))
        return F.struct(t["tag"].alias("tag"), found["slice"].alias("slice"), found["inside"].alias("inside"))

    wanted = F.array(*[t for name, p in ps.items() for t in neighbours(name, p)])
    targets = per_key.where("_cnt > 0").select(F.col("_key").alias("_tkey"), F.explode(F.transform(wanted, located)).alias("t")) \
        .groupBy("_tkey", F.col("t.slice").alias("_tslice")).agg(F.collect_list("t").alias("_targets"))
    near = hist.join(targets, F.col("_key").eqNullSafe(F.col("_tkey")) & (F.col("_slice") == F.col("_tslice")))
    w = Window.partitionBy("_key", "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.sum("_n").over(w))
    here = F.filter("_targets", lambda t: (t["inside"] >= F.col("_upto") - F.col("_n")) & (t["inside"] < F.col("_upto")))
    picked = near.select("_key", value, F.explode(here).alias("t"))
    picked = picked.groupBy(F.col("_key").alias("_pkey")).agg(*[F.max(F.when(F.col("t.tag") == F.lit(f"{side}{name}"), v)).alias(f"_{side}{name}")
                                                             for name in ps for side in "lh"])
    both = per_key.join(picked, F.col("_key").eqNullSafe(F.col("_pkey")), "left")
    out = []
    for name, p in ps.items():
        at = (F.col("_cnt") - F.lit(1)).cast("decimal(20,0)") * F.lit(Decimal(p))
        out.append((F.col(f"_l{name}") + (F.col(f"_h{name}") - F.col(f"_l{name}")) * (at - F.floor(at))).alias(name))
    return both.select(F.col("_key").alias(key), "_rows", "_cnt", "_sum", "_min", "_max", "_sd_n", "_sd_s1", "_sd_s2", *out)


def top_k_ranked(df: DataFrame, value: str, tie_break: list[str], k: int) -> DataFrame:
    """The first ``k`` rows by ``value DESC NULLS FIRST`` (then ``tie_break``)
    with exact ``_rank``, RANGE ``_run_sum`` and ``_grand`` (SUM OVER ()) of
    ``value`` computed over the whole of ``df``.

    Every row strictly ahead of a top-k row is itself in the top k, so rank
    and running sums only need the top rows, plus - for the value at the cut -
    the number of its ties in the whole table. That count and the grand total
    are scalar subqueries (distributed aggregates); only ``k`` rows ever meet
    in one task.
    """
    v = F.col(value)
    order = [v.desc_nulls_first()] + [F.col(c).asc_nulls_last() for c in tie_break]
    top = df.orderBy(*order).limit(k)  # TakeOrderedAndProject: per-partition top-k, then merge
    grand = df.agg(F.sum(v)).scalar()
    cut = top.agg(F.min(v)).scalar()  # value at the cut; NULL when the top rows are all NULL
    cut_ties = df.where(v.eqNullSafe(cut)).agg(F.count(F.lit(1))).scalar()
    w_range = Window.orderBy(v.desc_nulls_first())  # k rows; default RANGE frame, ties share
    w_ties = Window.partitionBy(v)
    ranked = (top
              .withColumn("_rank", F.rank().over(w_range).cast("bigint"))
              .withColumn("_run_top", F.sum(v).over(w_range))
              .withColumn("_ties_top", F.count(F.lit(1)).over(w_ties))
              .withColumn("_grand", grand))
    missing = cut_ties - F.col("_ties_top")  # ties of the cut value that fell below the cut
    run = F.when(v.eqNullSafe(cut) & v.isNotNull(), F.col("_run_top") + v * missing).otherwise(F.col("_run_top"))
    return ranked.withColumn("_run_sum", run).drop("_run_top", "_ties_top")
