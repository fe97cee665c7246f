"""Fact measures and the roll-ups every query reads.

All KPIs and views are sums or distinct counts over utilization facts, by
provider, by code, or by specialty. The load writes three roll-ups once, each
far smaller than the facts: per provider, per code, and the distinct
(specialty, code) pairs. Queries read those; a :class:`Star` without stored
roll-ups computes them from its facts. Decimal sums are exact, so both give
identical results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.plans.materialize import join_grown

# Measure columns carried by every fact-like frame.
SUM_COLS = ["srv", "benes", "pay", "alw", "sub", "std"]


def measure_columns() -> dict[str, Column]:
    s = F.col("tot_srvcs")
    return {
        "srv": s,
        "benes": F.col("tot_benes"),
        "pay": F.col("avg_medicare_payment") * s,
        "alw": F.col("avg_medicare_allowed") * s,
        "sub": F.col("avg_submitted_charge") * s,
        "std": F.col("avg_medicare_standardized") * s,
    }


def measures(util: DataFrame) -> DataFrame:
    """Project facts to keys + additive measures (money totals = avg x services)."""
    return util.select("npi", "hcpcs_cd", *[c.alias(n) for n, c in measure_columns().items()])


def fact_pairs(util: DataFrame) -> DataFrame:
    """The distinct (npi, hcpcs_cd): every distinct count of the roll-ups is a row count over them."""
    return util.select("npi", "hcpcs_cd").distinct()


def roll_up(util: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """Per npi or hcpcs_cd: exact sums, and ``n_other`` distinct values of the other key.

    The sums are plain partial aggregates: a key on a third of all facts costs a
    row per task. The distinct count rides on the two columns of ``pairs``
    (spread by the other key), not on the wide sums.
    """
    other = "hcpcs_cd" if key == "npi" else "npi"
    sums = measures(util).groupBy(key).agg(*[F.sum(c).alias(c) for c in SUM_COLS])
    counts = (fact_pairs(util) if pairs is None else pairs).groupBy(F.col(key).alias("_k")).agg(F.count(other).alias("n_other"))
    joined = sums.join(counts, sums[key].eqNullSafe(counts["_k"]), "left")
    return joined.select(key, *SUM_COLS, F.coalesce("n_other", F.lit(0)).alias("n_other"))


def roll_up_marked(util: DataFrame, key: str, first: str) -> DataFrame:
    """:func:`roll_up` of facts whose boolean column ``first`` is true on one row of each distinct pair:
    sums and the count in one aggregate, without the pairs and without a join."""
    other = "hcpcs_cd" if key == "npi" else "npi"
    n_other = F.count(F.when(F.col(first) & F.col(other).isNotNull(), 1)).alias("n_other")
    marked = util.select(key, *[c.alias(n) for n, c in measure_columns().items()], first, other)
    return marked.groupBy(key).agg(*[F.sum(c).alias(c) for c in SUM_COLS], n_other)


def specialty_codes(util: DataFrame, providers: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Distinct (specialty, hcpcs_cd); pairs are reduced before they meet the providers."""
    pairs = fact_pairs(util) if pairs is None else pairs
    return join_grown(pairs, providers.select("npi", "provider_type"), "npi", hashed=True) \
        .select(F.col("provider_type").alias("specialty"), "hcpcs_cd").distinct()


def specialty_profile(providers: DataFrame) -> DataFrame:
    """One row: number of specialties, and providers of the largest."""
    per = providers.groupBy("provider_type").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("specialties"), F.max("n").alias("largest"))


@dataclass
class Star:
    """The three star-schema tables, with or without stored roll-ups."""

    providers: DataFrame
    codes: DataFrame
    utilization: DataFrame
    by_npi: DataFrame | None = None
    by_code: DataFrame | None = None
    by_specialty_code: DataFrame | None = None
    #: one row (specialties, largest), measured when the roll-ups were written
    profile: DataFrame | None = None
    _profile: dict = field(default_factory=dict, repr=False, compare=False)

    def rollup(self, key: str) -> DataFrame:
        stored = self.by_npi if key == "npi" else self.by_code
        return roll_up(self.utilization, key) if stored is None else stored

    def specialty_codes(self) -> DataFrame:
        if self.by_specialty_code is not None:
            return self.by_specialty_code
        return specialty_codes(self.utilization, self.providers)

    def settled(self, df: DataFrame) -> DataFrame:
        """A frame that is read more than once: as it is over stored roll-ups,
        written once where reading it would aggregate the facts again."""
        from claimlens.plans.materialize import reliable
        return df if self.by_npi is not None else reliable(df)

    def specialty_profile(self) -> tuple[int, int]:
        """(specialties, providers of the largest specialty): as stored with the
        roll-ups, else measured once on the providers dimension. Any
        per-specialty group of a query (providers with facts, providers above a
        volume floor) is at most this large."""
        if "specialty" not in self._profile:
            r = (specialty_profile(self.providers) if self.profile is None else self.profile).first()
            self._profile["specialty"] = (int(r["specialties"] or 0), int(r["largest"] or 0))
        return self._profile["specialty"]
