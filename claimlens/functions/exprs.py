"""Column expressions with PostgreSQL semantics, built from Spark built-ins.

Everything here returns a ``Column`` and stays inside whole-stage codegen:
no Python UDF is involved anywhere in the package.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operand types of exact division: numerators up to 10^22 and denominators up to
# 10^18 with four decimals (national totals at many times today's volume).
NUM_T = "decimal(26,4)"
DEN_T = "decimal(22,4)"
STAT_T = "decimal(24,6)"
INT_T = "decimal(38,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """``NULLIF(text, '')``."""
    return F.nullif(_c(c), F.lit(""))


def ratio(num, den, scale: int = 2, times: int = 1, guard: bool = True) -> Column:
    """``ROUND(num * times / NULLIF(den, 0), scale)``, half away from zero.

    Decided exactly: with both operands as integers A and B (in 1/10^4), the
    rounded absolute value in units of 10^-scale is the whole part of
    (2 A times 10^scale + B) / 2B, taken with the remainder. Without ``guard``
    a zero denominator raises (ANSI).
    """
    n, d = _c(num).cast(NUM_T), _c(den).cast(DEN_T)
    if guard:
        d = F.nullif(d, F.lit(0).cast(DEN_T))
    b = (F.abs(d) * F.lit(10 ** 4)).cast(INT_T)
    a = ((F.abs(n) * F.lit(2 * times * 10 ** scale * 10 ** 4)).cast(INT_T) + b).cast(INT_T)
    b2 = (b * F.lit(2)).cast(INT_T)
    m = ((a - a % b2).cast(INT_T) / b2).cast("decimal(36,0)")
    value = (m / F.lit(10 ** scale)).cast(f"decimal(38,{scale})")
    return F.when((n < 0) != (d < 0), -value).otherwise(value).cast(f"decimal(38,{scale})")


def round_stat(c, scale: int = 2) -> Column:
    """``ROUND(double::NUMERIC, scale)``: fix 6 places first, then round."""
    return F.round(_c(c).cast(STAT_T), scale)


def pg_concat(*cols) -> Column:
    """``CONCAT(a, b, ...)`` treating NULL as the empty string."""
    return F.concat(*[F.coalesce(_c(c), F.lit("")) for c in cols])


def text_order(c, collation: str | None = None) -> Column:
    """``ORDER BY`` of a text, NULLs last: in binary order, or by an ICU collation (as a database with that collation)."""
    return (_c(c) if collation is None else F.collate(_c(c), collation)).asc_nulls_last()


def full_name(first, last) -> Column:
    """``CONCAT(first_name, ' ', last_org_name)``."""
    return pg_concat(first, F.lit(" "), last)


def display_name(entity_type, first, last) -> Column:
    """Individuals get "first last", everyone else (incl. NULL type) the org name."""
    return F.when(_c(entity_type) == F.lit("I"), full_name(first, last)).otherwise(_c(last))


# Labels used by the procedure queries and the tier/flag CASEs.
DRUG_LABEL_RANKING = "Part B Drug (ASP-based)"
DRUG_LABEL_SUMMARY = "Part B Drug"
SERVICE_LABEL = "Professional Service"
HIGH_OUTLIER = "HIGH OUTLIER"
LOW_OUTLIER = "LOW OUTLIER"
WITHIN_RANGE = "Within Range"
ABOVE_IQR = "Above IQR (Higher Cost)"
BELOW_IQR = "Below IQR (Lower Cost)"
WITHIN_IQR = "Within IQR (Typical)"


def code_type(drug_indicator, drug_label: str) -> Column:
    """``CASE drug_indicator WHEN 'Y' THEN <drug_label> ELSE 'Professional Service' END``."""
    return F.when(_c(drug_indicator) == F.lit("Y"), F.lit(drug_label)).otherwise(F.lit(SERVICE_LABEL))


def outlier_flag(pct_deviation, threshold) -> Column:
    p = _c(pct_deviation)
    return (F.when(p > F.lit(threshold), F.lit(HIGH_OUTLIER))
            .when(p < F.lit(-threshold), F.lit(LOW_OUTLIER))
            .otherwise(F.lit(WITHIN_RANGE)))


def efficiency_tier(value, p25, p75) -> Column:
    v = _c(value)
    return (F.when(v > _c(p75), F.lit(ABOVE_IQR))
            .when(v < _c(p25), F.lit(BELOW_IQR))
            .otherwise(F.lit(WITHIN_IQR)))


# -- exact sample standard deviation ----------------------------------------

def stddev_parts(x, scale: int = 2, prefix: str = "_sd") -> list[Column]:
    """Aggregates from which :func:`stddev_rounded` decides ``ROUND(STDDEV(x), k)``
    exactly: count, and sums of ``X = x * 10^scale`` and ``X^2`` as integers.
    All three are ordinary partial aggregates (map-side combined)."""
    big = F.col(x) if isinstance(x, str) else x
    X = (big * F.lit(10 ** scale)).cast("decimal(38,0)")
    parts = [(F.count(big), "_n"), (F.sum(X), "_s1"), (F.sum((X * X).cast("decimal(38,0)")), "_s2")]
    return [a.alias(prefix + suffix) for a, suffix in parts]


def stddev_rounded(scale: int = 2, prefix: str = "_sd") -> Column:
    """``ROUND(STDDEV_SAMP(x), scale)`` as PostgreSQL computes it on numerics.

    With integer ``X = x * 10^scale`` the sample variance of ``X`` is exactly
    ``D / (n(n-1))`` with ``D = n*sum(X^2) - sum(X)^2``; the rounded result
    times ``10^scale`` is the integer ``m`` with
    ``(2m-1)^2 n(n-1) <= 4D < (2m+1)^2 n(n-1)``. A double estimate of ``m`` is
    corrected by one step with that exact test. NULL for fewer than 2 values.
    Inputs must carry at most ``scale`` decimals.
    """
    n = F.col(f"{prefix}_n").cast("decimal(38,0)")
    s1, s2 = F.col(f"{prefix}_s1"), F.col(f"{prefix}_s2")
    nn = F.when(n >= F.lit(2), n * (n - F.lit(1)))  # NULL below two values
    d = n * s2 - s1 * s1
    m0 = F.round(F.sqrt(d.cast("double") / nn.cast("double"))).cast("decimal(38,0)")

    def bound(m, off):
        t = F.lit(2) * m + F.lit(off)
        return (t * t).cast("decimal(38,0)") * nn

    four_d = F.lit(4) * d
    m = (F.when((m0 > F.lit(0)) & (four_d < bound(m0, -1)), m0 - F.lit(1))
          .when(four_d >= bound(m0, 1), m0 + F.lit(1))
          .otherwise(m0))
    return (m.cast(f"decimal(38,{scale})") / F.lit(10 ** scale)).cast(f"decimal(24,{scale})")
