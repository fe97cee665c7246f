"""End-to-end jobs: what running the source script does, as two Spark jobs.

* :func:`load_job` — extract CSV -> star schema with roll-ups, checked against
  its constraints and then published as one version;
* :func:`report_job` — every KPI query and summary view over a written star,
  each written (sorted by its ORDER BY) under an output root.

Both read and write shared storage only; intermediates go to
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlens.operators import kpis, quality, summaries
from claimlens.plans.base import Star
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources import loaders, sinks, staging, versions

# The KPI queries in the order the analysis presents them.
KPI_QUERIES = {
    "specialty_spend": kpis.specialty_spend,
    "specialty_unit_cost": kpis.specialty_unit_cost,
    "provider_outliers": kpis.provider_outliers,
    "top_procedures": kpis.top_procedures,
    "provider_efficiency": kpis.provider_efficiency,
}
# those whose ORDER BY begins with a text
BY_SPECIALTY = {"provider_outliers", "provider_efficiency"}


class LoadError(ValueError):
    """A load that violates the schema's constraints; nothing was published."""


def load_job(spark: SparkSession, extract_path: str, star_root: str, state: str = loaders.DEFAULT_STATE,
             multi_line: bool | None = None, keep_codes: bool = True) -> dict[str, int]:
    """Load one extract as a new version of the star at ``star_root``.

    The tables and the constraint report are written first; any violation
    raises and leaves the published version as it was. With ``keep_codes`` the
    codes already published stay, and only new ones are added (ON CONFLICT DO
    NOTHING); a load that finds another one published meanwhile adds its codes
    to that one's and tries again. Returns the violation count per check: all zero.
    """
    ensure_checkpoint_dir(spark)
    star_root = star_root.rstrip("/")
    loaded = loaders.load_star(staging.read_staging(spark, extract_path, multi_line=multi_line), state)
    base = versions.published(spark, star_root) if keep_codes else None
    own_codes, loaded.codes = loaded.codes, with_known_codes(spark, star_root, loaded.codes, base)
    version = sinks.write_version(loaded, star_root)
    report_at = f"{star_root}/versions/{version}/_quality"
    quality.quality_report(sinks.read_star(spark, star_root, version=version)).write.parquet(report_at)
    rows = spark.read.parquet(report_at).collect()  # ~25 summary rows
    found = {f"{r.table_name}.{r.check_name}.{r.column_name}": r.violations for r in rows}
    if wrong := {k: v for k, v in found.items() if v}:
        raise LoadError(f"load of {extract_path} violates constraints, nothing published: {wrong}")
    if not keep_codes:
        sinks.publish(spark, star_root, version)
        return found
    while True:
        try:
            versions.publish(spark, star_root, version, base)
            return found
        except versions.PublishConflict:  # another load came first: its codes are known codes now
            base = versions.published(spark, star_root)
            sinks.write_codes(with_known_codes(spark, star_root, own_codes, base), star_root, version)


def with_known_codes(spark: SparkSession, star_root: str, codes: DataFrame, base: versions.Published | None) -> DataFrame:
    """The codes of a published star and, of ``codes``, those it does not have (ON CONFLICT DO NOTHING)."""
    if base is None:
        return codes
    existing = sinks.read_star(spark, star_root, version=base.version).codes
    return existing.unionByName(loaders.new_codes(codes, existing))


def report_job(spark: SparkSession, star_root: str, out_root: str, fmt: str = "parquet", collation: str | None = None) -> dict[str, str]:
    """Run every KPI query and summary view over the published star at ``star_root``; ``collation`` orders texts."""
    ensure_checkpoint_dir(spark)
    out_root = out_root.rstrip("/")
    paths = {}
    with versions.lease(spark, star_root) as at:  # the version stays until the last table is written
        star: Star = sinks.read_star(spark, star_root, version=at.version)
        for name, fn in KPI_QUERIES.items():
            path = f"{out_root}/{name}"
            # each KPI already carries its ORDER BY (a distributed range sort)
            by_text = {"collation": collation} if collation and name in BY_SPECIALTY else {}
            sinks.export_summary(fn(star, **by_text), path, fmt)
            paths[name] = path
        paths.update(summaries.export_views(star, out_root, fmt, collation))
    return paths
