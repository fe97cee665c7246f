"""Benchmark: load the star schema once, then time every KPI query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Phases, mirroring how the reference is used (load tables, then query):

* ``load_star``: driver tables -> star schema written as parquet;
  ``rollups``: its three roll-ups (also part of a load);
* ``load_from_csv``: the same rows as one extract CSV through ``load_job``
  (inspected, scanned, normalised, written, checked, published);
  ``quality_report``: every constraint check on that loaded star;
* each query in three forms over the written tables: ``<name>`` over the stored
  roll-ups, as ``jobs.report_job`` runs it; ``facts/<name>`` the same operator
  on raw facts; ``naive/<name>`` a plain join-then-group form (scripts/naive.py).

Every form of a query runs once to warm up, then the forms are timed in
turn ``BENCH_REPS`` times (default 3, interleaved so that JIT warm-up and
machine drift fall on all forms alike); the median is reported. Output: one
JSON line on stdout; ``value`` is the production total with the roll-ups.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimlens.jobs import load_job  # noqa: E402
from claimlens.operators import kpis, quality, summaries  # noqa: E402
from claimlens.plans.base import Star  # noqa: E402
from claimlens.session import build_session, ensure_checkpoint_dir  # noqa: E402
from claimlens.sources import fixtures, sinks, staging  # noqa: E402
from scripts.naive import NAIVE  # noqa: E402

QUERIES = {
    "specialty_spend": kpis.specialty_spend,
    "specialty_unit_cost": kpis.specialty_unit_cost,
    "provider_outliers": kpis.provider_outliers,
    "top_procedures": kpis.top_procedures,
    "specialty_distribution": kpis.specialty_distribution,
    "provider_efficiency": kpis.provider_efficiency,
    "vw_specialty_summary": summaries.vw_specialty_summary,
    "vw_procedure_summary": summaries.vw_procedure_summary,
    "vw_provider_kpi": summaries.vw_provider_kpi,
}


def log(*a):
    print(*a, file=sys.stderr, flush=True)


def run(df_fn) -> float:
    t = time.perf_counter()
    df_fn().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def timed(df_fn, reps: int) -> float:
    run(df_fn)  # warm-up
    return statistics.median(run(df_fn) for _ in range(reps))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    forms = os.environ.get("BENCH_FORMS", "rollups,facts,naive,csv").split(",")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-star-{uuid.uuid4().hex}"

    times: dict[str, float] = {}
    t = time.perf_counter()
    sinks.write_star(Star(*fixtures.star(spark, sf_dir)), root, with_rollups=False)
    times["load_star"] = round(time.perf_counter() - t, 3)
    star = sinks.read_star(spark, root)
    t = time.perf_counter()
    sinks.publish(spark, root, sinks.write_rollups(star, root, sinks.published(spark, root)))
    times["rollups"] = round(time.perf_counter() - t, 3)
    rolled = sinks.read_star(spark, root)
    log("load_star", times["load_star"], "rollups", times["rollups"])

    if "csv" in forms:
        # the extract as one CSV file (untimed), then the timed load
        csv_dir = f"{root}-extract"
        staging.write_staging(fixtures.staging(spark, sf_dir).coalesce(1), csv_dir)
        t = time.perf_counter()
        load_job(spark, csv_dir, f"{root}-loaded")
        times["load_from_csv"] = round(time.perf_counter() - t, 3)
        log("load_from_csv", times["load_from_csv"])
        loaded = sinks.read_star(spark, f"{root}-loaded")
        times["quality_report"] = round(timed(lambda: quality.quality_report(loaded), reps), 3)
        log("quality_report", times["quality_report"])

    for name, fn in QUERIES.items():
        variants = {}
        if "rollups" in forms:
            variants[name] = lambda fn=fn: fn(rolled)
        if "facts" in forms:
            variants[f"facts/{name}"] = lambda fn=fn: fn(star)
        if "naive" in forms:
            variants[f"naive/{name}"] = lambda name=name: NAIVE[name](star)
        for g in variants.values():  # warm every form before timing any of them
            run(g)
        samples = {k: [] for k in variants}
        for _ in range(reps):  # interleave, so drift hits all forms alike
            for k, g in variants.items():
                samples[k].append(run(g))
        for k, v in samples.items():
            times[k] = round(statistics.median(v), 3)
            log(k, times[k])

    production = [times[q] for q in QUERIES if q in times]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "kpi_suite_total_sec",
        "value": round(sum(production) + times["rollups"], 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "reps": reps,
        "spark": spark.version,
        "driver_memory": spark.conf.get("spark.driver.memory", "?"),
    }
    if "facts" in forms:
        out["facts_total_sec"] = round(sum(times[f"facts/{q}"] for q in QUERIES), 3)
    if "rollups" in forms:
        out["queries_total_sec"] = round(sum(production), 3)
    if "naive" in forms:
        out["naive_total_sec"] = round(sum(times[f"naive/{q}"] for q in QUERIES), 3)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
