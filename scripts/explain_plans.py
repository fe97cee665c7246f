"""Print ``explain("formatted")`` of every KPI / view over a written star.

    python scripts/explain_plans.py [sf_dir] [query ...]

Writes the star schema of ``sf_dir`` once into the checkpoint folder, then
prints each plan: check ``ReadSchema`` / ``PushedFilters`` on the scans, the
number of ``Exchange`` nodes, broadcast vs sort-merge joins.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimlens.operators import kpis, summaries  # noqa: E402
from claimlens.plans.base import Star  # noqa: E402
from claimlens.session import build_session, ensure_checkpoint_dir  # noqa: E402
from claimlens.sources import fixtures, sinks  # noqa: E402

NAMES = ["specialty_spend", "specialty_unit_cost", "provider_metrics", "provider_outliers",
         "top_procedures", "specialty_distribution", "provider_efficiency",
         "vw_specialty_summary", "vw_procedure_summary", "vw_provider_kpi"]


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    only = args[1:] or NAMES
    spark = build_session()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/explain-star-{uuid.uuid4().hex}"
    p, c, u = fixtures.star(spark, sf)
    sinks.write_star(Star(p, c, u), root)
    star = sinks.read_star(spark, root)
    for name in only:
        fn = getattr(kpis, name, None) or getattr(summaries, name)
        print(f"\n===== {name} =====")
        fn(star).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
