"""Command line: ``python -m claimlens load|report ...``.

    python -m claimlens load   --extract PATH --star ROOT [--state IL] [--lines auto|single|multi]
    python -m claimlens report --star ROOT --out ROOT [--format parquet|csv|json]
    python -m claimlens clean  --star ROOT [--keep 2]

Runs in the session that spark-submit or the cluster sets up: no master is forced,
and the scale defaults apply only where nothing else is set.
"""

from __future__ import annotations

import argparse
import json

from claimlens.jobs import load_job, report_job
from claimlens.session import cluster_session
from claimlens.sources.versions import remove_versions


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="claimlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="extract CSV -> star schema + constraint report")
    ld.add_argument("--extract", required=True)
    ld.add_argument("--star", required=True)
    ld.add_argument("--state", default="IL")
    ld.add_argument("--lines", choices=["auto", "single", "multi"], default="auto",
                    help="whether quoted fields span lines; auto: one pass over the extract decides")
    rp = sub.add_parser("report", help="every KPI query and summary view")
    rp.add_argument("--star", required=True)
    rp.add_argument("--out", required=True)
    rp.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    rp.add_argument("--collation", help="ICU collation of text order, e.g. UNICODE; default: binary")
    cl = sub.add_parser("clean", help="remove old versions that no reader holds")
    cl.add_argument("--star", required=True)
    cl.add_argument("--keep", type=int, default=2)
    args = ap.parse_args(argv)
    spark = cluster_session()
    if args.cmd == "load":
        out = load_job(spark, args.extract, args.star, args.state, 
                       multi_line={"auto": None, "single": False, "multi": True}[args.lines])
    elif args.cmd == "clean":
        out = remove_versions(spark, args.star, args.keep)
    else:
        out = report_job(spark, args.star, args.out, args.format, args.collation)
    print(json.dumps(out, indent=2, default=str))


if __name__ == "__main__":
    main()
