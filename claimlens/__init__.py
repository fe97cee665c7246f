"""claimlens: provider x procedure claims analytics on Spark DataFrames.

Layout
------
sources/    CSV staging scan, star-schema loads, driver-table fixtures, export sinks
functions/  column expressions (exact decimal ratios, NULL handling, labels)
plans/      hand-shaped plan pieces Catalyst does not derive on its own
            (shared pre-aggregate, checked broadcast, distributed rank/percentile)
operators/  the KPI queries, summary views and data-quality checks
streaming/  incremental loading of newly arriving extract files
jobs.py     end-to-end load and report jobs (``python -m claimlens``)
"""

from claimlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
