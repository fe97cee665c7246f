from __future__ import annotations

import math
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from claimlens.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="claimlens-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="claimlens-test-")


def _norm(v):
    if v is None:
        return (0, "")
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        f = float(v)
        return (1, "nan") if math.isnan(f) else (1, f)
    return (2, str(v))


def rows_of(df, cols=None):
    """Rows as sorted tuples of normalised values (order-insensitive compare)."""
    cols = cols or sorted(df.columns)
    return sorted(tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect())


def assert_same(a, b, cols=None):
    cols = cols or sorted(a.columns)
    assert sorted(a.columns) == sorted(b.columns), (a.columns, b.columns)
    ra, rb = rows_of(a, cols), rows_of(b, cols)
    assert len(ra) == len(rb), (len(ra), len(rb))
    diff = [(x, y) for x, y in zip(ra, rb) if x != y]
    assert not diff, diff[:3]
