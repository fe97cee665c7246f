"""Driver contract: entry smoke, and every query against its DuckDB oracle."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 23
    assert df.columns[:3] == ["specialty", "specialty_rank", "npi"]


# the queries of the optional subpackage have tests of their own
CORE = sorted(set(entry.queries()) - set(entry._training_data()[0]))


def test_every_query_has_an_oracle():
    assert set(CORE) == set(entry.oracle_sql()) - set(entry._training_data()[1])


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    import importlib

    real = importlib.import_module

    def without(name, *a):
        if name in ("claimlens.llm.registry", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named '{name}'", name="claimlens.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert sorted(entry.queries()) == CORE and set(entry.oracle_sql()) == set(CORE)

    def broken(name, *a):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return con


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda j: cols[j])

    def norm(v):
        if v is None:
            return (0, "")
        if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
            f = float(v)
            return (1, "nan" if math.isnan(f) else f)
        return (2, str(v))
    return sorted(tuple(norm(r[j]) for j in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle_sf0001(spark, duck, name):
    sdf = entry.queries()[name](spark, SF001)
    cur = duck.execute(entry.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _canon(sdf.columns, srows) == _canon(ocols, orows)


def test_extract_of_a_large_table_is_cut_in_files_without_a_shuffle_of_its_lines(spark, monkeypatch):
    import gzip
    import pathlib

    from claimlens.sources import fixtures, staging
    from tests.conftest import assert_same

    monkeypatch.setattr(entry, "EXTRACT_LINES", 300)  # 6,000 lines: a large table
    shuffled = []
    write = staging.write_staging
    monkeypatch.setattr(staging, "write_staging", lambda df, *a, **k: (shuffled.append("RoundRobin" in df._jdf.queryExecution().toString()), write(df, *a, **k)))
    path = entry._extract(spark, SF001)
    files = sorted(pathlib.Path(path.removeprefix("file:")).glob("part-*"))
    lines = [len(gzip.open(f).read().splitlines()) - 1 for f in files]
    assert shuffled == [False] and len(files) >= 20 and max(lines) <= 300
    want = fixtures.staging(spark, SF001)
    assert sum(lines) == want.count()
    assert_same(staging.read_staging(spark, path), want)


def test_stream_loads_a_large_extract_in_as_many_batches_as_a_small_one(spark, monkeypatch):
    from claimlens.streaming import ingest
    from tests.conftest import assert_same

    seen = []
    load = ingest.load_batch
    monkeypatch.setattr(ingest, "load_batch", lambda *a, **k: (seen.append(a[1]), load(*a, **k))[1])
    small = entry.queries()["ingest_stream_utilization"](spark, SF001)
    assert len(seen) == 4
    seen.clear()
    monkeypatch.setattr(entry, "EXTRACT_LINES", 200)  # 30 files or more
    large = entry.queries()["ingest_stream_utilization"](spark, SF001)
    assert len(seen) == 4
    assert_same(large, small)
