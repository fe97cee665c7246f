import os

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def make(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(df, duck, sql):
    a = df.toPandas()
    b = duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x = sorted(map(tuple, a[cols].astype(object).where(a[cols].notna(), None).values.tolist()), key=str)
    y = sorted(map(tuple, b[cols].astype(object).where(b[cols].notna(), None).values.tolist()), key=str)
    assert x == y


#: Null, empty, blank, punctuation, long and repeated texts; null and repeated ids.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "!!! ... 123"), (5, "one"), (5, "one"), (None, "a null id"), (7, "word " * 30000),
       (8, "é漢字 \U0001f642 mixed \x00 text"), (9, "x" * 50000)]
assert os.path.isdir(SF)
