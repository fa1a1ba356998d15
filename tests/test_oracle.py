"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    df = __spark_entry__.queries()[name](spark, sf)
    con.execute(__spark_entry__.oracle_sql()[name])
    columns, want = [d[0] for d in con.description], con.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_the_library_does_not_import_the_subpackage():
    import pathlib
    import re

    top = pathlib.Path(__spark_entry__.__file__).parent / "linkloom"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
