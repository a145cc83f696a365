"""Every catalogue query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from colforest import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(cols, records):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(r[c]) for c in cols]) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols, got = sorted(df.columns), [r.asDict() for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r)) for r in result.fetchall()]
    assert sorted(names) == cols
    assert rows(cols, got) == rows(cols, want)


def test_size_texts_of_large_keys(spark, tmp_path):
    """Keys beyond those of sf0.01: sizes of 1,024 GB and more, ties of the decimal, a null."""
    keys = [0, 1, 4, 128, 4095, 4096, 131071, 131072, 131073, 149999, 8999999, 2048 * 5793, 2048 * 5795, 379625062, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = {r.o_orderkey: r.text for r in catalog.QUERIES["size_texts"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalog.SQL["size_texts"]).fetchall())
    assert got[131072] == "1024.0 GB" and got[2048 * 5793] == "8389712.2 GB" and got[None] is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
