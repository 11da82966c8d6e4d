"""Every registered query against its SQL on the smallest tables; those without SQL have tests of their own beside."""

from pathlib import Path

import duckdb
import pytest

from topicloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    show = lambda df: df[cols].map(lambda x: "~" if x is None or x != x else str(x)).sort_values(cols).reset_index(drop=True)
    assert show(got).equals(show(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 75
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_members_of_the_whole_join(spark, con, data):
    """Queries without SQL read every lineitem row."""
    joined = "FROM lineitem JOIN part ON p_partkey = l_partkey"
    parts = QUERIES["split_concept_parts"](spark, data)
    assert {(r["concept"], r["key"]) for r in parts.collect()} == set(con.sql(f"SELECT DISTINCT p_brand, p_size::VARCHAR {joined}").fetchall())
