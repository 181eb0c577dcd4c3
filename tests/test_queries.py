"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents labels".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return made


def plain(rows):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_as_oracle(spark, con, name):
    df = queries.queries()[name](spark, DIR)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = [[r[c] for c in rel.columns] for r in df.collect()]
    assert plain(got) == plain(rel.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.queries()["range_sandwich"](spark, DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[-1]


def test_comma_join_is_an_equi_join(spark):
    plan = queries.queries()["join_comma"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "HashJoin" in plan or "SortMergeJoin" in plan
