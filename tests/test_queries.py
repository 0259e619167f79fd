"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pandas as pd
import pytest

from xylem.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float | int) and not isinstance(v, bool) else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(want) or name in {"xp_sum", "xp_count", "xp_no_child"}


@pytest.mark.parametrize("name", [
    "ancestor_axis", "append_rename", "axes", "namespace_writer", "walks", "replace_and_remove", "orders_of_nodes", "remove_elements", "to_json", "typed_members", "schema_elements", "schema_tables", "dangling_refs"])
def test_no_join_passes_through_the_driver(spark, name):
    """Tables that grow with the input are small here, so that Spark would broadcast them if it were left to."""
    assert "Broadcast" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["to_map_reduce", "parent_axis", "distinct_attrs", "xp_count", "nth_and_range", "xp_sum"])
def test_reads_its_nodes_once_and_keeps_none(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "InMemoryTableScan" not in plan
