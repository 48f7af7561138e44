"""Tables with more than 100,000 parts, where the ids of top_sqls are those of several statements: queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.sources.adapters import load

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The small tables twice with parts 100,001 apart, so that statements of a report and of that of the next year share ids."""
    out = tmp_path_factory.mktemp("shifted")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "events"):
        c.execute(f"COPY (SELECT * FROM '{SRC}/{t}.parquet') TO '{out}/{t}.parquet'")
    n = c.sql(f"SELECT max(o_orderkey) FROM '{SRC}/orders.parquet'").fetchall()[0][0]
    shift = 100_001
    twice = lambda cols, t: f"SELECT * REPLACE ({cols}) FROM '{SRC}/{t}.parquet', (SELECT unnest([0, 1]) AS r)".replace("SELECT *", "SELECT * EXCLUDE (r)")
    c.execute(f"COPY ({twice(f'p_partkey + r * {shift} AS p_partkey', 'part')}) TO '{out}/part.parquet'")
    c.execute(f"COPY ({twice(f'o_orderkey + r * {n} AS o_orderkey', 'orders')}) TO '{out}/orders.parquet'")
    c.execute(f"COPY ({twice(f'l_orderkey + r * {n} AS l_orderkey, l_partkey + r * {shift} AS l_partkey', 'lineitem')}) TO '{out}/lineitem.parquet'")
    return str(out)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 4) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = entry.queries()[name](spark, folder)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_ids_are_shared(spark, shifted):
    t = load(spark, shifted, "top_sqls")
    assert t.select("id").distinct().count() < t.count()


@pytest.mark.parametrize("name", ["agg.hot_issues", "agg.issue_summary", "agg.severity_counts", "aud.bulk_update", "aud.cartesian", "aud.expensive_func", "aud.full_scan", "aud.hash_join_large", "aud.inefficient_join", "aud.missing_index", "aud.missing_stats", "aud.nested_loop_index"])
def test_audit(spark, shifted, name):
    same_as_sql(spark, shifted, name)


@pytest.mark.parametrize("name", ["join.predicate_info", "plan.parse_tabular_ui", "agg.plan_metadata", "agg.saved_plan_meta"])
def test_plans(spark, shifted, name):
    same_as_sql(spark, shifted, name)
