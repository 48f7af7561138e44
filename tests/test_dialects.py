"""Parsers with results of their own: golden cases and odd input."""

import json

import pytest

from tidemark.plans import dialects, json_plans, parse

TREE = """Hash Join  (cost=1.50..20.25 rows=10 width=4)
  Hash Cond: (a.k = b.k)
  ->  Seq Scan on apples a  (cost=0.00..9.00 rows=500 width=4) (actual rows=44 loops=1) Filter: (x > 1)
        Filter: (x > 1)
  ->  Hash  (cost=1.00..1.25 rows=5 width=4)

        ->  Index Scan using idx_b on bananas b  (cost=0.10..1.25 rows=5 width=4)
Total runtime: 3 ms
  ->  behind the end"""
TABLE = """gaussdb=# EXPLAIN SELECT * FROM t;
 id | operation | E-rows
----+---
SET x
 1 | -> Row Adapter (x) | 20 | 16 | 28.69 | 11.5
 x | -> no number | 20 | 16 | 28.69 | 11.5
 2 |    ->  Seq Scan on t | 5 | 6x | 7 | 8
 Predicate Information
----
 3 | no | node
"""


def plans(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "plan_id long, plan_text string")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("plan_id", "node_id").select("plan_id", "node_id", "parent_id", "depth", *cols).collect()]


def test_core_text(spark):
    out = dialects.parse_core_text(plans(spark, TREE, "", "\nSort", None, "Sort")).cache()
    assert rows(out, "operation", "total_cost", "est_rows", "actual_rows") == [
        (0, 0, None, 0, "Hash", 20.25, 10, None), (0, 1, 0, 1, "Hash", 0.0, 0, None), (0, 2, 0, 1, "->  Seq Scan", 9.0, 500, 44), (0, 3, 2, 2, "Filter:", 0.0, 0, None), (0, 4, 0, 1, "->", 1.25, 5, None),
        (0, 5, 4, 2, "->  Index Scan using idx_b", 1.25, 5, None), (4, 0, None, 0, "Sort", 0.0, 0, None),
    ]
    assert [r[4:] for r in rows(out, "table_name", "index_name", "filter", "join_type")][:6] == [(None, None, None, "Hash Join"), (None, None, None, None), ("apples", None, "(x > 1", None), (None, None, None, None), (None, None, None, None), ("bananas", "idx_b", None, None)]


def test_core_text_behind_a_statement(spark):
    asked = "SELECT 1\nFROM t;\n\n Seq Scan on t  (cost=0.00..5.00 rows=7 width=1)\n   Filter: (z)"
    prompt = "gaussdb=# EXPLAIN SELECT 1;\n   QUERY PLAN\n------\n Seq Scan on t (cost=0.0..5.5 rows=7 width=1)\n   Filter: (z)"
    out = dialects.parse_core_text(plans(spark, asked, prompt, "gaussdb=# EXPLAIN SELECT 1;\n QUERY PLAN\n---\n", TABLE))
    assert rows(out, "operation", "total_cost", "output") == [(0, 0, None, 0, "SQL+PLAN", 5.0, "SQL: SELECT 1"), (0, 1, 0, 1, "Seq Scan", 5.0, None), (1, 0, None, 0, "SQL+PLAN", 5.5, "SQL: EXPLAIN SELECT 1;"), (1, 1, 0, 1, "Seq Scan", 5.5, None)]


def test_core_tables(spark):
    out = dialects.parse_core_tabular(plans(spark, TABLE, TREE, None, ""))
    assert rows(out, "operation", "total_cost", "est_rows", "table_name", "output") == [
        (0, 0, None, 0, "SQL+PLAN", 11.5, 20, None, "SQL: EXPLAIN SELECT * FROM t"), (0, 1, 0, 1, "Row Adapter", 11.5, 16, None, "-> Row Adapter (x)"), (0, 2, 1, 2, "Seq", 8.0, 0, "t", "->  Seq Scan on t"),
    ]


def test_diff_input(spark):
    table = "explain performance\n id | operation | A-time | A-rows | E-rows | cost\n---\n 1 | ->  Sort (x) | [1.5,2.5] | 3 | 4 | 1.0..9.5\n x | no\n 2 |   ->  Seq Scan on t | 1 | 2\n"
    out = dialects.parse_diff(plans(spark, "SET x = 1;\nEXPLAIN ANALYZE\n-- c -> d\n" + TREE, table, "nothing", None))
    assert rows(out, "ext_id", "operation", "total_cost", "actual_time") == [
        (0, 0, None, 0, None, "Hash Join", 20.25, None), (0, 1, 0, 1, None, "Seq Scan on apples a", 9.0, None), (0, 2, 0, 1, None, "Hash", 1.25, None), (0, 3, 2, 2, None, "Index Scan using idx_b on bananas b", 1.25, None), (0, 4, 0, 1, None, "behind the end", 0.0, None),
        (1, 0, None, 0, "1", "Sort (x)", 9.5, 2.5), (1, 1, 0, 1, "2", "Seq Scan on t", 2.0, 1.0),
    ]


def deep(n):
    return {"Node Type": f"N{n}", "Plans": [deep(n - 1), {"Node Type": "leaf"}] if n else []}


def test_json_without_python(spark):
    out = parse.parse_json(plans(spark, json.dumps([{"Plan": deep(7)}]), '{"operation": "A", "cost": 2, "children": [7, {"operation": "B", "rows": "3"}]}', "{bad", "[]", "[[1]]", "7", None, '{"Plan": 1}'))
    got = rows(out, "operation")
    assert [r[1] for r in got if r[0] == 0] == list(range(15)) and [r[4] for r in got if r[0] == 0] == [f"N{i}" for i in range(7, -1, -1)] + ["leaf"] * 7
    assert [(r[2], r[3]) for r in got if r[0] == 0][7:10] == [(6, 7), (6, 7), (5, 6)]
    assert [r[3:] for r in got if r[0] == 1] == [(0, "A"), (1, "B")] and {r[0] for r in got} == {0, 1}
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()


def native(*children, **changed):
    return {"node_type": "Sort", "cost": 1.5, "rows": 2, "width": 3, "children": list(children)} | changed


@pytest.mark.parametrize(("plan", "n"), [(native(native(filter="f"), native(native())), 4), (native(native(cost=None)), 0), (native(native(rows=-1)), 0), (native(native(), 5), 0), ({k: v for k, v in native().items() if k != "children"}, 0), ([native()], 0), (native(actual_rows=7, output=["a", "b"]), 1)])
def test_native_json_counts_as_a_whole(spark, plan, n):
    assert json_plans.parse_native_json(plans(spark, json.dumps(plan), None, "{")).count() == n


ONE = "Sort  (cost=0.00..9.00 rows=1 width=4)\n  ->  Seq Scan on t  (cost=0.00..8.00 rows=1 width=4)"


@pytest.mark.parametrize(
    ("text", "left", "right"),
    [
        (f"explain analyze\n{ONE}\n explain  verbose\n{ONE}", f"explain analyze\n{ONE}", f"explain  verbose\n{ONE}"),
        (f" id | operation\n{ONE}\n id | operation\nx", f"id | operation\n{ONE}", "id | operation\nx"),
        (ONE + "\n  a: 1" * 10 + f"\n----\n\n-- two\n{ONE}", ONE + "\n  a: 1" * 10, f"----\n\n-- two\n{ONE}"),
        (ONE + "\n\n  a: 1" * 10 + f"\n-\nb\n-- two\n{ONE}", ONE + "\n\n  a: 1" * 10 + "\n-\nb", f"-- two\n{ONE}"),
        (f"{ONE}\n==========\n{ONE}", ONE, ONE),
        (f"{ONE}\nOptimized Plan:\n{ONE}", ONE, ONE),
        (f"short\n----------\n{ONE}\nPlan 2\n{ONE}", f"short\n----------\n{ONE}", ONE),
        (ONE, ONE, ""),
        (None, "", ""),
    ],
)
def test_cut_of_two_plans(spark, text, left, right):
    r = parse.split_two(plans(spark, text)).first()
    assert (r["left_text"], r["right_text"]) == (left, right)
