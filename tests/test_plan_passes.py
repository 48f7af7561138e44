"""Plan queries read each plan's text once, without a join of its nodes, and make only the columns they need."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from tidemark.plans import analysis, parse

NEEDS = ("agg.node_severity", "plan.contains", "plan.save_list", "plan.opt_confidence", "plan.analyze", "agg.finding_stats", "agg.table_names", "srt.plan_cost")


@pytest.mark.parametrize("name", NEEDS)
def test_one_pass(spark, name):
    with redirect_stdout(io.StringIO()) as out:
        entry.queries()[name](spark, "/root/testdata/sf0.001").explain()
    steps = [x for x in out.getvalue().splitlines() if "MapInArrow" in x]
    assert len(steps) == 1 and " path#" not in steps[0]


def test_children_in_the_row_give_what_the_join_gives(spark):
    text = "Nested Loop  (cost=0.00..5000.00 rows=5 width=1)\n  ->  Seq Scan on a  (cost=0.00..1.00 rows=20000 width=1)\n  ->  Index Scan using i on b  (cost=0.00..1.00 rows=1 width=1)\n  ->  Nested Loop  (cost=0.00..2.00 rows=1 width=1)\n        ->  Subquery Scan on x  (cost=0.00..1.00 rows=1 width=1)\n        ->  Subquery Scan on y  (cost=0.00..1.00 rows=1 width=1)\n        ->  Subquery Scan on z  (cost=0.00..1.00 rows=1 width=1)"
    plans = spark.createDataFrame([(1, text), (2, None), (3, "no plan")], "plan_id long, plan_text string")
    hits = lambda n: sorted((r["plan_id"], r["node_id"], r["rule_id"]) for r in analysis.ui_rules(n).collect())
    joined = hits(parse.parse_text(plans))
    assert joined == hits(parse.parse_text(plans, [*parse.NODE])) and (1, 3, "Gauss-XN-012") in joined and (1, 0, "Gauss-XN-004") not in joined


def test_texts_are_cut_once(spark):
    with redirect_stdout(io.StringIO()) as out:
        entry.queries()["plan.split_two"](spark, "/root/testdata/sf0.001").explain()
    # what is parsed is read from the texts that were cut, not from the orders
    assert "orders.parquet" not in out.getvalue() and out.getvalue().count("SortMergeJoin") <= 1
