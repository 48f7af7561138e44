"""Plan parsing, analysis, diff, lint and rewrites on golden cases."""

import json

import pytest

from tidemark.plans import analysis, lint, parse

TREE = """Hash Join  (cost=10.00..2000.50 rows=500000 width=100) (actual time=1.0..3200.5 rows=490 loops=1)
  Hash Cond: (t1.a = t2.a)
  ->  Seq Scan on t1  (cost=0.00..1500.00 rows=200000 width=100)
        Filter: (id = 100)
  ->  Nested Loop  (cost=1.0..1200.0 rows=30000 width=4)
        ->  Index Scan using idx_t2 on t2  (cost=0.42..8.49 rows=1 width=100)
              Filter: (x > 1)
        ->  Sort  (cost=0.00..900.00 rows=20000 width=10)
              Sort Method: external merge  Disk: 5kB"""
TABLE = """ id | operation                    | E-rows | E-width | E-costs
----+------------------------------+--------+---------+---------
  1 | ->  Streaming (type: GATHER) | 20     | 16      | 28.69
  2 |    ->  Hash Join (3,4)       | 20     | 16      | 27.37
  3 |       ->  Seq Scan on t1     | 20     | 8       | 13.13

 Predicate Information (identified by plan id)
   2 --Hash Join (3,4)
         Hash Cond: (t1.a = t2.a)
"""
JSON = [{"Plan": {"Node Type": "Hash Join", "Join Type": "Inner", "Total Cost": 50.0, "Plan Rows": 5, "Hash Cond": "(v.shop = s.nr)", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "visits", "Total Cost": 31.75, "Plan Rows": 820, "Plan Width": 36, "Actual Rows": 790, "Actual Total Time": 4.125, "Filter": "(day > 9)"}, {"Node Type": "Seq Scan", "Relation Name": "shops"}]}}]


@pytest.fixture(scope="module")
def nodes(spark):
    return parse.parse_plans(plans(spark, TREE)).cache()


def plans(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "plan_id long, plan_text string")


def rows(df, *order):
    return df.orderBy(*(order or ("plan_id", "node_id"))).collect()


def test_text_tree(nodes):
    r = rows(nodes)
    assert [(x["parent_id"], x["depth"], x["path"]) for x in r] == [(None, 0, [0]), (0, 1, [0, 0]), (0, 1, [0, 1]), (2, 2, [0, 1, 0]), (2, 2, [0, 1, 1])]
    assert (r[0]["total_cost"], r[0]["est_rows"], r[0]["actual_time"], r[0]["actual_rows"], r[0]["loops"]) == (2000.5, 500000, 3200.5, 490, 1)
    assert r[0]["details"] == "Hash Cond: (t1.a = t2.a)" and r[1]["operation"] == "Seq Scan on t1" and r[3]["operation"] == "Index Scan using idx_t2 on t2"


def test_tables_and_json(spark):
    r = rows(parse.parse_plans(plans(spark, TABLE, json.dumps(JSON))))
    assert (r[0]["est_rows"], r[0]["width"], r[0]["total_cost"], r[0]["actual_rows"]) == (20, 16, 28.69, None)
    assert [x["depth"] for x in r[:3]] == [0, 1, 2] and "Hash Cond" in r[1]["details"] and r[1]["ext_id"] == "2"
    visits = r[4]
    assert (visits["operation"], visits["total_cost"], visits["est_rows"], visits["actual_rows"], visits["actual_time"]) == ("Seq Scan on visits", 31.75, 820, 790, 4.125)
    assert "Hash Cond: (v.shop = s.nr)" in r[3]["details"]


def test_texts_without_a_plan(spark):
    assert parse.parse_plans(plans(spark, None, "", "nothing here", "{bad json", "[]", "{}")).count() <= 1


def test_statement_and_plan(spark):
    text = "SELECT *\nFROM t1, t2\n QUERY PLAN\n----------\n" + TREE
    out = parse.split_sql_and_plan(plans(spark, text))
    assert out.first()["sql_text"] == "SELECT *\nFROM t1, t2" and parse.parse_text(out).count() == 5


@pytest.mark.parametrize(("text", "parts"), [(f"EXPLAIN ANALYZE\n{TREE}\nEXPLAIN ANALYZE\n{TREE}", 2), (TABLE + "\n" + TABLE, 2), (TREE + "\n  d: 1" * 12 + "\n" + TREE, 2), (TREE.split("\n")[0] + "\n==============\n" + TREE.split("\n")[0], 2), (TREE, 1)])
def test_split_two(spark, text, parts):
    r = parse.split_two(plans(spark, text)).first()
    assert bool(r["right_text"]) == (parts == 2) and r["left_text"]
    if parts == 2:
        n = [parse.parse_plans(plans(spark, r[f"{side}_text"])).count() for side in ("left", "right")]
        assert n[0] == n[1] > 0


def test_costs_and_metadata(nodes):
    r = rows(analysis.self_cost(nodes))
    assert [x["self_cost"] for x in r] == [0.0, 1500.0, pytest.approx(291.51), 8.49, 900.0] and r[0]["percentage"] == 100.0
    m = analysis.metadata(nodes).first()
    assert (m["total_cost"], m["plan_depth"], m["node_count"], m["has_actual_stats"]) == (2000.5, 3, 5, True)


def test_rule_sets(nodes):
    core = {(x["node_id"], x["rule_id"]) for x in analysis.core_rules(nodes).collect()}
    assert core == {(0, "hash_join"), (0, "estimate"), (1, "seq_scan"), (1, "filter_scan"), (2, "nested_loop"), (4, "sort")}
    ui = {(x["node_id"], x["rule_id"][-3:]) for x in analysis.ui_rules(nodes).collect()}
    assert ui == {(0, "001"), (0, "006"), (1, "002"), (3, "009"), (4, "008")}
    assert {x["rule_id"] for x in analysis.alternative_rules(nodes).collect()} == {"nested_loop", "sort", "cost"}
    assert {x["rule_id"] for x in analysis.catalog_findings(nodes).collect()} >= {"SCAN-001", "MEM-001", "EST-001"}
    assert analysis.analysis(nodes).first()["score"] == 70


def test_advice(nodes):
    a = {(x["node_id"], x["kind"]): x["statement"] for x in analysis.advice(nodes).collect()}
    assert a[1, "index"] is None or "CREATE INDEX" in a[1, "index"]
    assert a[1, "statistics"] == "-- Consider: ANALYZE t1;" and (2, "rewrite") in a and (4, "rewrite") in a


def test_index_advice_names_the_column(spark):
    n = parse.parse_plans(plans(spark, "Seq Scan on visits  (cost=0.00..61.75 rows=820 width=36)\n  Filter: day = 9"))
    a = analysis.advice(n).filter("kind = 'index'").first()
    assert a["statement"] == "-- Consider: CREATE INDEX idx_visits_day ON visits(day);"


def test_diff(spark):
    left = parse.parse_plans(plans(spark, "Seq Scan on visits  (cost=0.00..214.00 rows=9400 width=36)"))
    right = parse.parse_plans(plans(spark, "Index Scan using idx_visits_day on visits  (cost=0.00..6.41 rows=1 width=36)"))
    m = analysis.match_nodes(left, right).first()
    d = analysis.diff(left, right).first()
    assert m["score"] == 80 and d["verdict"] == "improved" and d["new_risks"] == [] and d["resolved_risks"] == []
    assert analysis.verdict(left, right).first()["verdict"] == "Improved"


def test_diff_of_unlike_plans(spark):
    left = parse.parse_plans(plans(spark, "Sort  (cost=0.00..20000.00 rows=10 width=4)"))
    right = parse.parse_plans(plans(spark, "Seq Scan on t  (cost=0.00..5.00 rows=20000 width=4)"))
    got = {x["verdict"]: x for x in analysis.diff(left, right).collect()}
    assert set(got) == {"new", "removed"} and got["new"]["new_risks"] == ["largeSeqScan"] and got["removed"]["resolved_risks"] == ["highCost"]


def test_heatmap_and_waterfall(spark):
    n = parse.parse_plans(plans(spark, "A  (cost=0..9 rows=10 width=1) (actual time=0.0..100.0 rows=1000 loops=1)\n  ->  B  (cost=0..4 rows=10 width=1) (actual time=0.0..70.0 rows=10 loops=1)\n  ->  C  (cost=0..3 rows=10 width=1) (actual time=0.0..10.0 rows=0 loops=1)"))
    h = {x["operation"]: x for x in analysis.heatmap(n).collect()}
    assert h["A"]["q_error"] == 100.0 and h["C"]["q_error"] == 10.0 and [h[k]["critical"] for k in "ABC"] == [True, True, False]
    w = {x["operation"]: (x["own_ms"], x["bottleneck"]) for x in analysis.waterfall(n).collect()}
    assert w == {"A": (20.0, False), "B": (70.0, True), "C": (10.0, False)}


LINT = [
    ("SELECT * FROM users WHERE id = 1", "SELECT * retrieves"), ("SELECT id FROM users", "lacks WHERE"), ("SELECT id FROM users WHERE a = 1 OR b = 2", "OR conditions"), ("SELECT id FROM users WHERE n LIKE '%x'", "leading wildcard"),
    ("SELECT id FROM users WHERE id NOT IN (1)", "NOT IN"), ("INSERT INTO users VALUES (1)", "column specification"), ("UPDATE users SET a = 1", "UPDATE without WHERE"), ("DELETE FROM users", "DELETE without WHERE"), ("DELETE FROM users WHERE a = 1", "Large DELETE"),
]


def test_lint(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(LINT)] + [(99, "SELECT id FROM users WHERE id = 1"), (100, "VACUUM"), (101, None)], "id long, sql_text string")
    out = {r["id"]: r for r in lint.lint(df).collect()}
    for i, (_, words) in enumerate(LINT):
        assert sum(words in w for w in out[i]["warnings"]) == 1
    assert len(out[99]["warnings"]) == 2 and out[100]["warnings"] == [] and out[101]["kind"] is None


def test_rewrites(spark):
    df = spark.createDataFrame([(1, "SELECT * FROM users WHERE id = ?"), (2, "SELECT a FROM t WHERE x IN (SELECT y FROM u)")], "id long, sql_text string")
    schema = spark.createDataFrame([("users", ["id", "name"])], "table_name string, columns array<string>")
    got = {(r["id"], r["rule_id"]): r["rewritten"] for r in lint.rewrite(df, schema).collect()}
    assert got[1, "eliminate-select-star"] == "SELECT id, name FROM users WHERE id = ?"
    assert got[1, "detect-duplicate-eq-keys"] == "SELECT id, count(*) FROM users GROUP BY id HAVING count(*) > 1" and (2, "subquery-to-join") in got
    assert (1, "eliminate-select-star") in {(r["id"], r["rule_id"]) for r in lint.rewrite(df).collect()}
