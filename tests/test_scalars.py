"""Scalar functions: golden cases, boundaries and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn


def value(spark, column, **inputs):
    df = spark.range(1)
    for k, v in inputs.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "number"), [("1,234.5", 1234.5), ("", 0.0), ("x", 0.0), (None, 0.0), (" 7 ", 7.0)])
def test_num_commas(spark, text, number):
    assert value(spark, fn.num_commas(F.lit(text).cast("string"))) == number


def test_whole_numbers_with_a_fraction_are_none(spark):
    assert value(spark, fn.num_commas(F.lit("12.5"), "long")) == 0 and value(spark, fn.num_commas(F.lit("12,345"), "long")) == 12345


@pytest.mark.parametrize(("text", "number"), [("45.2%", 45.2), ("12,500", 12500.0), ("3 ms", 3.0), ("-", 0.0), ("1e3", 1000.0)])
def test_num_pct(spark, text, number):
    assert value(spark, fn.num_pct(F.lit(text))) == number


@pytest.mark.parametrize(("text", "number"), [("[378.601,400.2]", 400.2), ("[5]", 5.0), ("7.5", 7.5), ("", 0.0)])
def test_num_range(spark, text, number):
    assert value(spark, fn.num_range(F.lit(text))) == number


def test_fingerprint_classes(spark):
    a, b, c = (value(spark, fn.fingerprint(F.lit(x))) for x in ("select  *\n from T", " SELECT * FROM t ", "SELECT * FROM u"))
    assert a == b != c


@pytest.mark.parametrize(("changes", "score"), [({"sql_elapsed_time": -50.0, "sql_cpu_time": -30.0, "buffer_hit_ratio": 20.0}, 38), ({"sql_elapsed_time": 50.0, "sql_cpu_time": 30.0, "buffer_hit_ratio": -20.0}, -38), ({"sql_elapsed_time": 20.0, "sql_cpu_time": -10.0, "buffer_hit_ratio": 5.0}, -5), ({}, 0), ({"sql_elapsed_time": -1e6}, 100)])
def test_score(spark, changes, score):
    assert value(spark, fn.performance_score({k: F.lit(v) for k, v in changes.items()})) == score


def test_pct_change(spark):
    assert value(spark, fn.pct_change(F.lit(0), F.lit(5))) is None
    assert [round(value(spark, fn.pct_change(F.lit(a), F.lit(b))), 3) for a, b in ((1000, 800), (50000, 35000), (45000, 32000), (5000, 3000))] == [-20.0, -30.0, -28.889, -40.0]


@pytest.mark.parametrize(("change", "severity"), [(14.9, None), (15.0, "Info"), (20.0, "Warning"), (-50.0, "Critical")])
def test_elapsed_findings(spark, change, severity):
    assert value(spark, fn.finding_severity(F.lit(change), 15, 50, 20)) == severity


@pytest.mark.parametrize(("change", "severity"), [(29.9, None), (30.0, "Warning"), (60.0, "Critical")])
def test_disk_findings(spark, change, severity):
    assert value(spark, fn.finding_severity(F.lit(change), 30, 60)) == severity


@pytest.mark.parametrize(("sql", "ok"), [("SELECT * FROM users", True), ("", False), ("SELECT * FROM (SELECT * FROM users", False), ("SELECT * FROM users WHERE id = 1; AND", False), ("SELECT ')' FROM t;", True), ("FOO", False), ("SELECT 1) + (2", False)])
def test_validate(spark, sql, ok):
    assert (value(spark, fn.validate_sql(F.lit(sql))) is None) == ok


@pytest.mark.parametrize("prefix", ["EXPLAIN (FORMAT JSON) ", "explain analyze ", "EXPLAIN (ANALYZE, BUFFERS) ", "EXPLAIN ", ""])
def test_strip_explain(spark, prefix):
    assert value(spark, fn.strip_explain(F.lit(prefix + "SELECT * FROM products;"))) == "SELECT * FROM products"


def test_table_names(spark):
    assert value(spark, fn.table_names(F.lit("SELECT * FROM users u JOIN orders o ON u.id = o.id join orders x"))) == ["users", "orders"]
    assert value(spark, fn.table_names(F.lit("SELECT 1"))) == []


def test_hints(spark):
    assert value(spark, fn.hints(F.lit("select /*+ leading((a b)) hashjoin(a b) */ 1 /*+ tablescan(a) */"))) == ["hintLeading", "hintJoinMethod", "hintScan"]


def test_detect_sql_with_plan(spark):
    plan = " QUERY PLAN\n->  Hash Join  (cost=1..2 rows=1 width=1)"
    assert [value(spark, fn.detect_sql_with_plan(F.lit(x))) for x in (plan, "SELECT 1\n" + plan, "SELECT 1")] == [False, True, False]


def test_ops(spark):
    assert value(spark, fn.normalize_op(F.lit("->  Hash  Join (3,4)"))) == "hash join"
    assert value(spark, fn.extract_target(F.lit("Seq Scan on Public.Users u"))) == "public.users" and value(spark, fn.extract_target(F.lit("Sort"))) is None
    assert value(spark, fn.knowledge_key(F.lit("Sort"), F.lit("external merge Disk: 5kB"))) == "diskSpill"
    assert value(spark, fn.knowledge_key(F.lit("Bitmap Heap Scan on t"))) == "bitmapScan" and value(spark, fn.knowledge_key(F.lit("Foo"))) is None


@pytest.mark.parametrize(("v", "error"), [(59.0, "value is below the minimum"), (101.0, "value is above the maximum"), (60.0, None)])
def test_bounds(spark, v, error):
    assert value(spark, fn.bounds_error(F.lit(v), F.lit(60.0), F.lit(100.0))) == error


def test_types_and_requests(spark):
    assert value(spark, fn.type_error(F.lit(1.5), F.lit("Integer"))) and value(spark, fn.type_error(F.lit(101.0), F.lit("Percentage"))) and value(spark, fn.type_error(F.lit(1.5), F.lit("Float"))) is None
    assert value(spark, fn.request_error(F.lit("a"), F.lit("123456789"))) == "reason is too short" and value(spark, fn.request_error(F.lit("a"), F.lit("1234567890"))) is None


@pytest.mark.parametrize(("score", "gain"), [(49, 25), (50, 12), (79, 5), (80, None)])
def test_improvement(spark, score, gain):
    assert value(spark, fn.plan_improvement(F.lit(score))) == gain


def test_text_helpers(spark):
    assert value(spark, fn.truncate_text(F.lit("é" * 12), 10)) == "é" * 7 + "..."
    assert value(spark, fn.csv_field(F.lit('a"b'))) == '"a""b"' and value(spark, fn.csv_field(F.lit("ab"))) == "ab"
    assert value(spark, fn.failure_message(F.lit('ImportFailed("no file")'))) == "no file" and value(spark, fn.failure_message(F.lit("ok"))) is None
    assert value(spark, fn.wait_description(F.lit("io: datafileread"))) == "DataFileRead"
    assert value(spark, fn.duration_s(F.lit("2025-08-26 11:09:10"), F.lit("2025-08-26 11:10:42"))) == 92.0
    assert value(spark, fn.duration_s(F.lit("2025-08-26 11:09:10"), F.lit("2025-08-26 11:09:10"))) == 1.0
    assert value(spark, fn.progress_percent(F.lit(0), F.lit(0))) == 100.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-500, 500), st.floats(-500, 500), st.floats(-500, 500)), min_size=1, max_size=40))
def test_score_is_bounded(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = df.select(fn.performance_score({"sql_elapsed_time": F.col("a"), "disk_reads": F.col("b"), "executions": F.col("c")}).alias("s")).collect()
    assert all(-100 <= r["s"] <= 100 for r in out)
