"""Shredding, store, audit boundaries, thresholds, comparison and the driver contract."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import audit, catalog, compare, facade, store, thresholds
from tidemark.sources import html, sections

HEAD = "".join(f"<th>h{i}</th>" for i in range(25))
REPORT = f"""<html><body>
<table summary='This table displays snapshot info'><tr><th>id</th><th>s</th><th>e</th></tr><tr><td>1</td><td>2025-08-26 11:09:10</td><td>x</td></tr><tr><td>2</td><td>y</td><td>2025-08-26 11:10:42</td></tr></table>
<table summary='This table displays Instance Efficiency Percentages (Target 100%)'><tr><td>Buffer Hit %</td><td>99.08</td></tr><tr><td>Soft Parse %</td><td>90</td></tr></table>
<table summary='This table displays Time model'><tr><td>DB_TIME</td><td>5,709</td></tr><tr><td>CPU_TIME</td><td>5443</td></tr><tr><td>DATA_IO_TIME</td><td>8</td></tr></table>
<table summary='This table displays Database Stat'><tr>{"<td>benchmarksql</td><td>0</td><td>77</td><td>0</td>" + "<td>1</td>" * 14}</tr><tr><td>short</td></tr></table>
<table class='tdiff x'><tr><th>Unique SQL Id</th>{HEAD}</tr><tr>{"".join(f"<td>{v}</td>" for v in [11, "n", "66,077", 66973, 0, 5, 3, 0, 8, 9, 0, 0, 0, 13, *[0] * 10, "SELECT 1 &lt; 2", 0])}</tr>
<tr><td>12</td><td>n</td><td>u</td><td>SELECT 2</td></tr></table>
<table class='tdiff'><tr><th>Unique SQL Id</th><th>few</th></tr><tr><td>1</td></tr></table>
<h3>Wait Events</h3><div><table><tr><th>Event</th><th>Wait Class</th><th>Waits</th><th>Total Wait Time</th><th>% of Total</th></tr><tr><td>CPU</td><td>CPU</td><td>1,000</td><td>12,500</td><td>45.2%</td></tr></table></div>
<script>var t = "<table><tr><td>no</td></tr></table>";</script></body></html>"""


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.createDataFrame([(1, REPORT), (2, None), (3, "<table><tr><td>open"), (4, "<p>no table")], "report_id long, html string")
    return html.cells(df).cache()


def test_shredding(cells):
    assert {r["report_id"] for r in cells.select("report_id").distinct().collect()} == {1, 3}
    assert cells.filter("report_id = 3").first()["text"] == "open" and cells.filter("text = 'no'").count() == 0


def test_sections(cells):
    s = sections.snapshot(cells).first()
    assert (s["snapshot_start"], s["snapshot_end"]) == ("2025-08-26 11:09:10", "2025-08-26 11:10:42")
    e = sections.efficiency(cells).first()
    assert (e["buffer_hit_percent"], e["hard_parse_rate_percent"]) == (99.08, 10.0)
    lp = sections.load_profile(cells).first()
    assert (lp["db_time_per_sec"], lp["cpu_time_per_sec"], lp["io_requests_per_sec"], lp["source"]) == (5709.0, 5443.0, 8.0, "time_model")
    db = sections.database_stats(cells).collect()
    assert len(db) == 1 and (db[0]["db_name"], db[0]["backends"], db[0]["xact_commit"], db[0]["xact_rollback"]) == ("benchmarksql", 0, 77, 0)
    w = sections.wait_events(cells).first()
    assert (w["event"], w["waits"], w["total_wait_time"], w["pct"]) == ("CPU", 1000, 12500.0, 45.2)


def test_statements(cells):
    r = sections.top_sql(cells).orderBy("rank_by_time").collect()
    assert [(x["sql_id"], x["sql_text"], x["executions"], x["total_elapsed_time"], x["cpu_time"]) for x in r] == [("11", "SELECT 1 < 2", 3, 66077.0, 66973.0), ("12", "SELECT 2", 0, 0.0, 0.0)]


def test_raw_reports(spark):
    text = "Instance Name: a\nx\nInstance Name: b\nSELECT 1\nselect 2\n"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "report_id long, line_no int, line string")
    m = html.raw_metadata(lines).first()
    assert (m["instance_name"], m["snapshot_start"]) == ("b", "Unknown") and html.raw_statements(lines).count() == 1


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.html").write_text(REPORT)
    st = store.Store(spark, str(tmp_path / "store"))
    pages = html.read_reports(spark, str(tmp_path / "in"))
    st.import_reports(pages, "inst", "2024-01-01")
    st.import_reports(pages, "inst", "2024-01-01")
    assert st.read("reports").count() == 3 and st.read("top_sqls").count() == 6
    one = st.read("reports").first()["id"]
    d = st.detail(one).first()
    assert len(d["top_sqls"]) == 2 and d["efficiency_metrics"]["buffer_hit_percent"] == 99.08
    st.delete_report(one)
    assert st.read("reports").count() == 2 and st.read("top_sqls").count() == 4 and st.read("top_sqls").filter(F.col("report_id") == one).count() == 0
    st.log("Delete", "report", str(one), "2024-01-02")
    assert st.read("audit_logs").first()["action"] == "Delete" and st.read("comparisons").count() == 0


def test_import_that_fails_midway(spark, tmp_path, monkeypatch):
    """Nothing of a batch is seen before its commit; run again, under its name or another, rows are there once."""
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.html").write_text(REPORT)
    st = store.Store(spark, str(tmp_path / "store"))
    pages = html.read_reports(spark, str(tmp_path / "in"))
    whole = store.sections.memory
    monkeypatch.setattr(store.sections, "memory", lambda cells: cells.select(F.raise_error(F.lit("lost")).cast("long").alias("report_id")))
    for name in ("first", "first", None):
        with pytest.raises(Exception, match="lost"):
            st.import_reports(pages, "inst", "2024-01-01", name)
        assert st.read("reports").count() == 0 and st.read("top_sqls").count() == 0 and st.commits() == []
    assert (tmp_path / "store" / "data" / "top_sqls").exists()
    monkeypatch.setattr(store.sections, "memory", whole)
    st.import_reports(pages, "inst", "2024-01-01", "first")
    st.import_reports(pages, "inst", "2024-01-01", "first")
    st.import_reports(pages, "inst", "2024-01-01")
    assert st.read("reports").count() == 2 and st.read("top_sqls").count() == 4


def test_batches_deletes_and_compaction(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "store"))
    rows = lambda *ids: spark.createDataFrame([(i, i % 2) for i in ids], "id long, source_report_id long")
    seen = lambda: sorted(r["id"] for r in st.read("comparisons").collect())
    assert st.batch("a", {"comparisons": rows(1, 2, 3)}) and not st.batch("a", {"comparisons": rows(9)})
    st.delete("comparison", spark.createDataFrame([(2,), (2,), (7,)], "id long"))
    assert seen() == [1, 3]
    st.append("comparisons", rows(2, 4))  # stored after the delete, so it is there again
    assert seen() == [1, 2, 3, 4] and st.read("execution_plans").count() == 0
    st.compact()
    assert seen() == [1, 2, 3, 4]
    st.clean()
    assert seen() == [1, 2, 3, 4] and len(st.commits()) == 1 and len(list((tmp_path / "store" / "data" / "comparisons").iterdir())) == 1
    st.delete("comparison", spark.createDataFrame([(4,)], "id long"))
    assert seen() == [1, 2, 3]


def test_commit_numbers_are_taken_once(spark, tmp_path):
    """A writer that sees an old list takes the next free number."""
    st, other = store.Store(spark, str(tmp_path / "s")), store.Store(spark, str(tmp_path / "s"))
    st._commit({"batch": "a", "tables": [], "replaces": False})
    real, stale = other.commits, [[]]
    other.commits = lambda: stale.pop() if stale else real()
    other._commit({"batch": "b", "tables": [], "replaces": False})
    assert [(c["number"], c["batch"]) for c in st.commits()] == [(1, "a"), (2, "b")]


def test_checksum_is_one_of_a_multiset(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    check = lambda df: store.integrity(df, "id").first()["checksum"]
    a, b, c = (1, "x"), (2, None), (2, "")
    sums = [check(rows(*x)) for x in ((a, b), (a, b, b), (a, b, b, b), (a, c), (a, b, c, c), ((12, "x"), b))]
    assert len(set(sums)) == len(sums) and check(rows(b, a)) == sums[0] and check(rows()) == "0-0"
    assert check(rows(*[a] * 500).repartition(7)) == check(rows(*[a] * 500))


def test_text_table_stays_in_the_jvm(spark):
    df = spark.range(1000).withColumn("name", F.concat(F.lit("n"), "id")).repartition(7)
    out = facade.text_table(df, {"id": "ID", "name": "Name"}, [F.col("id")])
    got = sorted(map(tuple, out.collect()))
    assert [p for p, _ in got] == list(range(1, 1003)) and got[2][1].split() == ["0", "n0"] and got[-1][1].split() == ["999", "n999"]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_objects_in_sql_with_one_head(spark):
    """Many names that begin alike, short names, names of several words, and odd rows, against brute force."""
    names = [f"warehouse_table_{i}" for i in range(3000)] + ["t", "ab", "a-b", "public.orders x", "", "---", None, "Ärger_x"]
    texts = [f"SELECT * FROM Warehouse_Table_{i * 37 % 3000} w JOIN ab ON w.k = 1" for i in range(200)] + ["select a-b from public.orders xy", "nothing", "", None, "x_warehouse_table_12_old"]
    df, objects = spark.createDataFrame(list(enumerate(texts)), "id long, sql_text string"), spark.createDataFrame([(n,) for n in names * 2], "object_name string")
    got = {(r["id"], r["object_name"]) for r in catalog.objects_in_sql(df, objects).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n in names if t is not None and n and any(c.isascii() and c.isalnum() for c in n) and n.lower() in t.lower()}
    assert got == want and (0, "warehouse_table_0") in got and (200, "a-b") in got
    assert catalog.objects_in_sql(df, objects.limit(0)).count() == 0 and catalog.objects_in_sql(df.limit(0), objects).count() == 0


def test_event_stream_goes_on_after_a_restart(spark, tmp_path):
    """Repeats within the watermark count once, events behind it not at all, and a second run reads new files only."""
    from tidemark.streaming import ingest

    schema = "event_id long, ts timestamp, event_type string, value double"
    put = lambda name, *rows: spark.createDataFrame(list(rows), "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    run = lambda: sorted((str(r["bucket"])[11:16], r["event_type"], r["n"], r["total"]) for r in ingest.count_events(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", schema, "1 hour", "2 hours").collect())
    put("a", (1, "2024-01-01 10:05:00", "x", 1.0), (1, "2024-01-01 10:05:00", "x", 1.0), (2, "2024-01-01 12:30:00", "x", 2.0), (3, "2024-01-01 12:40:00", "y", 4.0))
    assert run() == [("10:00", "x", 1, 1.0), ("12:00", "x", 1, 2.0), ("12:00", "y", 1, 4.0)]
    assert run() == run()
    put("b", (4, "2024-01-01 10:10:00", "x", 8.0), (5, "2024-01-01 11:10:00", "x", 16.0), (2, "2024-01-01 12:30:00", "x", 2.0), (6, "2024-01-01 12:59:00", "x", 32.0))
    assert run() == [("10:00", "x", 1, 1.0), ("11:00", "x", 1, 16.0), ("12:00", "x", 2, 34.0), ("12:00", "y", 1, 4.0)]


def test_streaming_import(spark, tmp_path):
    from tidemark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(REPORT)
    st = store.Store(spark, str(tmp_path / "store"))
    q = ingest.watch(spark, str(tmp_path / "in"), st, str(tmp_path / "cp"), "inst", "2024-01-01")
    q.awaitTermination(60)
    assert st.read("reports").count() == 1


def statement(spark, **kw):
    base = {"id": 1, "report_id": 1, "sql_text": "SELECT a FROM t", "executions": 1, "total_elapsed_time": 1.0, "buffer_gets": 0, "disk_reads": 0, "rows_processed": 0}
    return spark.createDataFrame([tuple((base | kw).values())], "id long, report_id long, sql_text string, executions long, total_elapsed_time double, buffer_gets long, disk_reads long, rows_processed long")


@pytest.mark.parametrize(("rows", "severity"), [(10000, None), (10001, "Medium"), (50001, "High"), (100001, "Critical")])
def test_full_scan(spark, rows, severity):
    r = audit.audit(statement(spark, rows_processed=rows), only=["FullTableScan"]).first()
    assert (r and r["severity"]) == severity


@pytest.mark.parametrize(("reads", "severity"), [(30, None), (31, "Medium"), (61, "High")])
def test_missing_index(spark, reads, severity):
    r = audit.audit(statement(spark, rows_processed=1001, disk_reads=reads, buffer_gets=100), only=["MissingIndex"]).first()
    assert (r and r["severity"]) == severity


def test_plan_facts(spark):
    nodes = spark.createDataFrame([(1, "Nested Loop"), (1, "Seq Scan on t")], "sql_id long, operation string")
    got = {r["issue_type"] for r in audit.audit(statement(spark, rows_processed=200000, buffer_gets=2000000), audit.plan_facts(nodes)).collect()}
    assert {"FullTableScan", "InefficientJoin", "NestedLoopWithIndex"} <= got
    assert {r["issue_type"] for r in audit.audit(statement(spark), audit.plan_facts(nodes)).collect()} == {"FullTableScan"}


def test_functions_and_products(spark):
    r = audit.audit(statement(spark, sql_text="select ltrim(a) from t, u, v", rows_processed=1000001)).collect()
    by = {x["issue_type"]: x for x in r}
    assert by["ExpensiveFunction"]["title"] == "Function Call on Column: TRIM" and by["CartesianProduct"]["severity"] == "Critical"


def test_health(spark):
    df = spark.createDataFrame([("a", "SuccessfullyImported", 1), ("a", "SuccessfullyImported", 2), ("a", "ImportFailed(x)", 3), ("b", "Success", 1)], "instance_name string, status string, snapshot_end int")
    got = {r["instance_name"]: (r["health_score"], r["status"], r["report_count"]) for r in catalog.instance_summary(df).collect()}
    assert got == {"a": (66, "Warning", 3), "b": (0, "Healthy", 1)}


def test_merge(spark):
    df = spark.createDataFrame([(1, "p", "t", 1, 3, 0, 5), (1, "p", "t", 2, 4, 0, 9)], "report_id long, schema_name string, object_name string, position int, seq_scans long, idx_scans long, dead_tuples long")
    r = catalog.merge_objects(df).first()
    assert (r["seq_scans"], r["dead_tuples"]) == (7, 9)


def test_objects_in_sql(spark):
    sqls = spark.createDataFrame([(1, "SELECT * FROM my_orders o"), (2, "select x from a.b c"), (3, "update t1 set a = 1")], "id long, sql_text string")
    objects = spark.createDataFrame([(x,) for x in ("orders", "my_orders", "B C", "t1", "t", "zz", "", "%")], "object_name string")
    got = {(r["id"], r["object_name"]) for r in catalog.objects_in_sql(sqls, objects).collect()}
    want = {(i, o) for i, s in ((1, "SELECT * FROM my_orders o"), (2, "select x from a.b c"), (3, "update t1 set a = 1")) for o in ("orders", "my_orders", "B C", "t1", "t", "zz") if o.lower() in s.lower()}
    assert got == want


def test_duplicates_take_the_last_row(spark):
    cols = "id long, report_id long, sql_id string, sql_text string, executions long, total_elapsed_time double, cpu_time double, io_time double, buffer_gets long, disk_reads long, rows_processed long, rank_by_time int"
    row = lambda i, r, text, e, rank: (i, r, "1", text, 1, e, 1.0, 1.0, 1, 0, 1, rank)
    df = spark.createDataFrame([row(1, 1, "select 1", 5.0, 1), row(2, 1, "SELECT  1", 10.0, 2), row(3, 2, "Select 1", 20.0, 1), row(4, 2, "other", 1.0, 2)], cols)
    m = compare.sql_metrics(compare.fingerprint_join(df, spark.createDataFrame([(1, 2)], "source_report_id long, target_report_id long"))).collect()
    assert len(m) == 1 and m[0]["elapsed_time_change"] == 100.0 and m[0]["disk_reads_change"] is None
    assert compare.mean_changes(compare.sql_metrics(compare.fingerprint_join(df, spark.createDataFrame([(1, 2)], "source_report_id long, target_report_id long")))).first()["mean_disk_reads"] == 0.0


def test_threshold_log(spark):
    cfg = schemas.thresholds(spark)
    changes = spark.createDataFrame([("sql_top_time", 2000.0, "dba", "a long enough reason"), ("sys_cpu_usage", 59.0, "dba", "a long enough reason")], "config_key string, new_value double, changed_by string, reason string")
    j = thresholds.judge(cfg, changes)
    b = thresholds.batch_result(j).first()
    assert (b["total"], b["succeeded"], b["failed"]) == (2, 1, 1)
    log = thresholds.accepted(j, "2024-01-01", 1)
    now = {r["config_key"]: r["value"] for r in thresholds.current(cfg, log).collect()}
    assert now["sql_top_time"] == 2000.0 and now["sys_cpu_usage"] == 80.0 and len(now) == 14
    assert thresholds.history(log, "sql_top_time").count() == 1 and thresholds.history(log, "ai_confidence").count() == 0
    assert [r["matched"] for r in thresholds.apply_template(schemas.templates(spark), cfg, "Development").orderBy("config_key").collect()] == [True, False]


def test_import_checks(spark):
    df = spark.createDataFrame([(1, '{"manifest": {}}'), (2, "[1]"), (3, "{"), (4, '{"a": 1}')], "document_id long, document string")
    assert {r["document_id"]: r["error"] for r in store.check_import(df).collect()} == {1: None, 2: "root is not an object", 3: "not JSON", 4: "manifest is missing"}


def test_driver_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_flagship(spark):
    import os

    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    out = e.entry(spark)
    assert out.count() > 0 and "score" in out.columns


def test_log_of_rows(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "log"))
    kept.log_rows(spark.createDataFrame([(f"2024-01-0{1 + i % 3}", "ann", "import", "Report", str(i), i % 2 == 0) for i in range(6)], "timestamp string, user_id string, action string, entity_type string, entity_id string, success boolean"))
    kept.log("delete", "Report", "9", "2024-02-01")
    first = kept.logged(3).collect()
    assert [(r["timestamp"], r["entity_id"]) for r in first[:1]] == [("2024-02-01", "9")] and {r["entity_id"] for r in first[1:]} == {"2", "5"}
    assert kept.logged(50, offset=5).count() == 2 and kept.logged(50).filter("id IS NULL").count() == 0
