"""Queries of HTML and text shredding.

The report pages are made from the star-schema views: a page with all sections for each report, so SQL over
the views gives what the shredded pages must give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries import query
from tidemark.sources import html, report_source, sections
from tidemark.sources.adapters import duckdb_ctes as ctes
from tidemark.sources.adapters import load
from tidemark.sources.shared import shared_folder, written
from tidemark.streaming.ingest import stream_rows

REP = ctes("reports")
TOP = ctes("top_sqls")


def tr(*cells: Column | str, head: bool = False) -> Column:
    """A table row."""
    tag = "th" if head else "td"
    parts = [x for c in cells for x in (F.lit(f"<{tag}>"), c.cast("string") if isinstance(c, Column) else F.lit(c), F.lit(f"</{tag}>"))]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


def table(attributes: str, *rows: Column) -> Column:
    return F.concat(F.lit(f"<table {attributes}>"), *rows, F.lit("</table>"))


def escaped(text: str) -> Column:
    return F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def ends(i: Column) -> tuple[Column, Column]:
    """A report's page before and after the rows of its statements."""
    heads = tr("Unique SQL Id", *[f"h{k}" for k in range(1, 26)], head=True)
    before = F.concat(
        F.lit('<html><body><h1>Report</h1><div class="instance-name">'), "instance_name", F.lit("</div>"),
        table("summary='This table displays snapshot info'", tr("id", "start", "end", head=True), tr("1", F.col("snapshot_start"), "x"), tr("2", "y", F.col("snapshot_end"))),
        table("summary='This table displays Instance Efficiency Percentages (Target 100%)' id='Instance_Efficiency_Percentages'", tr("Buffer Hit %", (i % 100)), tr("Effective CPU %", "50.5"), tr("Soft Parse %", "80"), tr("Non-Parse CPU %", "1,234.5")),
        F.when(i % 2 == 0, table("summary='This table displays Time model'", tr("DB_TIME", i), tr("CPU_TIME", "5"), tr("DATA_IO_TIME", "8"))).otherwise(F.lit("")),
        table("summary='This table displays Load Profile' id='Load_Profile'", tr("DB Time(us)", "100", "1"), tr("CPU Time(us)", "200", "2"), tr("Read IO requests", "3", "0"), tr("Write IO requests", "4", "0"), tr("Executes (SQL)", i, "0")),
        table("summary='This table displays Database Stat'", tr(*[f"c{k}" for k in range(18)], head=True), tr("db1", i, *[str(k) for k in range(2, 15)], "1.5", "2.5", "never")),
        F.lit("<table class='tdiff'>"), heads,
    )
    after = F.concat(
        F.lit("</table>"),
        table("summary='This table displays User table IO activity ordered by x'", tr("public", F.concat(F.lit("t"), i), "table", "10", "90", "90.0%", "1", "9", "90.0%")),
        table("summary='User Tables stats x'", tr("db", "public", F.concat(F.lit("t"), i), *[str(k) for k in range(1, 9)], (i % 3000))),
        table("summary='User Index stats x'", tr("db", "public", F.concat(F.lit("i"), i), *[str(k) for k in range(1, 10)])),
        F.lit('<h3 id="Wait_Events">Wait Events</h3>'),
        table("", tr("Event", "Wait Class", "Waits", "Total Wait Time", "% of Total", head=True), tr("CPU", "CPU", "10", "12,500", "45.2%"), tr("IO", "User I/O", i, "7", "1%")),
        F.lit("<h3>Parameter Setting</h3>"), table("", tr("name", "value", head=True), tr("work_mem", i)),
        F.lit("<h3>Host CPU</h3>"), table("", tr("Node", "CPUs", "Cores", "Sockets", head=True), tr("n1", i, "4", "2")),
        F.lit("<h3>I/O Profile</h3>"), table("", tr("type", "total", "reads", "writes", head=True), tr("data", "7", "3", i)),
        F.lit("<h3>Memory Statistics</h3>"), table("", tr("component", "begin", "end", head=True), tr("heap", "1MB", i)),
        F.lit("<h3>SQL Text</h3>"), table("", tr("Unique SQL Id", "SQL Text", head=True), tr(i, "SELECT 1<br>FROM x &amp; y")),
        F.lit("</body></html>"),
    )
    return before, after


def pages(s: SparkSession, d: str) -> DataFrame:
    """report_id, html of all reports, for queries on other sections than that of the statements, which is empty."""
    # few rows, but much work in each
    return load(s, d, "reports").select(F.col("id").alias("report_id"), F.concat(*ends(F.col("id"))).alias("html")).repartition(4 * s.sparkContext.defaultParallelism, "report_id")


#: Part of a page after all its statements.
LAST = (1 << 31) - 1


def whole_pages(s: SparkSession, d: str) -> DataFrame:
    """report_id, part, html: pieces of the pages of all reports with all their statements, one each, those of a page in order in one partition."""
    # 26 cells in the first layout
    place = {0: "sql_id", 2: "total_elapsed_time", 3: "cpu_time", 5: "rows_processed", 6: "executions", 8: "disk_reads", 9: "buffer_gets", 13: "io_time"}
    cells = [F.format_number(place[i], 4) if i in (2, 3, 13) else F.format_number(place[i], 0) if i in (5, 6, 8, 9) else F.col(place[i]) if i in place else escaped("sql_text") if i == 24 else F.lit("0") for i in range(26)]
    before, after = ends(F.col("id"))
    around = F.explode(F.array(F.struct(F.lit(0).alias("part"), before.alias("end")), F.struct(F.lit(LAST).alias("part"), after.alias("end"))))
    outer = load(s, d, "reports").select(F.col("id").alias("report_id"), around.alias("x")).select("report_id", "x.part", "x.end")
    parts = load(s, d, "top_sqls").select("report_id", F.col("rank_by_time").alias("part"), *place.values(), "sql_text").unionByName(outer, allowMissingColumns=True)
    # the text of a row is made after its figures have been moved
    return html.in_order(parts).select("report_id", "part", F.coalesce("end", tr(*cells)).alias("html"))


def cells(s: SparkSession, d: str) -> DataFrame:
    return html.cells(pages(s, d))


def statement_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of the statement tables of all pages, shredded once."""
    return written(html.table_rows(whole_pages(s, d).drop("part"), True).filter("table_class = 'tdiff'"))


@query("src.html_file", REP + "SELECT id AS report_id, 14 AS tables FROM reports")
def src_html_file(s: SparkSession, d: str) -> DataFrame:
    n = cells(s, d).groupBy("report_id").agg((F.countDistinct("table_idx") + F.when(F.col("report_id") % 2 == 0, -1).otherwise(0)).alias("n"))
    return n.select("report_id", F.col("n").cast("int").alias("tables"))


def report_files(s: SparkSession, d: str) -> str:
    """A folder in the shared file system with one file for each report, all its statements included."""
    folder = f"{shared_folder(s)}/reports-{uuid.uuid4()}"
    whole_pages(s, d).select("html", "report_id").write.partitionBy("report_id").text(folder)
    return folder


def statements_by_file(rows: DataFrame) -> DataFrame:
    """report_id, statements and executions of each file, from the columns of its statement table."""
    report = F.regexp_extract("file_path", r"report_id=(\d+)", 1).cast("long").alias("report_id")
    cell = lambda k: F.when(~F.coalesce(F.get("heads", F.lit(k)), F.lit(False)), F.get("texts", F.lit(k)))
    body = rows.filter("table_class = 'tdiff'").select(report, cell(0).alias("sql_id"), F.replace(cell(6), F.lit(","), F.lit("")).cast("long").alias("executions")).filter("sql_id IS NOT NULL OR executions IS NOT NULL")
    return body.groupBy("report_id").agg(F.count("sql_id").alias("statements"), F.sum("executions").alias("executions"))


BY_FILE = TOP + "SELECT report_id, count(*) AS statements, CAST(sum(executions) AS BIGINT) AS executions FROM top_sqls GROUP BY 1"


@query("src.html_source", BY_FILE)
def src_html_source(s: SparkSession, d: str) -> DataFrame:
    return statements_by_file(report_source.read_rows(s, report_files(s, d), suffixes=".txt"))


@query("src.html_stream", BY_FILE)
def src_html_stream(s: SparkSession, d: str) -> DataFrame:
    return statements_by_file(stream_rows(s, report_files(s, d), f"{shared_folder(s)}/rows-{uuid.uuid4()}", suffixes=".txt"))


@query("src.html_basic", REP + "SELECT id AS report_id, instance_name FROM reports")
def src_html_basic(s: SparkSession, d: str) -> DataFrame:
    return html.basic_metadata(pages(s, d)).select("report_id", "instance_name")


@query("src.headings", r"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>')) FROM pages) GROUP BY 1")
def src_headings(s: SparkSession, d: str) -> DataFrame:
    return html.headings(load(s, d, "pages").withColumnRenamed("page_id", "report_id")).groupBy(F.col("report_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


@query("src.find_table_summary", REP + "SELECT id AS report_id, 9 AS n FROM reports")
def src_find_table_summary(s: SparkSession, d: str) -> DataFrame:
    return sections.by_summary(cells(s, d), "User table IO activity", True).groupBy("report_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("src.find_table_heur", REP + "SELECT id AS report_id, 4 AS n FROM reports")
def src_find_table_heur(s: SparkSession, d: str) -> DataFrame:
    return sections.by_hint(cells(s, d), ["Nothing"], ["Parameter Setting"]).groupBy("report_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("src.snapshot", REP + "SELECT id AS report_id, CAST(snapshot_start AS VARCHAR) AS snapshot_start, CAST(snapshot_end AS VARCHAR) AS snapshot_end FROM reports")
def src_snapshot(s: SparkSession, d: str) -> DataFrame:
    return sections.snapshot(cells(s, d))


@query("src.snapshot_heur", REP + "SELECT id AS report_id, '1 - 2' AS period FROM reports")
def src_snapshot_heur(s: SparkSession, d: str) -> DataFrame:
    return sections.snapshot_by_colon(cells(s, d)).select("report_id", "period")


@query("src.efficiency", REP + "SELECT id AS report_id, CAST(id % 100 AS DOUBLE) AS buffer_hit_percent, 50.5::DOUBLE AS cpu_efficiency_percent, 80.0::DOUBLE AS soft_parse_rate_percent, 20.0::DOUBLE AS hard_parse_rate_percent, 1234.5::DOUBLE AS execution_efficiency_percent FROM reports")
def src_efficiency(s: SparkSession, d: str) -> DataFrame:
    return sections.efficiency(cells(s, d))


@query("src.efficiency_pairs", REP + "SELECT id AS report_id, 'Buffer Hit %' AS name, CAST(id % 100 AS DOUBLE) AS value FROM reports UNION ALL SELECT id, 'Effective CPU %', 50.5 FROM reports UNION ALL SELECT id, 'Soft Parse %', 80 FROM reports UNION ALL SELECT id, 'Non-Parse CPU %', 1234.5 FROM reports")
def src_efficiency_pairs(s: SparkSession, d: str) -> DataFrame:
    return sections.efficiency_pairs(cells(s, d)).select("report_id", "name", "value")


LOAD_SQL = REP + "SELECT id AS report_id, CASE WHEN id % 2 = 0 THEN id ELSE 100 END::DOUBLE AS db_time_per_sec, CASE WHEN id % 2 = 0 THEN 5 ELSE 200 END::DOUBLE AS cpu_time_per_sec, CASE WHEN id % 2 = 0 THEN 8 ELSE 7 END::DOUBLE AS io_requests_per_sec, CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS total_transactions, CASE WHEN id % 2 = 0 THEN 'time_model' ELSE 'load_profile' END AS source FROM reports"
query("src.load_time_model", LOAD_SQL.replace("FROM reports", "FROM reports WHERE id % 2 = 0"))(lambda s, d: sections.load_profile(cells(s, d)).filter("source = 'time_model'"))
query("src.load_profile", LOAD_SQL)(lambda s, d: sections.load_profile(cells(s, d)))


@query("src.load_profile_long", REP + "SELECT id AS report_id, unnest(['DB Time(us)', 'CPU Time(us)', 'Read IO requests', 'Write IO requests', 'Executes (SQL)']) AS metric, unnest([100.0, 200.0, 3.0, 4.0, id])::DOUBLE AS per_sec FROM reports")
def src_load_profile_long(s: SparkSession, d: str) -> DataFrame:
    return sections.load_profile_long(cells(s, d)).select("report_id", "metric", "per_sec")


@query("src.database_stats", REP + "SELECT id AS report_id, 'db1' AS db_name, id AS backends, CAST(14 AS BIGINT) AS deadlocks, 1.5::DOUBLE AS blk_read_time, 'never' AS stats_reset FROM reports")
def src_database_stats(s: SparkSession, d: str) -> DataFrame:
    return sections.database_stats(cells(s, d)).select("report_id", "db_name", "backends", "deadlocks", "blk_read_time", "stats_reset")


STATEMENTS = "SELECT report_id, sql_id, sql_text, executions, buffer_gets, disk_reads, rows_processed, round(total_elapsed_time, 2) AS total_elapsed_time, rank_by_time AS rank_by_time FROM top_sqls WHERE rank_by_time <= 200"
COLS = ["report_id", "sql_id", "sql_text", "executions", "buffer_gets", "disk_reads", "rows_processed", "total_elapsed_time", "rank_by_time"]
for _name in ("src.top_sql_core", "src.top_sql_row"):
    query(_name, TOP + STATEMENTS)(lambda s, d: sections.top_sql(statement_rows(s, d)).select(*COLS))


@query("src.top_sql_distinct", TOP + "SELECT report_id, count(*) AS n FROM top_sqls WHERE rank_by_time <= 200 GROUP BY 1")
def src_top_sql_distinct(s: SparkSession, d: str) -> DataFrame:
    t = sections.top_sql(statement_rows(s, d))
    return sections.top_sql_distinct(t.unionByName(t)).groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))


# rows of a page hold "0" where the second layout has its calls and times
query("src.top_sql_row_v2", TOP + "SELECT report_id, sql_id, 0 AS executions, cpu_time AS total_elapsed_time FROM top_sqls WHERE rank_by_time <= 200")(lambda s, d: sections.top_sql(statement_rows(s, d), "v2").select("report_id", "sql_id", F.col("executions").cast("int").alias("executions"), "total_elapsed_time"))
query("src.top_sql_row_simple", TOP + "SELECT report_id, sql_id, round(total_elapsed_time, 2) AS executions FROM top_sqls")(lambda s, d: sections.rows(statement_rows(s, d)).select("report_id", *sections.statement_columns("simple"), sections.num(2).alias("e")).select("report_id", "sql_id", F.col("e").alias("executions")))


@query("src.sql_text", REP + "SELECT id AS report_id, CAST(id AS VARCHAR) AS sql_id, concat('SELECT 1', chr(10), 'FROM x & y') AS sql_text FROM reports")
def src_sql_text(s: SparkSession, d: str) -> DataFrame:
    return sections.sql_texts(cells(s, d))


@query("src.wait_events", REP + "SELECT id AS report_id, 'CPU' AS event, 'CPU' AS wait_class, 10 AS waits, 12500.0::DOUBLE AS total_wait_time, 45.2::DOUBLE AS pct FROM reports UNION ALL SELECT id, 'IO', 'User I/O', id, 7, 1 FROM reports")
def src_wait_events(s: SparkSession, d: str) -> DataFrame:
    return sections.wait_events(cells(s, d)).select("report_id", "event", "wait_class", "waits", "total_wait_time", "pct")


@query("src.top_sql_header", REP + "SELECT id AS report_id, CAST(id AS VARCHAR) AS sql_id, 'ann' AS user_name, 1000.0::DOUBLE AS total_time, 4.0::DOUBLE AS calls, 250.0::DOUBLE AS avg_time, concat('SELECT 1', chr(10), 'FROM x & y') AS sql_text FROM reports")
def src_top_sql_header(s: SparkSession, d: str) -> DataFrame:
    p = pages(s, d)
    extra = F.concat(F.lit("<h3>SQL ordered by Elapsed Time</h3>"), table("", tr("Unique SQL Id", "User Name", "Total Elapse Time(us)", "Calls", head=True), tr(F.col("report_id"), "ann", "1,000", "4")))
    c = html.cells(p.select("report_id", F.replace("html", F.lit("</body>"), F.concat(extra, F.lit("</body>"))).alias("html")))
    return sections.top_sql_by_header(c, sections.sql_texts(c)).select("report_id", "sql_id", "user_name", "total_time", "calls", "avg_time", "sql_text")


@query("src.object_stats_core", REP + "SELECT id AS report_id, 'db.public' AS schema_name, concat('t', id) AS object_name, 'table' AS object_type, 1 AS total_scans, id % 3000 AS dead_tuples FROM reports UNION ALL SELECT id, 'db.public', concat('i', id), 'index', 1, 9 FROM reports")
def src_object_stats_core(s: SparkSession, d: str) -> DataFrame:
    return sections.object_stats(cells(s, d)).select("report_id", "schema_name", "object_name", "object_type", F.col("total_scans").cast("int").alias("total_scans"), "dead_tuples")


@query("src.cache_io", REP + "SELECT id AS report_id, concat('t', id) AS object_name, 'table' AS object_type, 10 AS heap_blks_read, 90.0::DOUBLE AS heap_hit_ratio, 90.0::DOUBLE AS idx_hit_ratio FROM reports")
def src_cache_io(s: SparkSession, d: str) -> DataFrame:
    return sections.cache_io(cells(s, d)).select("report_id", "object_name", "object_type", F.col("heap_blks_read").cast("int").alias("heap_blks_read"), "heap_hit_ratio", "idx_hit_ratio")


@query("src.config", REP + "SELECT id AS report_id, 'work_mem' AS name, CAST(id AS VARCHAR) AS value FROM reports")
def src_config(s: SparkSession, d: str) -> DataFrame:
    return sections.config(cells(s, d)).select("report_id", "name", "value")


@query("src.host_cpu", REP + "SELECT id AS report_id, id::DOUBLE AS cpus, 4::DOUBLE AS cores, 2::DOUBLE AS sockets FROM reports")
def src_host_cpu(s: SparkSession, d: str) -> DataFrame:
    return sections.host_cpu(cells(s, d))


@query("src.io_profile", REP + "SELECT id AS report_id, 'data' AS io_type, 3::DOUBLE AS reads, id::DOUBLE AS writes FROM reports")
def src_io_profile(s: SparkSession, d: str) -> DataFrame:
    return sections.io_profile(cells(s, d))


@query("src.memory", REP + "SELECT id AS report_id, 'heap' AS component, '1MB' AS begin_value, CAST(id AS VARCHAR) AS end_value FROM reports")
def src_memory(s: SparkSession, d: str) -> DataFrame:
    return sections.memory(cells(s, d))


def lines(s: SparkSession, d: str) -> DataFrame:
    """report_id, line_no, line of raw text reports."""
    r = load(s, d, "reports")
    text = F.concat(F.lit("Instance Name: old\nInstance Name: "), "instance_name", F.lit("\nSnapshot Start: "), F.col("snapshot_start").cast("string"), F.lit("\nSELECT 1\n select 2\nUPDATE t SET a = 1\n"))
    return r.select(F.col("id").alias("report_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


@query("src.raw_text", REP + "SELECT id AS report_id, instance_name, 'Unknown' AS generation_time FROM reports")
def src_raw_text(s: SparkSession, d: str) -> DataFrame:
    return html.raw_metadata(lines(s, d)).select("report_id", "instance_name", "generation_time")


@query("src.raw_sql", REP + "SELECT id AS report_id, 1 AS rank_by_time, 'SELECT 1' AS sql_text FROM reports UNION ALL SELECT id, 2, 'UPDATE t SET a = 1' FROM reports")
def src_raw_sql(s: SparkSession, d: str) -> DataFrame:
    return html.raw_statements(lines(s, d))
