"""Sections of a report from its cells; every section is a projection or aggregation of the cell relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import num_commas, num_pct
from tidemark.sources.html import cells_of

MAX_SQL = 200


def by_summary(cells: DataFrame, summary: str, part: bool = False) -> DataFrame:
    """Cells of tables whose summary equals or contains a text."""
    return cells.filter(F.col("summary").contains(summary) if part else F.col("summary") == summary)


def first_table(cells: DataFrame) -> DataFrame:
    """Cells of the first of the given tables of each report."""
    first = cells.groupBy("report_id").agg(F.min("table_idx").alias("table_idx"))
    return cells.join(first, ["report_id", "table_idx"], "left_semi")


def by_hint(cells: DataFrame, ids: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Cells of the table that best meets ids and texts: own id, then a nearby id, then the summary, then a nearby heading."""
    lower = [t.lower() for t in texts]
    heading_has = lambda t: F.exists(F.col("headings"), lambda x: F.lower(x).contains(t))
    near_id = F.exists(F.col("wrapper_ids"), lambda x: x.isin(*ids))
    in_summary, in_heading = F.lit(False), F.lit(False)
    for t in lower:
        in_summary = in_summary | F.lower("summary").contains(t)
        in_heading = in_heading | heading_has(t)
    score = F.when(F.col("table_id").isin(*ids), 0).when(F.try_element_at(F.col("wrapper_ids"), F.lit(-1)).isin(*ids) & (F.size("wrapper_ids") > 0), 1).when(near_id, 2).when(in_summary, 3).when(in_heading, 4)
    found = cells.withColumn("_score", score).filter("_score IS NOT NULL")
    best = found.groupBy("report_id").agg(F.min(F.struct("_score", "table_idx")).alias("b")).select("report_id", F.col("b.table_idx").alias("table_idx"))
    return found.drop("_score").join(best, ["report_id", "table_idx"], "left_semi")


def rows(cells: DataFrame, data_only: bool = True) -> DataFrame:
    """Rows (report_id, table_idx, summary, row_idx, c): the cells of each row as an array; data_only: without header cells.

    cells: cells, which are brought together, or table rows, which hold them.
    """
    if "texts" in cells.columns:
        plain = F.filter("texts", lambda x, i: ~F.coalesce(F.get("heads", i), F.lit(False)))
        c = F.when(F.col("heads").isNotNull(), plain).otherwise(F.col("texts")) if data_only else F.col("texts")
        return cells.select("report_id", "table_idx", "summary", "row_idx", c.alias("c")).filter(F.size("c") > 0)
    c = cells.filter("NOT is_header") if data_only else cells
    # a row has a bounded number of cells
    grouped = c.groupBy("report_id", "table_idx", "summary", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("s"))
    return grouped.select("report_id", "table_idx", "summary", "row_idx", F.expr("transform(s, x -> x.text)").alias("c"))


def at(i: int) -> Column:
    return F.get("c", F.lit(i))


def num(i: int) -> Column:
    return num_commas(at(i))


def whole(i: int) -> Column:
    return num_commas(at(i), "long")


def snapshot(cells: DataFrame) -> DataFrame:
    """Start and end of a report: cells 1 and 5 of the snapshot table, both Unknown if it has fewer than six."""
    t = first_table(by_summary(cells, "This table displays snapshot info")).filter("NOT is_header")
    flat = t.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "text"))).alias("s")).select("report_id", F.expr("transform(s, x -> x.text)").alias("c"))
    ok = F.size("c") >= 6
    return flat.select("report_id", F.when(ok, at(1)).otherwise("Unknown").alias("snapshot_start"), F.when(ok, at(5)).otherwise("Unknown").alias("snapshot_end"))


def snapshot_by_colon(cells: DataFrame) -> DataFrame:
    """Start and end of a report: the first column of row 1 with a colon, in rows 1 and 2; period: first cells of both."""
    t = rows(by_hint(cells, ["Snap_Shot"], ["Snapshot", "Snapshot Information"]), data_only=False)
    one = t.filter("row_idx = 1").select("report_id", F.col("c").alias("a"))
    two = t.filter("row_idx = 2").select("report_id", F.col("c").alias("b"))
    i = F.expr("coalesce(array_min(filter(transform(a, (x, i) -> CASE WHEN instr(x, ':') > 0 THEN i END), z -> z IS NOT NULL)), 1)")
    return one.join(two, "report_id").withColumn("i", i).select("report_id", F.get("a", F.col("i")).alias("snapshot_start"), F.get("b", F.col("i")).alias("snapshot_end"), F.concat_ws(" - ", F.get("a", F.lit(0)), F.get("b", F.lit(0))).alias("period"))


def named_values(cells: DataFrame, summary: str) -> DataFrame:
    """Rows (report_id, name, v1, v2) of a name/value table."""
    return rows(first_table(by_summary(cells, summary))).filter(F.size("c") >= 2).select("report_id", at(0).alias("name"), num(1).alias("v1"), num(2).alias("v2"))


def _pick(name: str, value: str = "v1") -> Column:
    return F.coalesce(F.max(F.when(F.col("name") == name, F.col(value))), F.lit(0.0))


def efficiency(cells: DataFrame) -> DataFrame:
    """The four named efficiency metrics; hard parses are what soft parses leave."""
    v = named_values(cells, "This table displays Instance Efficiency Percentages (Target 100%)")
    return v.groupBy("report_id").agg(_pick("Buffer Hit %").alias("buffer_hit_percent"), _pick("Effective CPU %").alias("cpu_efficiency_percent"), _pick("Soft Parse %").alias("soft_parse_rate_percent"), (100 - _pick("Soft Parse %")).alias("hard_parse_rate_percent"), _pick("Non-Parse CPU %").alias("execution_efficiency_percent"))


def efficiency_pairs(cells: DataFrame) -> DataFrame:
    """Every name with the value beside it, target 100."""
    t = rows(by_hint(cells, ["Instance_Efficiency_Percentages"], ["Instance Efficiency"]))
    pairs = F.expr("filter(transform(sequence(0, greatest(size(c) - 2, 0), 2), i -> named_struct('name', get(c, i), 'value', get(c, i + 1))), x -> x.name != '' AND x.value IS NOT NULL)")
    return t.select("report_id", F.explode(pairs).alias("p")).select("report_id", "p.name", num_pct("p.value").alias("value"), F.lit(100.0).alias("target"))


def load_profile(cells: DataFrame) -> DataFrame:
    """Load of each report: the time model's totals if there is one, else the load profile's rates; source tells which."""
    model = named_values(cells, "This table displays Time model").groupBy("report_id").agg(_pick("DB_TIME").alias("db_time_per_sec"), _pick("CPU_TIME").alias("cpu_time_per_sec"), _pick("DATA_IO_TIME").alias("io_requests_per_sec"), F.lit(0).cast("long").alias("total_transactions"), F.lit("time_model").alias("source"))
    profile = named_values(cells, "This table displays Load Profile").groupBy("report_id").agg(_pick("DB Time(us)").alias("db_time_per_sec"), _pick("CPU Time(us)").alias("cpu_time_per_sec"), (_pick("Read IO requests") + _pick("Write IO requests")).alias("io_requests_per_sec"), _pick("Executes (SQL)").cast("long").alias("total_transactions"), F.lit("load_profile").alias("source"))
    return model.unionByName(profile.join(model.select("report_id"), "report_id", "left_anti"))


def load_profile_long(cells: DataFrame) -> DataFrame:
    """metric, per_sec, per_txn, per_exec of the load profile."""
    t = rows(by_hint(cells, ["Load_Profile"], ["Load Profile"]))
    return t.filter(F.size("c") >= 3).select("report_id", at(0).alias("metric"), num_pct(at(1)).alias("per_sec"), num_pct(at(2)).alias("per_txn"), num_pct(at(3)).alias("per_exec"))


DATABASE_LONGS = ("backends", "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tuple_returned", "tuple_fetched", "tuple_inserted", "tuple_updated", "tuple_deleted", "conflicts", "temp_files", "temp_bytes", "deadlocks")


def database_stats(cells: DataFrame, offset: int = 0) -> DataFrame:
    """One row for each database of rows with at least 18 cells; offset: cells before the database's name."""
    t = rows(first_table(by_summary(cells, "This table displays Database Stat"))).filter(F.size("c") >= 18)
    o = offset
    return t.select("report_id", at(o).alias("db_name"), *[whole(o + 1 + i).alias(c) for i, c in enumerate(DATABASE_LONGS)], num(o + 15).alias("blk_read_time"), num(o + 16).alias("blk_write_time"), at(o + 17).alias("stats_reset"))


#: Cell positions of statement rows.
LAYOUTS = {
    "v1": {"sql_id": 0, "total_elapsed_time": 2, "cpu_time": 3, "rows_processed": 5, "executions": 6, "disk_reads": 8, "buffer_gets": 9, "io_time": 13, "sql_text": 24},
    "v2": {"sql_id": 0, "total_elapsed_time": 3, "cpu_time": 13, "rows_processed": 8, "executions": 4, "disk_reads": 12, "buffer_gets": 11, "io_time": 14, "sql_text": 25},
    "simple": {"sql_id": 0, "total_elapsed_time": 1, "executions": 2, "cpu_time": 3, "io_time": 4, "buffer_gets": 5, "disk_reads": 6, "rows_processed": 7, "sql_text": 8},
}


def statement_columns(layout: str = "v1") -> list[Column]:
    """A row's cells as columns of top_sqls; short rows with a statement in cell 3 hold a text only."""
    k = LAYOUTS[layout]
    text_only = (F.size("c") == 4) | ((F.size("c") < 14) & F.upper(F.coalesce(at(3), F.lit(""))).rlike("^\\s*(SELECT|INSERT|UPDATE|DELETE|WITH)\\b")) if layout != "simple" else F.lit(False)
    text = F.when(text_only, at(3)).otherwise(F.coalesce(at(k["sql_text"]), F.lit("")))
    zero = lambda c, kind: F.when(text_only, F.lit(0).cast(kind)).otherwise(num_commas(at(k[c]), kind)).alias(c)
    return [at(k["sql_id"]).alias("sql_id"), text.alias("sql_text"), *[zero(c, "long") for c in ("executions", "buffer_gets", "disk_reads", "rows_processed")], *[zero(c, "double") for c in ("total_elapsed_time", "cpu_time", "io_time")]]


def top_sql(cells: DataFrame, layout: str = "v1", most: int = MAX_SQL, least_headers: int = 20) -> DataFrame:
    """Statements of tables of class tdiff with more than `least_headers` headers, one of them Unique SQL Id; ranked as they stand, `most` a report. cells: cells, or table rows."""
    named = cells.filter(F.expr("array_contains(split(table_class, ' +'), 'tdiff')"))
    if "texts" in cells.columns:
        named = cells_of(named.filter("heads IS NOT NULL"))
    heads = named.filter("is_header").groupBy("report_id", "table_idx").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("text") == "Unique SQL Id").alias("named"))
    tables = heads.filter((F.col("n") > least_headers) & F.col("named"))
    r = rows(cells.join(tables.select("report_id", "table_idx"), ["report_id", "table_idx"], "left_semi"))
    r = r.filter((F.size("c") >= 14) | (F.size("c") == 4)) if layout != "simple" else r
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("table_idx", "row_idx"))
    out = r.withColumn("rank_by_time", rank).filter(F.col("rank_by_time") <= most)
    return out.select("report_id", *statement_columns(layout), "rank_by_time")


def top_sql_distinct(statements: DataFrame) -> DataFrame:
    """One row for each statement of a report: the first, with the text of whichever row has one."""
    w = Window.partitionBy("report_id", "sql_id")
    text = F.max(F.when(F.col("sql_text") != "", F.col("sql_text"))).over(w)
    return statements.withColumn("sql_text", F.coalesce(text, F.lit(""))).withColumn("_n", F.row_number().over(w.orderBy(F.desc("total_elapsed_time"), "rank_by_time"))).filter("_n = 1").drop("_n")


def roles(t: DataFrame, chain: list[tuple[str, Column]], head_rows: int = 5, needed: Sequence[str] = ()) -> DataFrame:
    """Rows (report_id, row_idx, role, text): cells below the first row that names all needed roles.

    chain: role and condition on h, the lower-case header text; the first that holds names the column, and
    the first column of a role counts.
    """
    role = F
    for name, condition in chain:
        role = role.when(condition, F.lit(name))
    heads = t.filter(F.col("row_idx") < head_rows).withColumn("h", F.lower(F.trim("text"))).withColumn("role", role).filter("role IS NOT NULL")
    rows_ok = heads.groupBy("report_id", "row_idx").agg(F.collect_set("role").alias("found")).filter(F.forall(F.array(*[F.lit(x) for x in needed]), lambda x: F.array_contains("found", x)) if needed else F.lit(True))
    head = rows_ok.groupBy("report_id").agg(F.min("row_idx").alias("head_row"))
    cols = heads.join(head.withColumnRenamed("head_row", "row_idx"), ["report_id", "row_idx"]).groupBy("report_id", F.col("row_idx").alias("head_row"), "role").agg(F.min("col_idx").alias("col_idx"))
    return t.join(cols, ["report_id", "col_idx"]).filter(F.col("row_idx") > F.col("head_row")).select("report_id", "row_idx", "role", "text")


def _has(*words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.col("h").contains(w)
    return out


def wait_events(cells: DataFrame) -> DataFrame:
    """Wait events by header; shares are recognised before totals, so a share of the total time is no total."""
    t = by_hint(cells, ["Wait_Events", "Top_10_Foreground_Wait_Events", "Wait_Events(by_wait_time)2"], ["Top 10 Foreground Wait Events", "Wait Events", "Wait Events (by wait time)"])
    chain = [("event", _has("event")), ("class", _has("class") | _has("type")), ("pct", _has("%") | _has("pct")), ("waits", _has("waits") & ~_has("time") & ~_has("avg")), ("avg", _has("avg")), ("max", _has("max")), ("total", _has("total") | _has("time"))]
    r = roles(t, chain, needed=("event",))
    pick = lambda name: F.max(F.when(F.col("role") == name, F.col("text")))
    out = r.groupBy("report_id", "row_idx").agg(*[pick(x).alias(x) for x in ("event", "class", "waits", "total", "avg", "max", "pct")])
    return out.filter("event IS NOT NULL").select("report_id", "row_idx", "event", F.coalesce("class", F.lit("Other")).alias("wait_class"), num_pct("waits").cast("long").alias("waits"), num_pct("total").alias("total_wait_time"), num_pct("avg").alias("avg_wait_time"), F.when(F.col("max").isNotNull(), num_pct("max")).alias("max_wait_time"), num_pct("pct").alias("pct"))


def sql_texts(cells: DataFrame) -> DataFrame:
    """Full statement texts by id, line breaks kept."""
    t = rows(by_hint(cells, ["SQL_Text", "SQL_Detail"], ["SQL Text", "SQL Detail"]))
    return t.filter(F.size("c") >= 2).select("report_id", at(0).alias("sql_id"), F.try_element_at("c", F.lit(-1)).alias("sql_text"))


def top_sql_by_header(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Statements by header; needs an id and a total time. Texts come from the text section if it has them."""
    t = by_hint(cells, ["SQL_ordered_by_Elapsed_Time", "SQL_ordered_by_Elapsed_Time2", "SQL_Statistics", "Top_SQL_By_Elapsed_Time", "Top_SQL"], ["SQL ordered by Elapsed Time", "Top 10 SQL", "SQL Statistics"])
    total = (_has("elapse") | _has("total time")) & ~_has("avg") & ~_has("max") & ~_has("min")
    chain = [("id", _has("sql") & (_has("id") | _has("unique"))), ("user", _has("user") | _has("schema")), ("total", total), ("calls", _has("call") | _has("exec")), ("cpu", _has("cpu")), ("io", _has("io") | _has("read")), ("rows", _has("row") | _has("tuple")), ("text", _has("text") | _has("statement"))]
    r = roles(t, chain, needed=("id", "total"))
    pick = lambda name: F.max(F.when(F.col("role") == name, F.col("text")))
    out = r.groupBy("report_id", "row_idx").agg(*[pick(x).alias(x) for x in ("id", "user", "total", "calls", "cpu", "io", "rows", "text")]).filter(F.coalesce(F.regexp_extract("id", r"^\s*(\d+)", 1).try_cast("long"), F.lit(0)) != 0)
    if texts is not None:
        out = out.join(texts.select("report_id", F.col("sql_id").alias("id"), "sql_text"), ["report_id", "id"], "left")
    else:
        out = out.withColumn("sql_text", F.lit(None).cast("string"))
    calls = F.when(F.col("calls").isNull(), F.lit(1.0)).otherwise(num_pct("calls"))
    total_time = num_pct("total")
    return out.select("report_id", "row_idx", F.col("id").alias("sql_id"), F.coalesce("user", F.lit("")).alias("user_name"), F.coalesce("sql_text", "text", F.lit("")).alias("sql_text"), total_time.alias("total_time"), calls.alias("calls"), F.when(calls > 0, total_time / F.nullif(calls, F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_time"), num_pct("cpu").alias("cpu_time"), num_pct("io").alias("io_time"), num_pct("rows").alias("rows"))


def object_stats(cells: DataFrame) -> DataFrame:
    """Tables, then indexes, with rows of at least twelve cells; schema is database.schema."""
    t = by_summary(cells, "User Tables stats", True).select("*", F.lit("table").alias("object_type")).unionByName(by_summary(cells, "User Index stats", True).select("*", F.lit("index").alias("object_type")))
    kinds = t.select("report_id", "table_idx", "object_type").distinct()
    r = rows(t.drop("object_type")).join(kinds, ["report_id", "table_idx"]).filter(F.size("c") >= 12)
    names = ("total_scans", "seq_scans", "idx_scans", "seq_reads", "idx_reads", "inserts", "updates", "deletes", "dead_tuples")
    return r.select("report_id", F.concat_ws(".", at(0), at(1)).alias("schema_name"), at(2).alias("object_name"), "object_type", *[whole(3 + i).alias(c) for i, c in enumerate(names)]).withColumn("needs_vacuum", F.col("dead_tuples") > 1000)


def cache_io(cells: DataFrame) -> DataFrame:
    """Block reads and hits of tables and indexes; toast figures are not in the report and are 0."""
    r = rows(by_summary(cells, "User table IO activity", True)).filter(F.size("c") >= 8)
    ratio = lambda i: F.coalesce(F.replace(at(i), F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))
    zero = [F.lit(0).cast("double" if c.endswith("ratio") else "long").alias(c) for c in ("toast_blks_read", "toast_blks_hit", "toast_hit_ratio", "tidx_blks_read", "tidx_blks_hit", "tidx_hit_ratio")]
    return r.select("report_id", at(0).alias("schema_name"), at(1).alias("object_name"), F.when(F.lower(at(2)).contains("index"), "index").otherwise("table").alias("object_type"), whole(3).alias("heap_blks_read"), whole(4).alias("heap_blks_hit"), ratio(5).alias("heap_hit_ratio"), whole(6).alias("idx_blks_read"), whole(7).alias("idx_blks_hit"), ratio(8).alias("idx_hit_ratio"), *zero)


def config(cells: DataFrame) -> DataFrame:
    t = rows(by_hint(cells, ["Parameter_Setting", "Settings", "Configuration_settings", "Configuration_settings2"], ["Parameter Setting", "Configuration Settings"]), data_only=False)
    return t.filter((F.col("row_idx") >= 1) & (F.size("c") >= 2)).select("report_id", at(0).alias("name"), at(1).alias("value"), at(2).alias("value_type"), at(3).alias("category"))


def host_cpu(cells: DataFrame) -> DataFrame:
    t = rows(by_hint(cells, ["Host_CPU", "Host_CPU2"], ["Host CPU"]), data_only=False)
    return t.filter("row_idx = 1").select("report_id", num_pct(at(1)).alias("cpus"), num_pct(at(2)).alias("cores"), num_pct(at(3)).alias("sockets"))


def io_profile(cells: DataFrame) -> DataFrame:
    t = rows(by_hint(cells, ["IO_Profile", "IO_Profile2"], ["I/O Profile", "IO Profile"]), data_only=False)
    return t.filter((F.col("row_idx") >= 1) & (F.size("c") >= 4)).select("report_id", at(0).alias("io_type"), num_pct(at(2)).alias("reads"), num_pct(at(3)).alias("writes"))


def memory(cells: DataFrame) -> DataFrame:
    t = rows(by_hint(cells, ["Memory_Statistics", "Memory_Statistics2"], ["Memory Statistics"]), data_only=False)
    return t.filter((F.col("row_idx") >= 1) & (F.size("c") >= 3)).select("report_id", at(0).alias("component"), at(1).alias("begin_value"), at(2).alias("end_value"))
