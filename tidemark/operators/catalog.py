"""Catalogue operators: filters, joins, aggregates, rankings and pages over stored relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.sources.shared import written


def by_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Point lookup; on a stored table partitioned by the column it reads one partition."""
    return df.filter(F.col(column) == F.lit(value))


def containing(df: DataFrame, columns: Sequence[str], part: str, **equal: object) -> DataFrame:
    """Rows where some column contains a text in any case and all given columns have the given values (None: any)."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(part.lower())
    for c, v in equal.items():
        if v is not None:
            found = found & (F.col(c) == F.lit(v))
    return df.filter(found)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def hot_sql(sqls: DataFrame, order: str = "elapsed", limit: int | None = None, report_id: int | None = None) -> DataFrame:
    """Hot statements by elapsed time, CPU time or executions; at most 100, 50 unless told otherwise. The report is chosen before the limit."""
    column = {"elapsed": "total_elapsed_time", "cpu_time": "cpu_time", "executions": "executions"}.get(order, "total_elapsed_time")
    hot = sqls.filter("is_hot_sql")
    if report_id is not None:
        hot = hot.filter(F.col("report_id") == report_id)
    return hot.orderBy(F.desc(column), "id").limit(min(limit or 50, 100))


def hot_sql_enriched(sqls: DataFrame, reports: DataFrame) -> DataFrame:
    """Hot statements with their report's instance and time; statements of missing reports are left out."""
    r = reports.select(F.col("id").alias("report_id"), "instance_name", F.col("snapshot_end").alias("generation_time"))
    return sqls.filter("is_hot_sql").join(r, "report_id").withColumn("rank", F.coalesce("rank_by_time", F.lit(0)))


def instance_summary(reports: DataFrame) -> DataFrame:
    """Reports, latest report, health and status of each instance.

    Health is the share of successful imports, cut to a whole number; more failures than successes are
    critical, any failure is a warning.
    """
    ok, failed = F.count_if(F.col("status") == "SuccessfullyImported"), F.count_if(F.col("status").startswith("ImportFailed"))
    out = reports.groupBy("instance_name").agg(F.count(F.lit(1)).alias("report_count"), F.max("snapshot_end").alias("last_report"), ok.alias("ok"), failed.alias("failed"))
    health = (F.col("ok") / F.col("report_count") * 100).cast("int")
    return out.select("instance_name", "report_count", "last_report", health.alias("health_score"), F.when(F.col("failed") > F.col("ok"), "Critical").when(F.col("failed") > 0, "Warning").otherwise("Healthy").alias("status"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in an order that must be total."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


#: Columns that a list of comparisons may be sorted by.
SORT_COLUMNS = ("created_at", "performance_score", "status")


def sorted_page(df: DataFrame, column: str, direction: str, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """A page sorted by a column of the white list (else created_at), ASC or else descending."""
    c = F.col(column if column in SORT_COLUMNS else "created_at")
    return page(df, [c.asc() if direction.upper() == "ASC" else c.desc(), F.col(key)], limit, offset)


def sort_any(df: DataFrame, column: str, ascending: bool = True, key: str = "id") -> DataFrame:
    """Rows by any column, nulls last, texts in any case."""
    c = F.lower(column) if df.schema[column].dataType.typeName() == "string" else F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), key)


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def first_n(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group; Spark cuts each group down before it is shuffled."""
    return ranked(df, partition, order, "_n").filter(F.col("_n") <= n).drop("_n")


def latest_per_key(events: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Current state of an append-only log: the last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s")).select(key, "s.*")


def keep_changes(history: DataFrame, partition: Sequence[str], order: str, value: str, n: int = 30) -> DataFrame:
    """The newest n entries of each history, without entries that equal the one before."""
    w = Window.partitionBy(*partition).orderBy(order)
    changed = history.withColumn("_was", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_was")) | F.col("_was").isNull())
    return first_n(changed.drop("_was"), partition, [F.desc(order)], n)


def dashboard(reports: DataFrame, sqls: DataFrame, last: int = 10) -> DataFrame:
    """Means over the last reports: share of CPU time and of I/O time in elapsed time, statements and hot statements."""
    recent = reports.orderBy(F.desc("snapshot_end"), F.desc("id")).limit(last).select(F.col("id").alias("report_id"))
    per = sqls.join(F.broadcast(recent), "report_id").groupBy("report_id").agg(F.sum("total_elapsed_time").alias("e"), F.sum("cpu_time").alias("c"), F.sum("io_time").alias("i"), F.count(F.lit(1)).alias("n"), F.count_if("is_hot_sql").alias("hot"))
    return per.agg(F.count(F.lit(1)).alias("reports"), F.round(F.avg(F.col("c") / F.col("e") * 100), 4).alias("avg_cpu_percent"), F.round(F.avg(F.col("i") / F.col("e") * 100), 4).alias("avg_io_percent"), F.sum("n").alias("statements"), F.sum("hot").alias("hot_statements"))


def trend(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums of events in time buckets."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total")).select(F.col("w.start").alias("bucket"), "n", "total")


def health_distribution(summary: DataFrame) -> DataFrame:
    """Share of instances by status."""
    n = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", "n", F.round(F.col("n") / n * 100, 4).alias("percent"))


def hot_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent issue types."""
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue_type").limit(n)


def merge_objects(parts: DataFrame) -> DataFrame:
    """Objects that several tables of a report list: scans add up, the other numbers are the last table's.

    parts: report_id, schema_name, object_name, position (order of the tables), seq_scans, idx_scans and dead_tuples.
    """
    return parts.groupBy("report_id", "schema_name", "object_name").agg(F.sum("seq_scans").alias("seq_scans"), F.sum("idx_scans").alias("idx_scans"), F.max_by("dead_tuples", "position").alias("dead_tuples"))


#: Length of the pieces by which names are looked up in words.
GRAM = 4


def _grams(word: str, n: str | int) -> str:
    """SQL: the distinct pieces of n characters of a word; none if it's shorter."""
    return f"CASE WHEN length({word}) >= {n} THEN array_distinct(transform(sequence(1, length({word}) - {n} + 1), i -> substring({word}, i, {n}))) ELSE cast(array() AS array<string>) END"


def objects_in_sql(sqls: DataFrame, objects: DataFrame) -> DataFrame:
    """Pairs (id, object_name) of statements and objects whose name stands in the statement, in any case.

    A text contains a name only if one of its words contains the name's longest run of letters and digits. The pieces
    of four characters of the distinct words are an inverted index; a run is looked up by that one of its pieces which
    the fewest words hold, so names that all begin alike are found by what tells them apart, and a run with a piece
    that no word holds is not looked up at all. Runs of under four characters are looked up as a whole among pieces of
    their length. Texts are read again only for names that have more than one run. Names without a letter or digit
    match nothing. objects: object_name; sqls: id, sql_text; nulls match nothing.
    """
    lower = sqls.select("id", F.lower("sql_text").alias("text"))
    words = lower.select("id", F.explode(F.array_distinct(F.split("text", "[^a-z0-9_]+"))).alias("word")).filter("word != ''")
    names = objects.select("object_name", F.lower("object_name").alias("name")).distinct()
    run = F.expr("get(array_sort(filter(split(name, '[^a-z0-9_]+'), r -> r != ''), (x, y) -> length(y) - length(x)), 0)")
    names = names.withColumn("run", run).filter("run IS NOT NULL")
    runs = names.select("run").distinct().withColumn("n", F.least(F.length("run"), F.lit(GRAM)))
    sizes = sorted(r["n"] for r in runs.select("n").distinct().collect())  # at most GRAM of them
    if not sizes:
        return names.select(F.lit(None).cast(sqls.schema["id"].dataType).alias("id"), "object_name").limit(0)
    index = written(words.select("word").distinct().select("word", F.explode(F.expr("concat(" + ", ".join(_grams("word", n) for n in sizes) + ")")).alias("gram")))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    pieces = runs.select("run", F.explode(F.expr(_grams("run", "n"))).alias("gram")).join(held, "gram", "left")
    best = pieces.groupBy("run").agg(F.min_by("gram", F.struct("words", "gram")).alias("gram"), F.bool_and(F.col("words").isNotNull()).alias("known")).filter("known")
    hits = index.join(best, "gram").filter(F.expr("contains(word, run)")).select("word", "run").distinct()
    found = words.join(hits.join(names, "run"), "word").select("id", "object_name", "name", (F.col("name") == F.col("run")).alias("sure")).distinct()
    rest = found.filter("NOT sure").join(lower, "id").filter(F.expr("contains(text, name)"))
    return found.filter("sure").select("id", "object_name").unionByName(rest.select("id", "object_name")).distinct()


def schema_of_statements(sqls: DataFrame, objects: DataFrame) -> DataFrame:
    """Tables with the columns that statements name as table.column, and all tables of object_stats.

    Fixed values: names that are aliases, not tables.
    """
    aliases = ["t", "a", "b", "c", "t1", "t2", "a1", "b1"]
    pairs = sqls.select(F.explode(F.regexp_extract_all("sql_text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("p")).distinct()
    named = pairs.select(F.split("p", "[.]")[0].alias("table_name"), F.split("p", "[.]")[1].alias("column_name")).filter(~F.lower("table_name").isin(aliases))
    tables = objects.select(F.col("object_name").alias("table_name"), F.lit(None).cast("string").alias("column_name"))
    return named.unionByName(tables).groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))


def set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key of either side as persisting, new (right only) or resolved (left only)."""
    a = left.select(*key).distinct().withColumn("_l", F.lit(True))
    b = right.select(*key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, list(key), "full").select(*key, F.when(F.col("_l") & F.col("_r"), "persisting").when(F.col("_r"), "new").otherwise("resolved").alias("state"))


def report_risks(efficiency: DataFrame, objects: DataFrame, least_hit: float = 95, most_dead: int = 10000) -> DataFrame:
    """Risks of each report: a low buffer hit rate, and objects with too many dead tuples, naming the first of them."""
    low = efficiency.filter(F.col("buffer_hit_percent") < least_hit).select("report_id", F.lit("warning").alias("level"), F.lit("buffer_hit").alias("risk"), F.lit(None).cast("string").alias("object_name"), F.lit(1).cast("long").alias("n"))
    dead = objects.filter(F.col("dead_tuples") > most_dead).groupBy("report_id").agg(F.min("object_name").alias("object_name"), F.count(F.lit(1)).alias("n"))
    return low.unionByName(dead.select("report_id", F.lit("error").alias("level"), F.lit("dead_tuples").alias("risk"), "object_name", "n"))


def severity_counts(findings: DataFrame, column: str = "severity") -> DataFrame:
    """Totals by severity in one row."""
    c = F.col(column)
    return findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "Critical").alias("critical"), F.count_if(c == "Warning").alias("warning"), F.count_if(c == "Info").alias("info"))


def worst_severity(findings: DataFrame, key: Sequence[str], column: str = "severity") -> DataFrame:
    """The worst severity of each group."""
    return findings.groupBy(*key).agg(F.min_by(column, fn.severity_rank(column)).alias("severity"))
