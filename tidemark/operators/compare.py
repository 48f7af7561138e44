"""Comparison of reports: fingerprint join, changes, score, findings, chart, N-way tabs and a generic compare().

A comparison is one lazy plan over any number of (source, target) pairs at once: the pairs are joined to
both reports' statements, so comparing all adjacent reports costs the same few exchanges as comparing two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

#: The metrics of a compared statement and their source columns.
METRICS = {"executions": "executions", "elapsed_time": "total_elapsed_time", "cpu_time": "cpu_time", "io_time": "io_time", "buffer_gets": "buffer_gets", "disk_reads": "disk_reads", "rows_processed": "rows_processed"}


def one_per_fingerprint(sqls: DataFrame) -> DataFrame:
    """One statement for each (report, fingerprint): the last by rank, then by id."""
    cols = [*METRICS.values(), "id", "sql_id", "rank_by_time"]
    last = F.max_by(F.struct(*cols), F.struct("rank_by_time", "id"))
    return sqls.withColumn("fp", fn.fingerprint("sql_text")).groupBy("report_id", "fp").agg(last.alias("s")).select("report_id", "fp", "s.*")


def fingerprint_join(sqls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Statements that both reports of a pair hold. pairs: source_report_id, target_report_id."""
    each = one_per_fingerprint(sqls)
    values = lambda side: [F.col(c).alias(f"{side}_{m}") for m, c in METRICS.items()]
    source = each.select(F.col("report_id").alias("source_report_id"), "fp", F.col("sql_id"), F.col("id").alias("source_id"), *values("source"))
    target = each.select(F.col("report_id").alias("target_report_id"), "fp", F.col("id").alias("target_id"), *values("target"))
    return pairs.join(source, "source_report_id").join(target, ["target_report_id", "fp"])


def sql_metrics(joined: DataFrame) -> DataFrame:
    """The seven metrics of each matched statement with their changes in per cent."""
    return joined.select("*", *[fn.pct_change(f"source_{m}", f"target_{m}").alias(f"{m}_change") for m in METRICS])


def mean_changes(metrics: DataFrame) -> DataFrame:
    """Mean changes of a pair: missing changes count as 0, so sums are divided by the number of statements."""
    mean = lambda c: (F.coalesce(F.sum(F.col(c).cast("decimal(38,10)")), F.lit(0)).cast("double") / F.count(F.lit(1)))
    return metrics.groupBy("source_report_id", "target_report_id").agg(F.count(F.lit(1)).alias("common"), *[mean(f"{m}_change").alias(f"mean_{m}") for m in ("elapsed_time", "cpu_time", "disk_reads")])


def findings(metrics: DataFrame) -> DataFrame:
    """One row for each change that is large enough."""
    rules = (("Elapsed Time", "elapsed_time_change", "SQL elapsed time", 15, 50, 20), ("CPU Time", "cpu_time_change", "SQL CPU time", 20, 50, None), ("Disk Reads", "disk_reads_change", "Disk reads", 30, 60, None))
    found = []
    for metric, column, what, least, critical, warning in rules:
        severity = fn.finding_severity(column, least, critical, warning)
        text = F.concat(F.lit(f"{what} changed by "), F.format_string("%.1f", F.col(column)), F.lit("%"))
        found.append(F.when(severity.isNotNull(), F.struct(F.lit("Sql").alias("category"), F.lit(metric).alias("metric"), F.col(column).alias("change_percent"), severity.alias("severity"), text.alias("description"))))
    return metrics.select("source_report_id", "target_report_id", "fp", F.explode(F.array_compact(F.array(*found))).alias("f")).select("source_report_id", "target_report_id", "fp", "f.*")


def top_findings(found: DataFrame, n: int = 10) -> DataFrame:
    """The n gravest findings of each pair; ties by metric and fingerprint."""
    w = Window.partitionBy("source_report_id", "target_report_id").orderBy(fn.severity_rank("severity"), F.desc(F.abs("change_percent")), "metric", "fp")
    return found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def summaries(metrics: DataFrame, reports: DataFrame) -> DataFrame:
    """Score, status, type and conclusion of each pair."""
    means = mean_changes(metrics)
    counted = findings(metrics).groupBy("source_report_id", "target_report_id").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("n_findings"))
    score = fn.performance_score({"sql_elapsed_time": F.col("mean_elapsed_time"), "sql_cpu_time": F.col("mean_cpu_time"), "disk_reads": F.col("mean_disk_reads")})
    out = means.join(counted, ["source_report_id", "target_report_id"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)).cast("long")).withColumn("score", score)
    names = reports.select("id", "instance_name")
    out = out.join(names.select(F.col("id").alias("source_report_id"), F.col("instance_name").alias("source_instance")), "source_report_id", "left")
    out = out.join(names.select(F.col("id").alias("target_report_id"), F.col("instance_name").alias("target_instance")), "target_report_id", "left")
    return out.withColumn("comparison_type", fn.comparison_type("source_instance", "target_instance")).withColumn("status", fn.score_status("score")).withColumn("conclusion", fn.conclusion("score", "n_findings"))


def adjacent_pairs(reports: DataFrame) -> DataFrame:
    """Each report with the next one of its instance."""
    w = Window.partitionBy("instance_name").orderBy("snapshot_start", "id")
    return reports.select(F.col("id").alias("source_report_id"), F.lead("id").over(w).alias("target_report_id")).filter("target_report_id IS NOT NULL")


def chart(metrics: DataFrame, n: int = 20) -> DataFrame:
    """First n matched statements of each pair with their label and elapsed times."""
    w = Window.partitionBy("source_report_id", "target_report_id").orderBy("source_id")
    return metrics.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select("source_report_id", "target_report_id", "position", F.concat(F.lit("SQL "), F.col("position").cast("string")).alias("label"), "source_elapsed_time", "target_elapsed_time")


def n_way(base: DataFrame, targets: DataFrame, mode: str = "total", n: int = 20) -> DataFrame:
    """First n statements of the base report in the order of `mode`, each with every target's values.

    base, targets: report_id, sql_id, total, calls, seconds (length of the report); targets in long form with
    ordinal, counted from 1. mode: total, avg, diff (change of total against target 1, a missing target
    counting as 0), calls_diff (change of calls a second). Missing values count as 0.
    """
    first = targets.filter("ordinal = 1").select("sql_id", F.col("total").alias("t1"), fn.per_second("calls", "seconds").alias("r1"))
    keyed = base.join(first, "sql_id", "left")
    order = {
        "total": F.col("total"),
        "avg": fn.avg_time("total", "calls"),
        "diff": F.abs(F.coalesce("t1", F.lit(0.0)) - F.col("total")),
        "calls_diff": F.abs(F.coalesce("r1", F.lit(0.0)) - fn.per_second("calls", "seconds")),
    }[mode]
    top = keyed.withColumn("sort_key", order).orderBy(F.desc("sort_key"), "sql_id").limit(n).select("sql_id", "total", "calls", "sort_key")
    ordinals = targets.select("ordinal").distinct()
    # at most n rows against one row for each target
    grid = top.join(ordinals)
    found = targets.select("sql_id", "ordinal", F.col("total").alias("target_total"), F.col("calls").alias("target_calls"))
    out = grid.join(found, ["sql_id", "ordinal"], "left").withColumn("target_total", F.coalesce("target_total", F.lit(0.0))).withColumn("target_calls", F.coalesce("target_calls", F.lit(0)))
    return out.withColumn("delta_percent", fn.delta_percent("total", "target_total")).withColumn("is_worse", fn.delta_is_bad("total", "target_total"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full comparison of two relations by key: value1, value2, difference and change rate of each measure, long form."""
    a = left.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value1")) for m in measures])).alias("m")).select(*keys, "m.*")
    b = right.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value2")) for m in measures])).alias("m")).select(*keys, "m.*")
    out = a.join(b, [*keys, "measure"], "full")
    v1, v2 = F.coalesce("value1", F.lit(0.0)), F.coalesce("value2", F.lit(0.0))
    return out.select(*keys, "measure", v1.alias("value1"), v2.alias("value2"), (v2 - v1).alias("diff"), fn.pct_change(v1, v2).alias("change_rate"))


def left_by_name(base: DataFrame, other: DataFrame, name: str, value: str, reverse: bool = False, default: float | None = 0.0) -> DataFrame:
    """Base values with another report's values by name; missing ones get the default."""
    o = other.select(name, F.col(value).alias("target_value"))
    out = base.select(name, F.col(value).alias("base_value")).join(o, name, "left")
    if default is not None:
        out = out.withColumn("target_value", F.coalesce("target_value", F.lit(default)))
    return out.withColumn("delta_percent", fn.delta_percent("base_value", "target_value")).withColumn("is_worse", fn.delta_is_bad("base_value", "target_value", reverse))


def as_map(names: list[str], prefix: str, suffix: str = "") -> Column:
    """Map of metric names to values for storage."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"{prefix}{n}{suffix}").cast("double"))])


def common_fingerprints(sqls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of fingerprints that both reports of each pair hold."""
    return fingerprint_join(sqls, pairs).groupBy("source_report_id", "target_report_id").agg(F.count(F.lit(1)).alias("common"))
