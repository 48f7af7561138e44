"""Text reports of the command line, as relations of lines or of one text a row; printing them is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import analysis
from tidemark.sources.shared import written

#: What stands before an issue of each severity.
SEVERITY_MARKS = {"critical": "🔴 CRITICAL", "high": "🟡 HIGH", "medium": "⚠️ MEDIUM", "low": "ℹ️ LOW"}
OTHER_MARK = "🔵 INFO"


def text_table(df: DataFrame, headers: dict[str, str], order: list) -> DataFrame:
    """Rows (position, line): a heading, a rule and a line for each row of df, columns padded to their widest cell.

    headers: column and its heading; order: what the lines are sorted by. Nulls are empty cells. Widths are one
    aggregate over all rows and numbers one range sort, so any number of lines can be written.
    """
    cells = df.select(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_c{i}") for i, c in enumerate(headers)])
    widest = cells.agg(*[F.coalesce(F.max(F.octet_length(f"_c{i}")), F.lit(0)).alias(f"w{i}") for i in range(len(headers))]).first()
    width = [max(len(h.encode()), widest[f"w{i}"]) for i, h in enumerate(headers.values())]
    pad = lambda c, w: F.concat(c, F.repeat(F.lit(" "), F.lit(w) - F.octet_length(c)))
    line = F.concat_ws("  ", *[pad(F.col(f"_c{i}"), w) for i, w in enumerate(width)])
    # a range partitioning and the rows before each partition number the lines without moving them together
    placed = written(cells.orderBy(*order).select(line.alias("line"), F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    numbered = placed.join(F.broadcast(before), "part").select((F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before") + 3).alias("position"), "line")
    head = [(1, "  ".join(h.ljust(w) for h, w in zip(headers.values(), width))), (2, "  ".join("-" * w for w in width))]
    return df.sparkSession.createDataFrame(head, "position long, line string").unionByName(numbered)


def list_reports(reports: DataFrame) -> DataFrame:
    """The list of reports as a text table."""
    return text_table(reports, {"id": "ID", "instance_name": "Instance", "snapshot_start": "Snapshot Start", "snapshot_end": "Snapshot End", "status": "Status"}, [F.col("id")])


def audit_text(issues: DataFrame) -> DataFrame:
    """issues with text: severity, title, description, recommendation, status and type of each."""
    mark = F.coalesce(*[F.when(F.lower("severity") == k, F.lit(v)) for k, v in SEVERITY_MARKS.items()], F.lit(OTHER_MARK))
    some = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n   {label}: "), F.col(c))).otherwise("")
    return issues.withColumn("text", F.concat(mark, F.lit(": "), "title", some("Description", "description"), some("Recommendation", "recommendation"), F.lit("\n   Status: "), "status", F.lit(" | Type: "), "issue_type"))


def analyze(reports: DataFrame, sqls: DataFrame, preview: int = 80) -> DataFrame:
    """id and text of each report: heading, period and its statements by rank, each with the start of its text."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    short = F.when(F.char_length("sql_text") > preview, F.concat(F.substring("sql_text", 1, preview), F.lit("..."))).otherwise(F.col("sql_text"))
    line = F.concat(F.lit("  #"), F.col("rank_by_time").cast("string"), F.lit("  SQL ID: "), F.coalesce("sql_id", F.lit("-")), F.lit("   Elapsed: "), whole("total_elapsed_time"), F.lit("ms  CPU: "), whole("cpu_time"), F.lit("ms  Execs: "), F.col("executions").cast("string"), F.lit("\n      "), short)
    # the statements of one report
    lists = sqls.groupBy(F.col("report_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_by_time", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("=== Report #"), F.col("id").cast("string"), F.lit(": "), "instance_name", F.lit(" ===\nSnapshot: "), F.col("snapshot_start").cast("string"), F.lit("  ->  "), F.col("snapshot_end").cast("string"), F.lit("\nStatus: "), "status")
    body = F.when(F.col("lines").isNull(), "--- Top SQL ---\n  (none)").otherwise(F.concat(F.lit("--- Top SQL (by elapsed time) ---\n"), "lines"))
    return reports.join(lists, "id", "left").select("id", F.concat(head, F.lit("\n\n"), body).alias("text"))


def diagnose(nodes: DataFrame, cost_limit: float | None = None) -> DataFrame:
    """plan_id and text of each plan: its score and number of warnings."""
    a = analysis.analysis(nodes, cost_limit=cost_limit)
    return a.select("plan_id", F.concat(F.lit("Score: "), F.col("score").cast("long").cast("string"), F.lit(" | Warnings: "), F.col("warnings").cast("string")).alias("text"))
