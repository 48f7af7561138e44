"""Rule-based SQL audit.

Rules are data: a condition, a severity and texts. All rules of a statement are evaluated in one projection
that builds an array of issues and explodes it, so an audit is one pass over the statements and one left
join to what their plans contain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas


@dataclass(frozen=True)
class Rule:
    """One audit rule over the columns of top_sqls, has_seq_scan and has_nested_loop."""

    issue_type: str
    when: Column
    severity: Column
    title: Column
    description: Column
    recommendation: Column


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


#: Functions that keep an index from being used, and why.
FUNCTIONS = (
    ("UPPER", "Case-insensitive search prevents index usage"),
    ("LOWER", "Case-insensitive search prevents index usage"),
    ("SUBSTR", "Substring function prevents index usage"),
    ("TRIM", "Trim function prevents index usage"),
    ("TO_CHAR", "Type conversion in WHERE clause"),
)


def occurrences(text: Column, part: str) -> Column:
    """How often a part stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


#: Limits of the rules; a caller can override them by name.
LIMITS = {"scan_rows": 10000, "scan_high": 50000, "scan_critical": 100000, "read_ratio": 0.3, "read_ratio_high": 0.6, "read_rows": 1000, "join_rows": 10000, "mean_time": 1000, "mean_executions": 10, "cartesian_rows": 1000000, "loop_rows": 100000, "loop_gets": 1000000, "hash_rows": 500000, "sort_rows": 50000}


def rules(limits: dict[str, float] | None = None) -> list[Rule]:
    """The nine rules in the order in which they report. Titles and texts are fixed values."""
    k = LIMITS | (limits or {})
    rows, sql = F.col("rows_processed"), F.col("sql_text")
    upper, n = F.upper(sql), rows.cast("string")
    ratio = F.when(F.col("buffer_gets") > 0, F.col("disk_reads") / F.nullif(F.col("buffer_gets"), F.lit(0))).otherwise(F.lit(0.0))
    function = F
    why = F
    for name, reason in FUNCTIONS:
        function = function.when(upper.contains(name + "("), F.lit(name))
        why = why.when(upper.contains(name + "("), F.lit(reason))
    lit = F.lit
    return [
        Rule(
            "FullTableScan", (rows > k["scan_rows"]) | F.col("has_seq_scan"), F.when(rows > k["scan_critical"], "Critical").when(rows > k["scan_high"], "High").otherwise("Medium"), lit("Full Table Scan Detected"),
            _text("Query processed ", n, " rows using full table scan. This can be slow on large tables."),
            lit("High row count suggests potential full table scan. For specific index recommendations, provide execution plan data showing which table/columns are being scanned."),
        ),
        Rule(
            "MissingIndex", (ratio > k["read_ratio"]) & (rows > k["read_rows"]), F.when(ratio > k["read_ratio_high"], "High").otherwise("Medium"), lit("Potential Missing Index"),
            _text("Query has high disk read ratio (", F.format_string("%.1f", ratio * 100), "%). Consider adding indexes on filter/join columns."),
            lit("High disk I/O ratio suggests potential missing indexes. To identify specific columns, analyze execution plan or examine WHERE/JOIN clauses in the SQL text."),
        ),
        Rule(
            "InefficientJoin", F.col("has_nested_loop") & (rows > k["join_rows"]), lit("Medium"), lit("Inefficient Join Detected"),
            lit("Query uses nested loop join on large result set. Consider hash or merge join."),
            lit("Large dataset with nested loop join detected. Review execution plan to confirm join method and consider hash/merge join alternatives."),
        ),
        Rule(
            "MissingStats", (F.col("total_elapsed_time") / F.nullif(F.col("executions"), lit(0)) > k["mean_time"]) & (F.col("executions") > k["mean_executions"]), lit("Medium"), lit("Potential Stale Statistics"),
            lit("Query has inconsistent execution times, possibly due to outdated optimizer statistics."),
            lit("Inconsistent execution times may indicate stale statistics. Run ANALYZE on tables referenced in this query."),
        ),
        Rule(
            "ExpensiveFunction", function.isNotNull(), lit("Medium"), _text("Function Call on Column: ", function), why,
            _text("Function ", function, "() detected in SQL. For specific column recommendations, analyze execution plan to identify which columns need functional indexes."),
        ),
        Rule(
            "CartesianProduct", (occurrences(sql, " FROM ") + occurrences(sql, " from ") + occurrences(sql, ", ") > 1) & (rows > k["cartesian_rows"]), lit("Critical"), lit("Potential Cartesian Product Detected"),
            _text("Query processes ", n, " rows from multiple tables, suggesting a missing join condition."),
            lit("High row count from multiple tables detected. Review SQL text to verify proper JOIN conditions are present."),
        ),
        Rule(
            "NestedLoopWithIndex", F.col("has_nested_loop") & (rows > k["loop_rows"]) & (F.col("buffer_gets") > k["loop_gets"]), lit("High"), lit("Nested Loop on Large Table"),
            lit("Query uses nested loop join on large table. Consider hash join or covering index."),
            lit("Large dataset with nested loop join detected. Review execution plan to identify specific tables/columns for optimization."),
        ),
        Rule(
            "HashJoinTooLarge", rows > k["hash_rows"], lit("High"), lit("Large Hash Join Detected"),
            _text("Hash join processes ", n, " rows, may exceed work_mem and spill to disk."),
            lit("Large hash join detected. Consider increasing work_mem or reviewing execution plan for specific optimization opportunities."),
        ),
        Rule(
            "SortOperation", upper.contains(" ORDER BY ") & (rows > k["sort_rows"]), lit("Low"), lit("Large Sort Operation Detected"),
            _text("Query sorts ", n, " rows. Consider adding index on sort column."),
            lit("Large sort operation detected. To identify specific columns for indexing, examine the ORDER BY clause in the SQL text."),
        ),
    ]


def plan_facts(nodes: DataFrame) -> DataFrame:
    """What the plans of each statement contain; nodes: sql_id (the statement's id), operation."""
    has = lambda words: F.bool_or(F.col("operation").contains(words))
    return nodes.groupBy("sql_id").agg(has("Seq Scan").alias("has_seq_scan"), has("Nested Loop").alias("has_nested_loop"))


def audit(sqls: DataFrame, facts: DataFrame | None = None, limits: dict[str, float] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """All issues of all statements: report_id, sql_id, issue_type, severity, texts, problematic_sql, status.

    facts: as plan_facts() gives it; statements without a plan count as having neither kind of node.
    only: issue types to keep; unknown names are ignored.
    """
    base = sqls.select("id", "report_id", "sql_text", "executions", "total_elapsed_time", "buffer_gets", "disk_reads", "rows_processed")
    if facts is None:
        base = base.withColumn("has_seq_scan", F.lit(False)).withColumn("has_nested_loop", F.lit(False))
    else:
        base = base.join(facts.select(F.col("sql_id").alias("id"), "has_seq_scan", "has_nested_loop"), "id", "left").fillna(False, ["has_seq_scan", "has_nested_loop"])
    chosen = [r for r in rules(limits) if only is None or r.issue_type in only]
    issues = [F.when(r.when, F.struct(F.lit(r.issue_type).alias("issue_type"), r.severity.alias("severity"), r.title.alias("title"), r.description.alias("description"), r.recommendation.alias("recommendation"))) for r in chosen]
    found = F.array_compact(F.array(*issues)) if issues else F.expr("cast(array() as array<struct<issue_type:string,severity:string,title:string,description:string,recommendation:string>>)")
    return base.select("report_id", F.col("id").alias("sql_id"), F.col("sql_text").alias("problematic_sql"), F.explode(found).alias("i")).select("report_id", "sql_id", "i.*", "problematic_sql", F.lit("Open").alias("status"))


KEY = ["report_id", "sql_id", "issue_type"]


def new_issues(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found issues that no open stored issue has."""
    return found.join(stored.filter("status = 'Open'").select(*KEY).distinct(), KEY, "left_anti")


def known_issues(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found issues that an open stored issue has already."""
    return found.join(stored.filter("status = 'Open'").select(*KEY).distinct(), KEY, "left_semi")


def search(issues: DataFrame, report_id: int | None = None, status: str | None = None, severity: str | None = None, issue_type: str | None = None) -> DataFrame:
    """Issues that fulfil every given condition."""
    for column, value in (("report_id", report_id), ("status", status), ("severity", severity), ("issue_type", issue_type)):
        if value is not None:
            issues = issues.filter(F.col(column) == value)
    return issues


def summary(issues: DataFrame) -> DataFrame:
    """Counts in total, by severity, by status and by type, in one pass."""
    g = F.grouping_id()
    sets = issues.groupingSets([[], [F.col("severity")], [F.col("status")], [F.col("issue_type")]], "severity", "status", "issue_type").agg(F.count(F.lit(1)).alias("n"), g.alias("g"))
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "status").otherwise("issue_type")
    return sets.select(kind.alias("kind"), F.coalesce("severity", "status", "issue_type", F.lit("all")).alias("value"), "n")


def update_status(issues: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Issues with the status changes applied; changes: id, new_status, changed_by. at: time of the change.

    A resolving status sets resolved_at; only some of them set resolved_by.
    """
    c = changes.select("id", "new_status", "changed_by")
    out = issues.join(c, "id", "left")
    ends, signs = F.col("new_status").isin(*schemas.RESOLVING_STATUSES), F.col("new_status").isin(*schemas.SIGNING_STATUSES)
    out = out.withColumn("resolved_at", F.when(ends, F.lit(at)).otherwise(F.col("resolved_at"))).withColumn("resolved_by", F.when(signs, F.col("changed_by")).otherwise(F.col("resolved_by")))
    return out.withColumn("status", F.coalesce("new_status", "status")).drop("new_status", "changed_by")


def bulk_result(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Each requested change with whether it can be applied and why not."""
    known = issues.select("id").distinct().withColumn("known", F.lit(True))
    bad = F.when(F.col("known").isNull(), "issue not found").when(~F.col("new_status").isin(*schemas.ISSUE_STATUSES), "unknown status")
    return changes.join(known, "id", "left").select("id", "new_status", bad.isNull().alias("ok"), bad.alias("error"))
