"""Lint of statement texts without a plan, and statement rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.audit import occurrences


def rules(sql: Column) -> dict[str, list[tuple[Column | None, str, str | None]]]:
    """For each kind of statement: condition (None: always), warning, suggestion. Texts are fixed values."""
    u = F.upper(sql)
    has = lambda x: u.contains(x)
    between = F.regexp_extract(u, r"(?s)INSERT INTO(.*?)VALUES", 1)
    return {
        "SELECT": [
            (has("SELECT *"), "SELECT * retrieves all columns which may be inefficient for large tables", "Specify only required columns instead of SELECT *"),
            (~has("WHERE") & ~has("LIMIT"), "Query lacks WHERE clause - may scan entire table", "Add appropriate WHERE clause to filter rows"),
            (has(" OR "), "OR conditions may prevent efficient index usage", "Consider using UNION or rewriting with appropriate indexes"),
            (has("LIKE '%"), "LIKE with leading wildcard prevents index usage", "Consider full-text search or restructuring the query"),
            (has("NOT IN"), "NOT IN can be inefficient with large lists", "Consider using NOT EXISTS or LEFT JOIN with NULL check"),
            (has("SELECT ("), "Subqueries in SELECT clause may execute for each row", "Consider using JOINs or CTEs instead"),
            (has("DISTINCT"), "DISTINCT requires sorting which can be expensive", "Consider adding appropriate indexes or restructuring query"),
            (has("ORDER BY") & ~has("LIMIT"), "ORDER BY without LIMIT may sort large result sets", "Add LIMIT clause or ensure appropriate covering index"),
            (has("JOIN") & ~has("ON") & ~has("USING"), "JOIN without ON or USING clause detected", "Specify proper JOIN conditions with ON or USING clauses"),
            (None, "SQL TEXT ANALYSIS: Cannot determine actual table sizes or data distribution", None),
            (None, "Index recommendations require schema knowledge and execution plan data", None),
        ],
        "INSERT": [
            (has("INSERT INTO") & has("VALUES") & u.rlike(r"(?s)INSERT INTO.*VALUES") & ~between.contains("("), "INSERT without column specification may cause issues with schema changes", "Explicitly specify column names in INSERT statement"),
            (occurrences(u, "VALUES") > 10, "Large batch insert detected", "Consider using COPY or batching in smaller chunks"),
        ],
        "UPDATE": [
            (~has("WHERE"), "UPDATE without WHERE clause will affect all rows", "Add appropriate WHERE clause to limit affected rows"),
            (has("SET") & has("WHERE"), "UPDATE on columns with indexes may require index maintenance", "Consider impact on indexes and potential fragmentation"),
        ],
        "DELETE": [
            (~has("WHERE"), "DELETE without WHERE clause will remove all rows", "Add appropriate WHERE clause to limit affected rows"),
            (has("WHERE") & ~has("LIMIT"), "Large DELETE operations may lock tables for extended periods", "Consider batching DELETE operations or using TRUNCATE for full table"),
        ],
    }


def lint(statements: DataFrame, sql: str = "sql_text") -> DataFrame:
    """statements with kind and the arrays warnings and suggestions; other kinds of statement have none."""
    start = F.upper(F.trim(F.col(sql)))
    kind = F
    for k in ("SELECT", "INSERT", "UPDATE", "DELETE"):
        kind = kind.when(start.startswith(k), F.lit(k))
    warnings = suggestions = F.expr("cast(array() AS array<string>)")
    for k, found in rules(F.col(sql)).items():
        ok = lambda c: F.lit(True) if c is None else c
        warnings = F.when(start.startswith(k), F.array_compact(F.array(*[F.when(ok(c), F.lit(w)) for c, w, _ in found]))).otherwise(warnings)
        suggestions = F.when(start.startswith(k), F.array_compact(F.array(*[F.when(ok(c), F.lit(s)) for c, _, s in found if s]))).otherwise(suggestions)
    return statements.withColumn("kind", kind).withColumn("warnings", warnings).withColumn("suggestions", suggestions)


def rewrite(statements: DataFrame, schema: DataFrame | None = None, sql: str = "sql_text") -> DataFrame:
    """id, rule_id, rewritten, reason: what the rewrite rules make of each statement, or why they do not apply.

    schema: table_name, columns (array). There is no result to match: the catalogue gives names only, and the
    safe subset is this engine's own. Joins are never rewritten, only reported.
    """
    s = F.col(sql)
    table = F.regexp_extract(s, r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_.]*)", 1)
    base = statements.select("id", s.alias("sql"), F.lower(table).alias("_t"))
    if schema is not None:
        base = base.join(schema.select(F.lower("table_name").alias("_t"), "columns"), "_t", "left")
    else:
        base = base.withColumn("columns", F.lit(None).cast("array<string>"))
    q = F.col("sql")
    equal = F.regexp_extract_all(q, F.lit(r"(?i)([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(?:\?|\$\d+|'[^']*'|\d+)"), 1)
    where = q.rlike(r"(?i)\bWHERE\b")
    t = F.regexp_extract(q, r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_.]*)", 1)
    star = q.rlike(r"(?i)^\s*SELECT\s+\*\s+FROM\b")
    out = lambda i, text, reason: F.struct(F.lit(i).alias("rule_id"), text.alias("rewritten"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    listed = F.array_join(F.col("columns"), ", ")
    found = [
        F.when(star & (F.size("columns") > 0), out("eliminate-select-star", F.concat(F.lit("SELECT "), listed, F.lit(" "), F.regexp_replace(q, r"(?i)^\s*SELECT\s+\*\s+", "")), F.lit("columns listed"))),
        F.when(star & ~F.coalesce(F.size("columns") > 0, F.lit(False)), out("eliminate-select-star", none, F.lit("columns of the table are not known"))),
        F.when(where & (F.size(equal) > 0) & (t != ""), out("detect-duplicate-eq-keys", F.concat(F.lit("SELECT "), F.array_join(equal, ", "), F.lit(", count(*) FROM "), t, F.lit(" GROUP BY "), F.array_join(equal, ", "), F.lit(" HAVING count(*) > 1")), F.lit("probe for repeated keys"))),
        F.when(q.rlike(r"(?i)\b(EXISTS|IN)\s*\(\s*SELECT\b"), out("subquery-to-join", none, F.lit("a subquery could be a join"))),
        F.when(q.rlike(r"(?i)=\s*(\?|\$\d+)") & (F.size(equal) > 0) & (t != ""), out("extract-candidate-values", F.concat(F.lit("SELECT "), equal[0], F.lit(", count(*) FROM "), t, F.lit(" GROUP BY "), equal[0], F.lit(" ORDER BY count(*) DESC LIMIT 10")), F.lit("probe for parameter values"))),
    ]
    return base.select("id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("id", "r.*")
