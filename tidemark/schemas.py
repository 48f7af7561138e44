"""Relations of the engine: columns, closed value sets, default thresholds, templates and rule catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the stored relations.
TABLES = {
    "reports": "id long, instance_name string, generation_time string, snapshot_start string, snapshot_end string, file_path string, file_size long, status string, created_at string",
    "efficiency_metrics": "report_id long, buffer_hit_percent double, cpu_efficiency_percent double, soft_parse_rate_percent double, hard_parse_rate_percent double, execution_efficiency_percent double",
    "load_profile": "report_id long, db_time_per_sec double, cpu_time_per_sec double, io_requests_per_sec double, total_transactions long, commits_per_sec double, rollbacks_per_sec double",
    "database_stats": "report_id long, db_name string, backends long, xact_commit long, xact_rollback long, blks_read long, blks_hit long, tuple_returned long, tuple_fetched long, tuple_inserted long, tuple_updated long, tuple_deleted long, conflicts long, temp_files long, temp_bytes long, deadlocks long, blk_read_time double, blk_write_time double, stats_reset string",
    "top_sqls": "id long, report_id long, sql_id string, sql_text string, executions long, total_elapsed_time double, cpu_time double, io_time double, buffer_gets long, disk_reads long, rows_processed long, first_load_time string, last_load_time string, is_hot_sql boolean, rank_by_time int",
    "execution_plans": "id long, sql_id long, plan_tree string, created_at string, source string",
    "cache_io_stats": "report_id long, schema_name string, object_name string, object_type string, heap_blks_read long, heap_blks_hit long, heap_hit_ratio double, idx_blks_read long, idx_blks_hit long, idx_hit_ratio double, toast_blks_read long, toast_blks_hit long, toast_hit_ratio double, tidx_blks_read long, tidx_blks_hit long, tidx_hit_ratio double",
    "object_stats": "report_id long, schema_name string, object_name string, object_type string, total_scans long, seq_scans long, idx_scans long, seq_reads long, idx_reads long, inserts long, updates long, deletes long, dead_tuples long, needs_vacuum boolean",
    "comparisons": "id long, source_report_id long, target_report_id long, created_at string, comparison_type string, performance_score_change int, status string, conclusion string, key_findings array<struct<category:string,metric:string,change_percent:double,severity:string,description:string>>",
    "sql_comparison_metrics": "id long, comparison_id long, sql_id long, sql_text_hash string, source_metrics map<string,double>, target_metrics map<string,double>, change_percentages map<string,double>",
    "threshold_configs": "category string, data_type string, config_key string, value double, default_value double, min_value double, max_value double",
    "sql_audit_issues": "id long, report_id long, sql_id long, issue_type string, severity string, title string, description string, problematic_sql string, recommendation string, status string, detected_at string, resolved_at string, resolved_by string",
    "audit_logs": "id long, timestamp string, user_id string, action string, entity_type string, entity_id string, old_value string, new_value string, ip_address string, success boolean, error_message string, details string",
    "wait_events": "report_id long, event string, wait_class string, waits long, total_wait_time double, avg_wait_time double, max_wait_time double, pct double",
    "sql_texts": "report_id long, sql_id string, sql_text string",
    "config_settings": "report_id long, name string, value string, value_type string, category string",
    "host_cpu": "report_id long, cpus string, cores string, sockets string",
    "io_profile": "report_id long, io_type string, reads double, writes double",
    "memory_stats": "report_id long, component string, begin_value string, end_value string",
}

#: Closed sets, severities from worst to least.
ISSUE_TYPES = ("FullTableScan", "MissingIndex", "InefficientJoin", "MissingStats", "ExpensiveFunction", "CartesianProduct", "NestedLoopWithIndex", "HashJoinTooLarge", "SortOperation")
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
ISSUE_STATUSES = ("Open", "Reviewed", "Whitelisted", "Fixed", "Ignored")
RESOLVING_STATUSES = ("Fixed", "Whitelisted", "Ignored")
SIGNING_STATUSES = ("Fixed", "Whitelisted")
#: Names that a report's status may arrive under, and the name that is stored.
REPORT_STATUSES = {"Success": "SuccessfullyImported", "completed": "SuccessfullyImported", "SuccessfullyImported": "SuccessfullyImported", "PartiallyImported": "PartiallyImported", "ImportFailed": "ImportFailed"}

#: Default thresholds (category, type, key, default, least, most).
THRESHOLDS = (
    ("SQL", "Float", "sql_top_time", 1000.0, 100.0, 5000.0),
    ("SQL", "Integer", "sql_scan_rows", 100000.0, 10000.0, 1000000.0),
    ("SQL", "Float", "sql_cpu_time", 500.0, 100.0, 5000.0),
    ("SQL", "Float", "sql_io_time", 1000.0, 100.0, 10000.0),
    ("SQL", "Float", "sql_buffer_gets", 10000.0, 1000.0, 100000.0),
    ("WAIT", "Float", "wait_max_lock", 3000.0, 1000.0, 10000.0),
    ("WAIT", "Float", "wait_max_io", 5000.0, 1000.0, 30000.0),
    ("WAIT", "Float", "wait_max_lwlock", 2000.0, 500.0, 10000.0),
    ("SYSTEM", "Percentage", "sys_cpu_usage", 80.0, 60.0, 100.0),
    ("SYSTEM", "Percentage", "sys_memory_usage", 85.0, 70.0, 95.0),
    ("SYSTEM", "Float", "sys_disk_io", 80.0, 50.0, 100.0),
    ("SYSTEM", "Percentage", "sys_buffer_hit", 95.0, 90.0, 100.0),
    ("AI", "Integer", "ai_sample_size", 1000.0, 100.0, 10000.0),
    ("AI", "Float", "ai_confidence", 0.8, 0.5, 1.0),
)

#: Templates (name, key, value).
TEMPLATES = (
    ("High Concurrency", "sql_execution_time_ms", 3000.0),
    ("High Concurrency", "sql_cpu_time_ms", 2000.0),
    ("Low Resource", "sql_execution_time_ms", 500.0),
    ("Low Resource", "cpu_usage_percent", 60.0),
    ("Development", "sql_execution_time_ms", 5000.0),
    ("Development", "sql_buffer_gets", 100000.0),
    ("Production", "sql_execution_time_ms", 1000.0),
    ("Production", "cpu_usage_percent", 80.0),
    ("GaussDB Optimized", "sql_execution_time_ms", 1500.0),
    ("GaussDB Optimized", "full_table_scan_cost", 500.0),
)

#: Catalogue of plan rules (id, category, title, description, severity).
PLAN_RULES = (
    ("SCAN-001", "Scan", "Large table full scan", "Seq Scan on table exceeding row threshold", "Warning"),
    ("SCAN-004", "Scan", "Filter without index", "Filter removing many rows without index support", "Warning"),
    ("JOIN-001", "Join", "Nested loop on large tables", "Nested loop join with high row counts", "Warning"),
    ("JOIN-002", "Join", "Hash join spill to disk", "Hash join exceeding work_mem", "Critical"),
    ("MEM-001", "Memory", "Sort spill to disk", "External merge sort including VectorSort", "Critical"),
    ("MEM-004", "Memory", "High peak memory", "Highest-memory node in subtree", "Warning"),
    ("SORT-003", "Sort", "Duplicate sort", "Recursive subtree duplicate Sort Keys", "Info"),
    ("NET-001", "Network", "Broadcast large data", "Broadcasting excessive rows", "Warning"),
    ("EST-001", "Estimation", "Severe row estimation error", "Actual rows far exceed/fall below estimate", "Warning"),
    ("EST-004", "Estimation", "Nested loop from underestimation", "Nested Loop caused by row underestimation", "Warning"),
    ("PUSH-001", "Pushdown", "Query not pushed down", "FQS failure with signal accumulation", "Critical"),
    ("PUSH-002", "Pushdown", "Multi-layer streaming", "Streaming layer chain detected", "Warning"),
    ("TYPE-001", "Type", "Implicit type coercion", "TypeMismatch with fix suggestions", "Warning"),
    ("TYPE-004", "Type", "LIKE with leading wildcard", "Leading wildcard prevents index usage", "Info"),
    ("VEC-001", "Vectorization", "Mixed row/vector engines", "Row↔Vector adapter boundaries", "Info"),
    ("GEN-001", "General", "Plan too deep", "Plan depth exceeds threshold", "Info"),
    ("SUBQ-001", "Subquery", "Subquery not pulled up", "SubqueryScan nodes detected", "Warning"),
    ("REW-001", "Subquery", "Large IN list not rewritten", "IN lists with many values", "Info"),
    ("SUBQ-006", "Subquery", "Correlated subquery self-update", "Self-referencing correlated subqueries", "Critical"),
    ("AGG-001", "Aggregate", "Group aggregate should be hash", "Suggest Hash Aggregate for large GROUP BY", "Info"),
    ("AGG-002", "Aggregate", "Hash aggregate spill to disk", "Hash Aggregate exceeding work_mem", "Critical"),
    ("SKEW-001", "Distribution", "Data skew detected", "Uneven row distribution across datanodes", "Warning"),
    ("DIST-001", "Distribution", "Distribution column mismatch", "Join columns don't match distribution columns", "Warning"),
    ("STATS-001", "Statistics", "Stats not collected", "Tables with missing or stale statistics", "Warning"),
    ("PART-001", "Partition", "Partition pruning failure", "Full partition scan when pruning should help", "Warning"),
)

#: Catalogue of statement rewrites (id, category, safety, description, on by default).
REWRITES = (
    ("eliminate-select-star", "Semantic", "Safe", "SELECT * → explicit column list (requires schema)", True),
    ("detect-duplicate-eq-keys", "DataQuality", "Manual", "WHERE equalities → GROUP BY uniqueness probe", True),
    ("subquery-to-join", "Performance", "Conditional", "EXISTS/IN subqueries → JOIN", True),
    ("extract-candidate-values", "DataQuality", "Manual", "Parameterized columns → candidate value probe", False),
)


def literal(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """A small constant relation, as a local relation that Catalyst folds into the plan."""
    return spark.createDataFrame(list(rows), schema)


def thresholds(spark: SparkSession) -> DataFrame:
    return literal(spark, tuple((c, t, k, v, v, lo, hi) for c, t, k, v, lo, hi in THRESHOLDS), TABLES["threshold_configs"])


def templates(spark: SparkSession) -> DataFrame:
    return literal(spark, TEMPLATES, "template string, config_key string, value double")


def plan_rules(spark: SparkSession) -> DataFrame:
    return literal(spark, PLAN_RULES, "rule_id string, category string, title string, description string, severity string")


def rewrites(spark: SparkSession) -> DataFrame:
    return literal(spark, REWRITES, "id string, category string, safety_level string, description string, default_enabled boolean")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
