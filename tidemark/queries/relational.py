"""Queries of the relational core: catalogue, comparison, audit, thresholds, sets and scalar functions."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as fn
from tidemark.operators import audit, catalog, compare, facade, store, thresholds
from tidemark.queries import ORACLES, query
from tidemark.sources.adapters import duckdb_ctes as ctes
from tidemark.sources.adapters import id_of, keyed, load
from tidemark.sources.shared import shared_folder, written


def sqls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "top_sqls")


def values(rows: tuple, names: str) -> str:
    """A VALUES relation for DuckDB."""
    lit = lambda x: "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


TOP, REP, WAIT, OBJ = ctes("top_sqls"), ctes("reports"), ctes("wait_events"), ctes("object_stats")
TOP_REP = ctes("top_sqls", "reports")
CORE = "id, report_id, sql_id, sql_text, executions, total_elapsed_time, buffer_gets, disk_reads, rows_processed"
CORE_COLS = [c.strip() for c in CORE.split(",")]
CFG = values(tuple((c, t, k, v, v, lo, hi) for c, t, k, v, lo, hi in schemas.THRESHOLDS), "category, data_type, config_key, value, default_value, min_value, max_value")
CFG_COLS = "category, data_type, config_key, CAST(value AS DOUBLE) AS value, CAST(default_value AS DOUBLE) AS default_value, CAST(min_value AS DOUBLE) AS min_value, CAST(max_value AS DOUBLE) AS max_value"

# ---- filters and projections


@query("src.report_table", REP + "SELECT id, instance_name, status FROM reports")
def src_report_table(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "reports").select("id", "instance_name", "status")


@query("flt.by_id", TOP + f"SELECT {CORE} FROM top_sqls WHERE report_id = 11995")
def flt_by_id(s: SparkSession, d: str) -> DataFrame:
    return catalog.by_value(sqls(s, d), "report_id", 11995).select(*CORE_COLS)


@query("flt.hot_sql", TOP + "SELECT id, total_elapsed_time FROM top_sqls WHERE is_hot_sql")
def flt_hot_sql(s: SparkSession, d: str) -> DataFrame:
    return sqls(s, d).filter("is_hot_sql").select("id", "total_elapsed_time")


@query("flt.category", f"SELECT {CFG_COLS} FROM {CFG} WHERE category = 'SQL'")
def flt_category(s: SparkSession, d: str) -> DataFrame:
    return catalog.by_value(schemas.thresholds(s), "category", "SQL")


@query("flt.user_search", TOP + "SELECT id, sql_text FROM top_sqls WHERE report_id = 11995 AND contains(lower(sql_text), 'order by')")
def flt_user_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.containing(sqls(s, d), ["sql_text"], "ORDER BY", report_id=11995).select("id", "sql_text")


@query("flt.wait_search", WAIT + "SELECT report_id, event, waits FROM wait_events WHERE wait_class = 'IO' AND contains(lower(event), 'purch')")
def flt_wait_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.containing(load(s, d, "wait_events"), ["event"], "Purch", wait_class="IO").select("report_id", "event", "waits")


@query("flt.object_search", OBJ + "SELECT report_id, object_name, dead_tuples FROM object_stats WHERE object_type = 'table' AND schema_name = 'public' AND contains(lower(object_name), 'a')")
def flt_object_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.containing(load(s, d, "object_stats"), ["object_name"], "A", object_type="table", schema_name="public").select("report_id", "object_name", "dead_tuples")


@query("flt.config_search", f"SELECT config_key, CAST(value AS DOUBLE) AS value FROM {CFG} WHERE contains(lower(config_key), 'io') OR contains(lower(category), 'io')")
def flt_config_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.containing(schemas.thresholds(s), ["config_key", "category"], "IO").select("config_key", "value")


RULES = values(schemas.PLAN_RULES, "rule_id, category, title, description, severity")


@query("flt.rules_catalog", f"SELECT rule_id, category, title, description, severity FROM {RULES} WHERE (contains(lower(title), 'spill') OR contains(lower(description), 'spill') OR contains(lower(rule_id), 'spill')) AND category = 'Join'")
def flt_rules_catalog(s: SparkSession, d: str) -> DataFrame:
    return catalog.containing(schemas.plan_rules(s), ["title", "description", "rule_id"], "spill", category="Join")


@query("flt.diag_severity", f"SELECT rule_id, severity FROM {RULES} WHERE severity IN ('Critical', 'Warning')")
def flt_diag_severity(s: SparkSession, d: str) -> DataFrame:
    return schemas.plan_rules(s).filter(F.col("severity").isin("Critical", "Warning")).select("rule_id", "severity")


@query("plan.catalog25", f"SELECT rule_id, category, title, description, severity FROM {RULES}")
def plan_catalog25(s: SparkSession, d: str) -> DataFrame:
    return schemas.plan_rules(s)


@query("prj.hot_sql_enriched", TOP_REP + "SELECT t.id, t.report_id, r.instance_name, r.snapshot_end AS generation_time, coalesce(t.rank_by_time, 0) AS rank FROM top_sqls t JOIN reports r ON t.report_id = r.id WHERE t.is_hot_sql")
def prj_hot_sql_enriched(s: SparkSession, d: str) -> DataFrame:
    return catalog.hot_sql_enriched(sqls(s, d), load(s, d, "reports")).select("id", "report_id", "instance_name", "generation_time", "rank")


@query("prj.truncate_sql", TOP + "SELECT id, CASE WHEN length(sql_text) > 30 THEN concat(substring(sql_text, 1, 27), '...') ELSE sql_text END AS short FROM top_sqls")
def prj_truncate_sql(s: SparkSession, d: str) -> DataFrame:
    return sqls(s, d).select("id", fn.truncate_text("sql_text", 30).alias("short"))


@query("prj.distinct_values", WAIT + "SELECT DISTINCT wait_class FROM wait_events")
def prj_distinct_values(s: SparkSession, d: str) -> DataFrame:
    return catalog.distinct_values(load(s, d, "wait_events"), "wait_class")


# ---- joins

PAIRS = ", pairs AS (SELECT id AS source_report_id, target_report_id FROM (SELECT id, lead(id) OVER (PARTITION BY instance_name ORDER BY snapshot_start, id) AS target_report_id FROM reports) WHERE target_report_id IS NOT NULL)\n"
FP = r"md5(upper(trim(regexp_replace(sql_text, '\s+', ' ', 'g'))))"
EACH = f", each AS (SELECT * FROM (SELECT *, {FP} AS fp, row_number() OVER (PARTITION BY report_id, {FP} ORDER BY rank_by_time DESC, id DESC) AS rn FROM top_sqls) WHERE rn = 1)\n"
MATCHED = TOP_REP.rstrip() + PAIRS + EACH + """, matched AS (SELECT p.source_report_id, p.target_report_id, a.fp, a.sql_id, a.id AS source_id, b.id AS target_id,
 a.total_elapsed_time AS e1, b.total_elapsed_time AS e2, a.cpu_time AS c1, b.cpu_time AS c2, a.disk_reads AS d1, b.disk_reads AS d2, a.executions AS x1, b.executions AS x2
 FROM pairs p JOIN each a ON a.report_id = p.source_report_id JOIN each b ON b.report_id = p.target_report_id AND b.fp = a.fp)
, changed AS (SELECT *, CASE WHEN e1 <> 0 THEN (e2 - e1) / e1 * 100 END AS ec, CASE WHEN c1 <> 0 THEN (c2 - c1) / c1 * 100 END AS cc,
 CASE WHEN d1 <> 0 THEN (CAST(d2 AS DOUBLE) - d1) / CAST(d1 AS DOUBLE) * 100 END AS dc FROM matched)
"""
FOUND = MATCHED + """, found AS (
 SELECT source_report_id, target_report_id, fp, 'Elapsed Time' AS metric, ec AS change_percent, CASE WHEN abs(ec) >= 50 THEN 'Critical' WHEN abs(ec) >= 20 THEN 'Warning' ELSE 'Info' END AS severity FROM changed WHERE abs(ec) >= 15
 UNION ALL SELECT source_report_id, target_report_id, fp, 'CPU Time', cc, CASE WHEN abs(cc) >= 50 THEN 'Critical' ELSE 'Warning' END FROM changed WHERE abs(cc) >= 20
 UNION ALL SELECT source_report_id, target_report_id, fp, 'Disk Reads', dc, CASE WHEN abs(dc) >= 60 THEN 'Critical' ELSE 'Warning' END FROM changed WHERE abs(dc) >= 30)
"""
MEANS = """, means AS (SELECT source_report_id, target_report_id, count(*) AS common, CAST(coalesce(sum(CAST(ec AS DECIMAL(38,10))), 0) AS DOUBLE) / count(*) AS me,
 CAST(coalesce(sum(CAST(cc AS DECIMAL(38,10))), 0) AS DOUBLE) / count(*) AS mc, CAST(coalesce(sum(CAST(dc AS DECIMAL(38,10))), 0) AS DOUBLE) / count(*) AS md FROM changed GROUP BY 1, 2)
, scored AS (SELECT *, CAST(trunc(greatest(-100, least(100, (-me * 0.35 - mc * 0.25 - md * 0.10) / 0.7))) AS INTEGER) AS score FROM means)
"""


def metrics(s: SparkSession, d: str) -> DataFrame:
    pairs = compare.adjacent_pairs(load(s, d, "reports"))
    return compare.sql_metrics(compare.fingerprint_join(sqls(s, d), pairs))


@query("join.fingerprint", MATCHED + "SELECT source_report_id, target_report_id, fp, source_id, target_id, e1 AS source_elapsed_time, e2 AS target_elapsed_time FROM matched")
def join_fingerprint(s: SparkSession, d: str) -> DataFrame:
    out = compare.fingerprint_join(sqls(s, d), compare.adjacent_pairs(load(s, d, "reports")))
    return out.select("source_report_id", "target_report_id", "fp", "source_id", "target_id", "source_elapsed_time", "target_elapsed_time")


@query("set.common_sql", MATCHED + "SELECT source_report_id, target_report_id, count(*) AS common FROM matched GROUP BY 1, 2")
def set_common_sql(s: SparkSession, d: str) -> DataFrame:
    return compare.common_fingerprints(sqls(s, d), compare.adjacent_pairs(load(s, d, "reports")))


@query("cmp.metric", MATCHED + "SELECT source_report_id, target_report_id, fp, ec AS elapsed_time_change, cc AS cpu_time_change, dc AS disk_reads_change FROM changed")
def cmp_metric(s: SparkSession, d: str) -> DataFrame:
    return metrics(s, d).select("source_report_id", "target_report_id", "fp", "elapsed_time_change", "cpu_time_change", "disk_reads_change")


@query("cmp.details", MATCHED + "SELECT source_report_id, target_report_id, fp, x1 AS source_executions, x2 AS target_executions FROM matched WHERE source_report_id = 1995 ORDER BY fp LIMIT 50")
def cmp_details(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(metrics(s, d).filter("source_report_id = 1995").select("source_report_id", "target_report_id", "fp", "source_executions", "target_executions"), [F.col("fp"), F.col("target_report_id")], 50)


@query("agg.comparison_means", MATCHED + MEANS + "SELECT source_report_id, target_report_id, common, round(me, 4) AS mean_elapsed_time, round(mc, 4) AS mean_cpu_time, round(md, 4) AS mean_disk_reads FROM means")
def agg_comparison_means(s: SparkSession, d: str) -> DataFrame:
    m = compare.mean_changes(metrics(s, d))
    return m.select("source_report_id", "target_report_id", "common", *[F.round(c, 4).alias(c) for c in ("mean_elapsed_time", "mean_cpu_time", "mean_disk_reads")])


@query("fn.score", MATCHED + MEANS + "SELECT source_report_id, target_report_id, score FROM scored")
def fn_score(s: SparkSession, d: str) -> DataFrame:
    return compare.summaries(metrics(s, d), load(s, d, "reports")).select("source_report_id", "target_report_id", "score")


SUMMARY_SQL = FOUND + MEANS + """, nf AS (SELECT source_report_id, target_report_id, least(count(*), 10) AS n FROM found GROUP BY 1, 2)
SELECT c.source_report_id, c.target_report_id, c.common, c.score, a.instance_name AS source_instance, b.instance_name AS target_instance,
 CASE WHEN a.instance_name = b.instance_name THEN 'TimeBased' ELSE 'InstanceBased' END AS comparison_type,
 CASE WHEN score >= 15 THEN 'Improved' WHEN score <= -15 THEN 'Degraded' ELSE 'NoSignificantChange' END AS status, coalesce(nf.n, 0) AS n_findings,
 CASE WHEN score >= 15 THEN concat('Performance improved by ', score, ' points with ', coalesce(nf.n, 0), ' significant changes') WHEN score <= -15 THEN concat('Performance degraded by ', abs(score), ' points with ', coalesce(nf.n, 0), ' significant changes')
 ELSE concat('Performance remained stable with ', coalesce(nf.n, 0), ' notable changes') END AS conclusion
FROM scored c LEFT JOIN nf USING (source_report_id, target_report_id) LEFT JOIN reports a ON a.id = c.source_report_id LEFT JOIN reports b ON b.id = c.target_report_id"""
SUMMARY_COLS = ["source_report_id", "target_report_id", "common", "score", "source_instance", "target_instance", "comparison_type", "status", "n_findings", "conclusion"]


@query("cmp.run", SUMMARY_SQL)
def cmp_run(s: SparkSession, d: str) -> DataFrame:
    return compare.summaries(metrics(s, d), load(s, d, "reports")).select(*SUMMARY_COLS)


@query("cmp.summary", SUMMARY_SQL + " WHERE c.source_report_id = 1995")
def cmp_summary(s: SparkSession, d: str) -> DataFrame:
    return cmp_run(s, d).filter("source_report_id = 1995")


@query("cmp.list", SUMMARY_SQL + " ORDER BY score DESC, c.source_report_id LIMIT 10")
def cmp_list(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(cmp_run(s, d), [F.desc("score"), F.col("source_report_id")], 10)


@query("fn.comparison_type", SUMMARY_SQL.replace("c.common, c.score, ", "").split(",\n CASE WHEN score")[0] + " FROM scored c LEFT JOIN reports a ON a.id = c.source_report_id LEFT JOIN reports b ON b.id = c.target_report_id")
def fn_comparison_type(s: SparkSession, d: str) -> DataFrame:
    return cmp_run(s, d).select("source_report_id", "target_report_id", "source_instance", "target_instance", "comparison_type")


@query("fn.status", MATCHED + MEANS + "SELECT source_report_id, CASE WHEN score >= 15 THEN 'Improved' WHEN score <= -15 THEN 'Degraded' ELSE 'NoSignificantChange' END AS status FROM scored")
def fn_status(s: SparkSession, d: str) -> DataFrame:
    return cmp_run(s, d).select("source_report_id", "status")


@query("fn.findings", FOUND + "SELECT source_report_id, target_report_id, fp, metric, severity, change_percent FROM found")
def fn_findings(s: SparkSession, d: str) -> DataFrame:
    return compare.findings(metrics(s, d)).select("source_report_id", "target_report_id", "fp", "metric", "severity", "change_percent")


RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'Warning' THEN 1 ELSE 4 END"


@query("srt.findings_top10", FOUND + f"SELECT * FROM (SELECT source_report_id, target_report_id, fp, metric, severity, row_number() OVER (PARTITION BY source_report_id, target_report_id ORDER BY {RANK}, abs(change_percent) DESC, metric, fp) AS position FROM found) WHERE position <= 10")
def srt_findings_top10(s: SparkSession, d: str) -> DataFrame:
    return compare.top_findings(compare.findings(metrics(s, d))).select("source_report_id", "target_report_id", "fp", "metric", "severity", "position")


CHART = MATCHED + "SELECT * FROM (SELECT source_report_id, target_report_id, row_number() OVER (PARTITION BY source_report_id, target_report_id ORDER BY source_id) AS position, e1 AS source_elapsed_time, e2 AS target_elapsed_time, concat('SQL ', row_number() OVER (PARTITION BY source_report_id, target_report_id ORDER BY source_id)) AS label FROM matched) WHERE position <= 20"


@query("cmp.chart", CHART)
def cmp_chart(s: SparkSession, d: str) -> DataFrame:
    return compare.chart(metrics(s, d))


@query("win.chart_label", f"SELECT source_report_id, target_report_id, label FROM ({CHART})")
def win_chart_label(s: SparkSession, d: str) -> DataFrame:
    return compare.chart(metrics(s, d)).select("source_report_id", "target_report_id", "label")


@query("join.comparison_names", TOP_REP.rstrip() + PAIRS + "SELECT p.source_report_id, p.target_report_id, a.instance_name AS source_instance, b.instance_name AS target_instance FROM pairs p LEFT JOIN reports a ON a.id = p.source_report_id LEFT JOIN reports b ON b.id = p.target_report_id")
def join_comparison_names(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "reports")
    name = lambda side: r.select(F.col("id").alias(f"{side}_report_id"), F.col("instance_name").alias(f"{side}_instance"))
    return compare.adjacent_pairs(r).join(name("source"), "source_report_id", "left").join(name("target"), "target_report_id", "left").select("source_report_id", "target_report_id", "source_instance", "target_instance")


@query("join.hot_sql_report", TOP_REP + "SELECT t.id, r.instance_name, r.status FROM top_sqls t JOIN reports r ON t.report_id = r.id WHERE t.is_hot_sql AND r.status <> 'ImportFailed'")
def join_hot_sql_report(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "reports").filter("status <> 'ImportFailed'").select(F.col("id").alias("report_id"), "instance_name", "status")
    return sqls(s, d).filter("is_hot_sql").join(r, "report_id").select("id", "instance_name", "status")


NWAY = TOP.rstrip() + """, base AS (SELECT sql_id, total_elapsed_time AS total, executions AS calls FROM top_sqls WHERE report_id = 1995),
tgt AS (SELECT sql_id, total_elapsed_time AS total, executions AS calls, report_id - 1995 AS ordinal FROM top_sqls WHERE report_id IN (1996, 1997))
"""


def nway_sql(key: str) -> str:
    return NWAY + f""", top AS (SELECT b.*, {key} AS sort_key FROM base b LEFT JOIN (SELECT * FROM tgt WHERE ordinal = 1) t ON b.sql_id = t.sql_id ORDER BY sort_key DESC, b.sql_id LIMIT 20)
SELECT top.sql_id, CAST(o.ordinal AS BIGINT) AS ordinal, top.total, top.calls, round(top.sort_key, 4) AS sort_key, coalesce(g.total, 0.0) AS target_total, coalesce(g.calls, 0) AS target_calls,
 round(CASE WHEN top.total = 0 AND coalesce(g.total, 0) = 0 THEN NULL WHEN top.total = 0 THEN 0 ELSE (coalesce(g.total, 0) - top.total) / top.total * 100 END, 4) AS delta_percent, coalesce(g.total, 0) > top.total AS is_worse
FROM top CROSS JOIN (SELECT DISTINCT ordinal FROM tgt) o LEFT JOIN tgt g ON g.sql_id = top.sql_id AND g.ordinal = o.ordinal"""


def nway(s: SparkSession, d: str, mode: str) -> DataFrame:
    t = sqls(s, d)
    pick = lambda df: df.select("sql_id", F.col("total_elapsed_time").alias("total"), F.col("executions").alias("calls"), F.lit(10.0).alias("seconds"))
    base = pick(t.filter("report_id = 1995"))
    tg = t.filter("report_id IN (1996, 1997)")
    targets = tg.select("sql_id", F.col("total_elapsed_time").alias("total"), F.col("executions").alias("calls"), F.lit(10.0).alias("seconds"), (F.col("report_id") - 1995).alias("ordinal"))
    out = compare.n_way(base, targets, mode)
    return out.select("sql_id", "ordinal", "total", "calls", F.round("sort_key", 4).alias("sort_key"), "target_total", "target_calls", F.round("delta_percent", 4).alias("delta_percent"), "is_worse")


NWAY_KEYS = {"total": "b.total", "avg": "CASE WHEN b.calls > 0 THEN b.total / b.calls ELSE 0 END", "diff": "abs(coalesce(t.total, 0) - b.total)", "calls_diff": "abs(coalesce(t.calls / 10.0, 0) - b.calls / 10.0)"}
for _mode, _name in (("total", "cmp.nway"), ("avg", "join.sql_unique_id"), ("diff", "srt.nway_top20"), ("calls_diff", "fn.calls_per_sec")):
    query(_name, nway_sql(NWAY_KEYS[_mode]))(lambda s, d, m=_mode: nway(s, d, m))


LOADS = TOP.rstrip() + """, l AS (SELECT report_id, unnest(['elapsed', 'cpu', 'io']) AS metric, unnest([sum(CAST(total_elapsed_time AS DECIMAL(20,4))), sum(CAST(cpu_time AS DECIMAL(20,4))), sum(CAST(io_time AS DECIMAL(20,4)))]) AS v FROM top_sqls WHERE report_id IN (1995, 1996) GROUP BY report_id)
SELECT a.metric, CAST(a.v AS DOUBLE) AS base_value, CAST(coalesce(b.v, 0) AS DOUBLE) AS target_value, round((CAST(b.v AS DOUBLE) - CAST(a.v AS DOUBLE)) / CAST(a.v AS DOUBLE) * 100, 4) AS delta_percent, {bad} AS is_worse
FROM l a LEFT JOIN l b ON a.metric = b.metric AND b.report_id = 1996 WHERE a.report_id = 1995"""


def loads(s: SparkSession, d: str, report: int) -> DataFrame:
    t = sqls(s, d).filter(F.col("report_id") == report)
    total = t.agg(*[F.sum(F.col(c).cast("decimal(20,4)")).alias(m) for m, c in (("elapsed", "total_elapsed_time"), ("cpu", "cpu_time"), ("io", "io_time"))])
    return total.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("elapsed", "cpu", "io")])).alias("x")).select("x.*")


for _name, _reverse, _bad in (("join.load_metric", False, "b.v > a.v"), ("join.efficiency", True, "b.v < a.v")):
    query(_name, LOADS.format(bad=_bad))(lambda s, d, r=_reverse: compare.left_by_name(loads(s, d, 1995), loads(s, d, 1996), "metric", "v", reverse=r).withColumn("delta_percent", F.round("delta_percent", 4)))


@query("fn.delta_cell", LOADS.format(bad="b.v > a.v").replace("CAST(coalesce(b.v, 0) AS DOUBLE)", "CAST(b.v AS DOUBLE)"))
def fn_delta_cell(s: SparkSession, d: str) -> DataFrame:
    return compare.left_by_name(loads(s, d, 1995), loads(s, d, 1996), "metric", "v", default=None).withColumn("delta_percent", F.round("delta_percent", 4))


@query("join.wait_event", WAIT.rstrip() + """, e AS (SELECT event, report_id % 10000 AS y, sum(waits) AS waits FROM wait_events GROUP BY 1, 2), b AS (SELECT * FROM e WHERE y = (SELECT min(y) FROM e) ORDER BY event LIMIT 15)
SELECT b.event, CAST(b.waits AS BIGINT) AS base_value, CAST(t.waits AS BIGINT) AS target_value FROM b LEFT JOIN e t ON t.event = b.event AND t.y = (SELECT max(y) FROM e)""")
def join_wait_event(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "wait_events").groupBy("event", (F.col("report_id") % 10000).alias("y")).agg(F.sum("waits").alias("waits"))
    ends = e.agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    base = e.join(ends, e["y"] == ends["y0"]).select("event", "waits").orderBy("event").limit(15)
    other = e.join(ends, e["y"] == ends["y1"]).select("event", "waits")
    return compare.left_by_name(base, other, "event", "waits", default=None).select("event", "base_value", "target_value")


@query("join.sql_text_map", TOP.rstrip() + ", m AS (SELECT sql_id, min(sql_text) AS full_text FROM top_sqls GROUP BY sql_id) SELECT t.id, coalesce(m.full_text, '') AS full_text FROM top_sqls t LEFT JOIN m ON m.sql_id = t.sql_id")
def join_sql_text_map(s: SparkSession, d: str) -> DataFrame:
    t = sqls(s, d)
    m = t.groupBy("sql_id").agg(F.min("sql_text").alias("full_text"))
    return t.select("id", "sql_id").join(m, "sql_id", "left").select("id", F.coalesce("full_text", F.lit("")).alias("full_text"))


OBJECT_SQL = """, w AS (SELECT DISTINCT id, unnest(string_split_regex(lower(sql_text), '[^a-z0-9_]+')) AS word FROM top_sqls), n AS (SELECT DISTINCT replace(object_name, ' ', '_') AS object_name FROM object_stats)
, h AS (SELECT word, object_name FROM (SELECT DISTINCT word FROM w) JOIN n ON contains(word, object_name))
SELECT DISTINCT id, object_name FROM w JOIN h USING (word)"""


@query("join.object_sql", ctes("top_sqls", "object_stats").rstrip() + OBJECT_SQL)
def join_object_sql(s: SparkSession, d: str) -> DataFrame:
    names = load(s, d, "object_stats").select(F.expr("replace(object_name, ' ', '_')").alias("object_name"))
    return catalog.objects_in_sql(sqls(s, d), names)


# ---- aggregates


@query("agg.instance_summary", REP + """SELECT instance_name, report_count, last_report, CAST(trunc(100.0 * ok / report_count) AS INTEGER) AS health_score, CASE WHEN failed > ok THEN 'Critical' WHEN failed > 0 THEN 'Warning' ELSE 'Healthy' END AS status
FROM (SELECT instance_name, count(*) AS report_count, max(snapshot_end) AS last_report, count(*) FILTER (WHERE status = 'SuccessfullyImported') AS ok, count(*) FILTER (WHERE starts_with(status, 'ImportFailed')) AS failed FROM reports GROUP BY 1)""")
def agg_instance_summary(s: SparkSession, d: str) -> DataFrame:
    return catalog.instance_summary(load(s, d, "reports"))


query("dash.instances", ORACLES["agg.instance_summary"])(agg_instance_summary)


@query("agg.count", TOP + "SELECT report_id, count(*) AS n FROM top_sqls GROUP BY report_id")
def agg_count(s: SparkSession, d: str) -> DataFrame:
    return sqls(s, d).groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))


ISSUE_PARTS = {
    "FullTableScan": ("rows_processed > 10000", "CASE WHEN rows_processed > 100000 THEN 'Critical' WHEN rows_processed > 50000 THEN 'High' ELSE 'Medium' END"),
    "MissingIndex": ("CASE WHEN buffer_gets > 0 THEN disk_reads / CAST(buffer_gets AS DOUBLE) ELSE 0 END > 0.3 AND rows_processed > 1000", "CASE WHEN CASE WHEN buffer_gets > 0 THEN disk_reads / CAST(buffer_gets AS DOUBLE) ELSE 0 END > 0.6 THEN 'High' ELSE 'Medium' END"),
    "InefficientJoin": ("has_nested_loop AND rows_processed > 10000", "'Medium'"),
    "MissingStats": ("total_elapsed_time / nullif(executions, 0) > 1000 AND executions > 10", "'Medium'"),
    "ExpensiveFunction": ("contains(upper(sql_text), 'UPPER(') OR contains(upper(sql_text), 'LOWER(') OR contains(upper(sql_text), 'SUBSTR(') OR contains(upper(sql_text), 'TRIM(') OR contains(upper(sql_text), 'TO_CHAR(')", "'Medium'"),
    "CartesianProduct": ("(length(sql_text) - length(replace(sql_text, ' FROM ', ''))) / 6 + (length(sql_text) - length(replace(sql_text, ' from ', ''))) / 6 + (length(sql_text) - length(replace(sql_text, ', ', ''))) / 2 > 1 AND rows_processed > 1000000", "'Critical'"),
    "NestedLoopWithIndex": ("has_nested_loop AND rows_processed > 100000 AND buffer_gets > 1000000", "'High'"),
    "HashJoinTooLarge": ("rows_processed > 500000", "'High'"),
    "SortOperation": ("contains(upper(sql_text), ' ORDER BY ') AND rows_processed > 50000", "'Low'"),
}
#: Statements of every third part have a plan with a nested loop, as in plan_truth.
FACTS = ", f AS (SELECT *, p_partkey % 3 = 0 AS has_nested_loop FROM top_sqls)\n"
ISSUES = TOP.rstrip() + FACTS + ", issues AS MATERIALIZED (" + "\nUNION ALL ".join(f"SELECT report_id, id AS sql_id, '{k}' AS issue_type, {sev} AS severity FROM f WHERE {cond}" for k, (cond, sev) in ISSUE_PARTS.items()) + ")\n"


def issues(s: SparkSession, d: str) -> DataFrame:
    # several statements may share an id, so they meet their plans by a key of their own
    t = keyed(sqls(s, d))
    facts = t.select(F.col("id").alias("sql_id"), F.lit(False).alias("has_seq_scan"), (F.col("p_partkey") % 3 == 0).alias("has_nested_loop"))
    return audit.audit(t, facts).withColumn("sql_id", id_of("sql_id"))


def one_rule(name: str) -> None:
    short = {"FullTableScan": "full_scan", "MissingIndex": "missing_index", "InefficientJoin": "inefficient_join", "MissingStats": "missing_stats", "ExpensiveFunction": "expensive_func", "CartesianProduct": "cartesian", "NestedLoopWithIndex": "nested_loop_index", "HashJoinTooLarge": "hash_join_large", "SortOperation": "sort"}[name]
    query(f"aud.{short}", ISSUES + f"SELECT * FROM issues WHERE issue_type = '{name}'")(lambda s, d: issues(s, d).filter(F.col("issue_type") == name).select("report_id", "sql_id", "issue_type", "severity"))


for _name in ISSUE_PARTS:
    one_rule(_name)

def stored(s: SparkSession, d: str) -> DataFrame:
    return issues(s, d).select("report_id", "sql_id", "issue_type", F.when(F.col("sql_id") % 2 == 0, "Open").otherwise("Fixed").alias("status"))


@query("aud.run", ISSUES + "SELECT report_id, issue_type, severity, count(*) AS n FROM issues GROUP BY 1, 2, 3")
def aud_run(s: SparkSession, d: str) -> DataFrame:
    return issues(s, d).groupBy("report_id", "issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


# stored holds every issue, those of even statements open
@query("join.existing_issue", ISSUES + "SELECT report_id, sql_id, issue_type FROM issues WHERE sql_id % 2 <> 0")
def join_existing_issue(s: SparkSession, d: str) -> DataFrame:
    return audit.new_issues(issues(s, d), stored(s, d)).select("report_id", "sql_id", "issue_type")


@query("flt.issues", ISSUES + "SELECT report_id, sql_id, issue_type, severity FROM issues WHERE report_id = 1995 AND severity = 'High'")
def flt_issues(s: SparkSession, d: str) -> DataFrame:
    return audit.search(issues(s, d), report_id=1995, status="Open", severity="High").select("report_id", "sql_id", "issue_type", "severity")


@query("cli.audit", ISSUES + "SELECT report_id, sql_id, issue_type, CASE severity WHEN 'Critical' THEN '🔴 CRITICAL' WHEN 'High' THEN '🟡 HIGH' WHEN 'Medium' THEN '⚠️ MEDIUM' ELSE 'ℹ️ LOW' END AS mark, concat('   Status: Open | Type: ', issue_type) AS last_line FROM issues")
def cli_audit(s: SparkSession, d: str) -> DataFrame:
    t = facade.audit_text(issues(s, d))
    return t.select("report_id", "sql_id", "issue_type", F.substring_index("text", ": ", 1).alias("mark"), F.substring_index("text", "\n", -1).alias("last_line"))


@query("flt.issue_types", ISSUES + "SELECT issue_type, count(*) AS n FROM issues WHERE issue_type IN ('SortOperation', 'MissingIndex') GROUP BY 1")
def flt_issue_types(s: SparkSession, d: str) -> DataFrame:
    return audit.audit(sqls(s, d), only=["SortOperation", "MissingIndex", "no such type"]).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg.issue_summary", ISSUES + "SELECT 'total' AS kind, 'all' AS value, count(*) AS n FROM issues UNION ALL SELECT 'severity', severity, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'status', 'Open', count(*) FROM issues UNION ALL SELECT 'issue_type', issue_type, count(*) FROM issues GROUP BY 2")
def agg_issue_summary(s: SparkSession, d: str) -> DataFrame:
    return audit.summary(issues(s, d))


@query("set.union_issues", ISSUES + "SELECT sql_id, count(*) AS n FROM issues GROUP BY sql_id")
def set_union_issues(s: SparkSession, d: str) -> DataFrame:
    return issues(s, d).groupBy("sql_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg.hot_issues", ISSUES + "SELECT issue_type, count(*) AS n FROM issues GROUP BY 1 ORDER BY n DESC, issue_type LIMIT 5")
def agg_hot_issues(s: SparkSession, d: str) -> DataFrame:
    return catalog.hot_issues(issues(s, d))


@query("agg.severity_counts", ISSUES + "SELECT severity, count(*) AS n FROM issues GROUP BY 1")
def agg_severity_counts(s: SparkSession, d: str) -> DataFrame:
    return issues(s, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


SEV = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"


@query("agg.max_severity", ISSUES + f"SELECT sql_id, arg_min(severity, {SEV}) AS severity FROM issues GROUP BY 1")
def agg_max_severity(s: SparkSession, d: str) -> DataFrame:
    return catalog.worst_severity(issues(s, d), ["sql_id"])


@query("srt.severity_case", ISSUES + f"SELECT sql_id, issue_type, severity FROM issues ORDER BY {SEV}, sql_id DESC, issue_type LIMIT 100")
def srt_severity_case(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(issues(s, d).select("sql_id", "issue_type", "severity"), [fn.severity_rank("severity"), F.desc("sql_id"), F.col("issue_type")], 100)


@query("aud.update_status", ISSUES.rstrip() + """, n AS (SELECT sql_id * 10 + CASE issue_type WHEN 'FullTableScan' THEN 0 ELSE 1 END AS id, CASE sql_id % 4 WHEN 0 THEN 'Fixed' WHEN 1 THEN 'Ignored' WHEN 2 THEN 'Reviewed' END AS new_status FROM issues WHERE issue_type IN ('FullTableScan', 'SortOperation'))
SELECT id, coalesce(new_status, 'Open') AS status, CASE WHEN new_status IN ('Fixed', 'Ignored') THEN '2024-01-01' END AS resolved_at, CASE WHEN new_status = 'Fixed' THEN 'dba' END AS resolved_by FROM n""")
def aud_update_status(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d).filter(F.col("issue_type").isin("FullTableScan", "SortOperation")).withColumn("id", F.col("sql_id") * 10 + F.when(F.col("issue_type") == "FullTableScan", 0).otherwise(1)).withColumn("resolved_at", F.lit(None).cast("string")).withColumn("resolved_by", F.lit(None).cast("string"))
    k = F.col("sql_id") % 4
    changes = i.filter(k != 3).select("id", F.when(k == 0, "Fixed").when(k == 1, "Ignored").otherwise("Reviewed").alias("new_status"), F.lit("dba").alias("changed_by"))
    return audit.update_status(i, changes, "2024-01-01").select("id", "status", "resolved_at", "resolved_by")


@query("aud.bulk_update", ISSUES + "SELECT sql_id AS id, TRUE AS ok, CAST(NULL AS VARCHAR) AS error FROM issues WHERE issue_type = 'SortOperation' UNION ALL SELECT -1, FALSE, 'issue not found'")
def aud_bulk_update(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d).filter("issue_type = 'SortOperation'").select(F.col("sql_id").alias("id"))
    changes = i.unionByName(s.createDataFrame([(-1,)], "id long")).withColumn("new_status", F.lit("Fixed"))
    return audit.bulk_result(i, changes).select("id", "ok", "error")


@query("agg.dashboard", TOP_REP.rstrip() + """, recent AS (SELECT id FROM reports ORDER BY snapshot_end DESC, id DESC LIMIT 10), per AS (SELECT report_id, sum(total_elapsed_time) AS e, sum(cpu_time) AS c, sum(io_time) AS i, count(*) AS n, count(*) FILTER (WHERE is_hot_sql) AS hot FROM top_sqls WHERE report_id IN (SELECT id FROM recent) GROUP BY 1)
SELECT count(*) AS reports, round(avg(c / e * 100), 4) AS avg_cpu_percent, round(avg(i / e * 100), 4) AS avg_io_percent, CAST(sum(n) AS BIGINT) AS statements, CAST(sum(hot) AS BIGINT) AS hot_statements FROM per""")
def agg_dashboard(s: SparkSession, d: str) -> DataFrame:
    return catalog.dashboard(load(s, d, "reports"), sqls(s, d))


query("dash.metrics", ORACLES["agg.dashboard"])(agg_dashboard)


@query("agg.trend", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1")
def agg_trend(s: SparkSession, d: str) -> DataFrame:
    return catalog.trend(load(s, d, "events"))


@query("agg.health_dist", REP + """, h AS (SELECT CASE WHEN count(*) FILTER (WHERE status = 'ImportFailed') > count(*) FILTER (WHERE status = 'SuccessfullyImported') THEN 'Critical' WHEN count(*) FILTER (WHERE status = 'ImportFailed') > 0 THEN 'Warning' ELSE 'Healthy' END AS status FROM reports GROUP BY instance_name)
SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM h), 4) AS percent FROM h GROUP BY 1""")
def agg_health_dist(s: SparkSession, d: str) -> DataFrame:
    return catalog.health_distribution(catalog.instance_summary(load(s, d, "reports")))


MERGE = ", parts AS (SELECT report_id, schema_name, object_name, 1 AS position, seq_scans, idx_scans, dead_tuples FROM object_stats UNION ALL SELECT report_id, schema_name, object_name, 2, seq_scans * 2, 0, dead_tuples + 1 FROM object_stats WHERE object_type = 'index')\n"
for _name in ("agg.object_merge", "src.object_stats_merge"):

    @query(_name, OBJ.rstrip() + MERGE + "SELECT report_id, schema_name, object_name, CAST(sum(seq_scans) AS BIGINT) AS seq_scans, CAST(sum(idx_scans) AS BIGINT) AS idx_scans, arg_max(dead_tuples, position) AS dead_tuples FROM parts GROUP BY 1, 2, 3")
    def agg_object_merge(s: SparkSession, d: str) -> DataFrame:
        o = load(s, d, "object_stats")
        # one object may be both a table and an index here: tables come first
        one = o.select("report_id", "schema_name", "object_name", F.lit(1).alias("position"), "seq_scans", "idx_scans", "dead_tuples")
        two = o.filter("object_type = 'index'").select("report_id", "schema_name", "object_name", F.lit(2).alias("position"), F.expr("seq_scans * 2").alias("seq_scans"), F.lit(0).cast("long").alias("idx_scans"), F.expr("dead_tuples + 1").alias("dead_tuples"))
        return catalog.merge_objects(one.unionByName(two))


@query("agg.schema_extract", TOP + "SELECT tbl AS table_name, 0 AS n_columns FROM top_sqls GROUP BY tbl")
def agg_schema_extract(s: SparkSession, d: str) -> DataFrame:
    t = sqls(s, d)
    out = catalog.schema_of_statements(t.select("sql_text"), t.select(F.col("tbl").alias("object_name")))
    return out.select("table_name", F.size("columns").alias("n_columns"))


# ---- ranking, sorting, limits


@query("win.rank_by_time", TOP + "SELECT id, row_number() OVER (PARTITION BY report_id ORDER BY id) AS rank FROM top_sqls")
def win_rank_by_time(s: SparkSession, d: str) -> DataFrame:
    return catalog.ranked(sqls(s, d), ["report_id"], [F.col("id")]).select("id", "rank")


CSV_SQL = TOP + "SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY rank_by_time, id) AS rank, sql_id, executions, total_elapsed_time, cpu_time, io_time, buffer_gets, disk_reads, rows_processed, sql_text FROM top_sqls"


@query("win.csv_rank", CSV_SQL)
def win_csv_rank(s: SparkSession, d: str) -> DataFrame:
    return store.export_csv(sqls(s, d))


@query("snk.export_csv", f"SELECT report_id, rank, concat(sql_id, ',', executions, ',', buffer_gets, ',', CASE WHEN contains(sql_text, ',') THEN concat('\"', sql_text, '\"') ELSE sql_text END) AS line FROM ({CSV_SQL})")
def snk_export_csv(s: SparkSession, d: str) -> DataFrame:
    return store.export_csv(sqls(s, d)).select("report_id", "rank", F.to_csv(F.struct("sql_id", "executions", "buffer_gets", "sql_text")).alias("line"))


def scratch(s: SparkSession) -> store.Store:
    """A new store in the session's shared folder."""
    return store.Store(s, f"{shared_folder(s)}/store-{uuid.uuid4()}")


#: The report that an object's statistics are filed under.
OBJECTS_OF = "((report_id % 5) * 10000 + 1992 + report_id % 7)"
#: What the writers of the thirteen relations get, in SQL that Spark and DuckDB both run, and a column to sum.
INSERTS = {
    "reports": ("SELECT id, instance_name, CAST(snapshot_start AS {STR}) AS snapshot_start, status FROM reports", "id"),
    "efficiency_metrics": ("SELECT report_id, floor(100 * sum(cpu_time) / sum(total_elapsed_time)) AS cpu_efficiency_percent FROM top_sqls GROUP BY report_id", "cpu_efficiency_percent"),
    "load_profile": ("SELECT report_id, CAST(sum(executions) AS BIGINT) AS total_transactions FROM top_sqls GROUP BY report_id", "total_transactions"),
    "database_stats": ("SELECT report_id, tbl AS db_name, CAST(sum(buffer_gets) AS BIGINT) AS blks_hit, CAST(sum(disk_reads) AS BIGINT) AS blks_read FROM top_sqls GROUP BY report_id, tbl", "blks_hit"),
    "top_sqls": ("SELECT id, report_id, sql_id, sql_text, executions, total_elapsed_time FROM top_sqls", "id"),
    "execution_plans": ("SELECT plan_id AS id, plan_id AS sql_id, operation AS plan_tree FROM plan_shapes WHERE node_id = 0", "sql_id"),
    "cache_io_stats": (f"SELECT {OBJECTS_OF} AS report_id, schema_name, object_name, object_type, seq_scans AS heap_blks_read, total_scans AS heap_blks_hit FROM object_stats", "heap_blks_read"),
    "object_stats": (f"SELECT {OBJECTS_OF} AS report_id, schema_name, object_name, object_type, total_scans, seq_scans, idx_scans, dead_tuples FROM object_stats", "dead_tuples"),
    "comparisons": ("SELECT a.id * 100000 + b.id AS id, a.id AS source_report_id, b.id AS target_report_id FROM reports a JOIN reports b ON b.id = a.id + 1", "target_report_id"),
    "sql_comparison_metrics": ("SELECT b.id, a.report_id AS comparison_id, a.id AS sql_id FROM top_sqls a JOIN top_sqls b ON b.report_id = a.report_id + 1 AND b.sql_id = a.sql_id", "sql_id"),
    "threshold_configs": ("SELECT 'SQL' AS category, tbl AS config_key, max(total_elapsed_time) AS value FROM top_sqls GROUP BY tbl", "value"),
    "sql_audit_issues": ("SELECT id, report_id, id AS sql_id, 'FullTableScan' AS issue_type FROM top_sqls WHERE rows_processed > 10000", "sql_id"),
    "audit_logs": ("SELECT event_id AS id, event_type AS action FROM events", "id"),
}
INSERT_VIEWS = ("reports", "top_sqls", "object_stats", "plan_shapes")


def filled(s: SparkSession, d: str, *tables: str) -> store.Store:
    """A store that holds the thirteen relations, or those named, written as one batch."""
    wanted = [sql for table, (sql, _) in INSERTS.items() if not tables or table in tables]
    # a view that several relations are made of is computed once
    views = {n: load(s, d, n) if n == "events" else written(load(s, d, n)) for n in (*INSERT_VIEWS, "events") if any(re.search(rf"\b(FROM|JOIN) {n}\b", sql) for sql in wanted)}
    kept = scratch(s)
    named = lambda sql: s.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql.replace("{STR}", "STRING")), **{n: v for n, v in views.items() if re.search(rf"\b(FROM|JOIN) {n}\b", sql)})
    kept.batch("all", {table: named(sql) for table, (sql, _) in INSERTS.items() if not tables or table in tables})
    return kept


@query("snk.insert", ctes(*INSERT_VIEWS) + " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n, CAST(floor(coalesce(sum({c}), 0)) AS BIGINT) AS total FROM ({sql.replace('{STR}', 'VARCHAR')})" for t, (sql, c) in INSERTS.items()))
def snk_insert(s: SparkSession, d: str) -> DataFrame:
    kept = filled(s, d)
    parts = [kept.read(t).agg(F.count(F.lit(1)).alias("n"), F.floor(F.coalesce(F.sum(c), F.lit(0))).cast("long").alias("total")).select(F.lit(t).alias("relation"), "n", "total") for t, (_, c) in INSERTS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("snk.import_report", ctes("reports", "top_sqls") + "SELECT r.id AS report_id, 'inst' AS instance_name, CAST(r.snapshot_start AS VARCHAR) AS snapshot_start, least(count(*), 200) AS statements, min(t.sql_id) FILTER (WHERE t.rank_by_time = 1) AS first_sql FROM reports r JOIN top_sqls t ON t.report_id = r.id GROUP BY ALL")
def snk_import_report(s: SparkSession, d: str) -> DataFrame:
    from tidemark.queries.shredding import whole_pages

    kept = scratch(s)
    files = written(whole_pages(s, d)).select("report_id", "part", F.concat(F.lit("r"), F.col("report_id").cast("string"), F.lit(".html")).alias("file_path"), F.octet_length("html").cast("long").alias("file_size"), "html")
    kept.import_reports(files, "inst", "2024-01-01")
    kept.import_reports(files, "inst", "2024-01-02")  # known reports are passed over
    t = kept.read("top_sqls").groupBy("report_id").agg(F.count(F.lit(1)).alias("statements"), F.min(F.when(F.col("rank_by_time") == 1, F.col("sql_id"))).alias("first_sql"))
    return kept.read("reports").select(F.col("id").alias("report_id"), "instance_name", "snapshot_start").join(t, "report_id")


@query("cmp.create", f"SELECT source_report_id, target_report_id, true AS success, concat('Comparison created successfully with ', n_findings, ' key findings') AS message FROM ({SUMMARY_SQL}) UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1995 AS BIGINT), false, 'Source report not found: -1' UNION ALL SELECT CAST(1995 AS BIGINT), CAST(-2 AS BIGINT), false, 'Target report not found: -2'")
def cmp_create(s: SparkSession, d: str) -> DataFrame:
    reports = load(s, d, "reports")
    wrong = s.createDataFrame([(-1, 1995), (1995, -2)], "source_report_id long, target_report_id long")
    m = metrics(s, d)
    pairs = m.select("source_report_id", "target_report_id").distinct().unionByName(wrong)
    return scratch(s).create_comparison(pairs, m, reports, "2024-01-01")


LIST_SQL = REP.rstrip() + """, c AS (SELECT id, CAST(id AS VARCHAR) AS a, instance_name AS b, CAST(snapshot_start AS VARCHAR) AS x, CAST(snapshot_end AS VARCHAR) AS y, status AS z FROM reports)
, w AS (SELECT greatest(2, max(length(a))) AS wa, greatest(8, max(length(b))) AS wb, greatest(14, max(length(x))) AS wx, greatest(12, max(length(y))) AS wy, greatest(6, max(length(z))) AS wz FROM c)
, l AS (SELECT 1 AS k, NULL AS id, 'ID' AS a, 'Instance' AS b, 'Snapshot Start' AS x, 'Snapshot End' AS y, 'Status' AS z UNION ALL SELECT 2, NULL, repeat('-', wa), repeat('-', wb), repeat('-', wx), repeat('-', wy), repeat('-', wz) FROM w UNION ALL SELECT 3, * FROM c)
SELECT row_number() OVER (ORDER BY k, id) AS position, concat(rpad(a, CAST(wa AS INTEGER), ' '), '  ', rpad(b, CAST(wb AS INTEGER), ' '), '  ', rpad(x, CAST(wx AS INTEGER), ' '), '  ', rpad(y, CAST(wy AS INTEGER), ' '), '  ', rpad(z, CAST(wz AS INTEGER), ' ')) AS line FROM l, w"""


@query("cli.list", LIST_SQL)
def cli_list(s: SparkSession, d: str) -> DataFrame:
    return facade.list_reports(load(s, d, "reports"))


@query("snk.text_table", TOP.rstrip() + """, c AS (SELECT id, CAST(id AS VARCHAR) AS a, CAST(executions AS VARCHAR) AS b FROM top_sqls), w AS (SELECT greatest(2, max(length(a))) AS wa, greatest(5, max(length(b))) AS wb FROM c)
, l AS (SELECT 1 AS k, NULL AS id, 'ID' AS a, 'Calls' AS b UNION ALL SELECT 2, NULL, repeat('-', wa), repeat('-', wb) FROM w UNION ALL SELECT 3, * FROM c)
SELECT row_number() OVER (ORDER BY k, id) AS position, concat(rpad(a, CAST(wa AS INTEGER), ' '), '  ', rpad(b, CAST(wb AS INTEGER), ' ')) AS line FROM l, w""")
def snk_text_table(s: SparkSession, d: str) -> DataFrame:
    return facade.text_table(sqls(s, d), {"id": "ID", "executions": "Calls"}, [F.col("id")])


@query("cli.analyze", TOP_REP.rstrip() + """, l AS (SELECT report_id, string_agg(concat('  #', rank_by_time, '  SQL ID: ', sql_id, '   Elapsed: ', CAST(round(total_elapsed_time) AS BIGINT), 'ms  CPU: ', CAST(round(cpu_time) AS BIGINT), 'ms  Execs: ', executions, chr(10), '      ', CASE WHEN length(sql_text) > 80 THEN concat(substr(sql_text, 1, 80), '...') ELSE sql_text END), chr(10) ORDER BY rank_by_time) AS lines FROM top_sqls GROUP BY 1)
SELECT r.id, md5(concat('=== Report #', r.id, ': ', instance_name, ' ===', chr(10), 'Snapshot: ', snapshot_start, '  ->  ', snapshot_end, chr(10), 'Status: ', status, chr(10), chr(10), CASE WHEN lines IS NULL THEN concat('--- Top SQL ---', chr(10), '  (none)') ELSE concat('--- Top SQL (by elapsed time) ---', chr(10), lines) END)) AS text_md5 FROM reports r LEFT JOIN l ON l.report_id = r.id""")
def cli_analyze(s: SparkSession, d: str) -> DataFrame:
    return facade.analyze(load(s, d, "reports"), sqls(s, d)).select("id", F.md5("text").alias("text_md5"))


@query("win.latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def win_latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return catalog.latest_per_key(load(s, d, "events"), "user_id", "event_id", ["event_type", "value"])


@query("srt.page", REP + "SELECT id, instance_name, snapshot_end FROM reports ORDER BY snapshot_end DESC, id LIMIT 10 OFFSET 5")
def srt_page(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(load(s, d, "reports").select("id", "instance_name", "snapshot_end"), [F.desc("snapshot_end"), F.col("id")], 10, 5)


query("rep.list", REP + "SELECT id, instance_name, snapshot_end FROM reports ORDER BY snapshot_end DESC, id LIMIT 10 OFFSET 5")(srt_page)


@query("srt.whitelist", REP + "SELECT id, status FROM reports ORDER BY status, id LIMIT 12")
def srt_whitelist(s: SparkSession, d: str) -> DataFrame:
    return catalog.sorted_page(load(s, d, "reports").select("id", "status"), "status", "ASC", 12)


@query("srt.topk_recent", REP + "SELECT id, snapshot_end FROM reports ORDER BY snapshot_end DESC, id DESC LIMIT 10")
def srt_topk_recent(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(load(s, d, "reports").select("id", "snapshot_end"), [F.desc("snapshot_end"), F.desc("id")], 10)


@query("lim.recent3", REP + "SELECT id FROM reports ORDER BY snapshot_end DESC, id DESC LIMIT 3")
def lim_recent3(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(load(s, d, "reports").select("id", "snapshot_end"), [F.desc("snapshot_end"), F.desc("id")], 3).select("id")


for _order, _col in (("elapsed", "total_elapsed_time"), ("cpu_time", "cpu_time"), ("executions", "executions")):
    query({"elapsed": "srt.hot_sql"}.get(_order, f"srt.hot_sql_{_order}"), TOP + f"SELECT id, {_col} FROM top_sqls WHERE is_hot_sql ORDER BY {_col} DESC, id LIMIT 50")(lambda s, d, o=_order, c=_col: catalog.hot_sql(sqls(s, d), o).select("id", c))


@query("rep.hot", TOP + "SELECT id, cpu_time FROM top_sqls WHERE is_hot_sql AND report_id = 1995 ORDER BY cpu_time DESC, id LIMIT 100")
def rep_hot(s: SparkSession, d: str) -> DataFrame:
    return catalog.hot_sql(sqls(s, d), "cpu_time", 500, 1995).select("id", "cpu_time")


@query("srt.generic", TOP + "SELECT id, lower(sql_text) AS k FROM top_sqls ORDER BY lower(sql_text) DESC NULLS LAST, id LIMIT 40")
def srt_generic(s: SparkSession, d: str) -> DataFrame:
    return catalog.sort_any(sqls(s, d).select("id", "sql_text"), "sql_text", False).limit(40).select("id", F.lower("sql_text").alias("k"))


@query("srt.report_sql", TOP + "SELECT id, executions FROM top_sqls WHERE report_id = 1995 ORDER BY executions DESC, id LIMIT 1000")
def srt_report_sql(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(sqls(s, d).filter("report_id = 1995").select("id", "executions"), [F.desc("executions"), F.col("id")], 1000)


@query("srt.threshold", f"SELECT category, config_key FROM {CFG} ORDER BY 1, 2")
def srt_threshold(s: SparkSession, d: str) -> DataFrame:
    return schemas.thresholds(s).select("category", "config_key").orderBy("category", "config_key")


@query("lim.parse_cap", TOP + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY report_id ORDER BY rank_by_time, id) AS n FROM top_sqls) WHERE n <= 200")
def lim_parse_cap(s: SparkSession, d: str) -> DataFrame:
    return catalog.first_n(sqls(s, d).select("id", "report_id", "rank_by_time"), ["report_id"], [F.col("rank_by_time"), F.col("id")], 200).select("id")


@query("lim.slice", TOP + "SELECT id FROM top_sqls ORDER BY id LIMIT 20 OFFSET 40")
def lim_slice(s: SparkSession, d: str) -> DataFrame:
    return catalog.page(sqls(s, d).select("id"), [F.col("id")], 20, 40)


@query("lim.history", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NULL OR event_type IS DISTINCT FROM was) WHERE n <= 30")
def lim_history(s: SparkSession, d: str) -> DataFrame:
    return catalog.keep_changes(load(s, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type", 30).select("event_id", "user_id", "event_type")


# ---- sets


@query("set.union_objects", OBJ + "SELECT object_name, 'table' AS kind FROM object_stats WHERE object_type = 'table' UNION ALL SELECT object_name, 'index' FROM object_stats WHERE object_type = 'index'")
def set_union_objects(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "object_stats")
    pick = lambda k: o.filter(F.col("object_type") == k).select("object_name", F.lit(k).alias("kind"))
    return pick("table").unionByName(pick("index"))


@query("set.risk_diff", ISSUES + """, a AS (SELECT DISTINCT sql_id % 100000 AS k, issue_type FROM issues WHERE report_id = 1995), b AS (SELECT DISTINCT sql_id % 100000 AS k, issue_type FROM issues WHERE report_id = 1996)
SELECT k, issue_type, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'persisting' WHEN b.k IS NOT NULL THEN 'new' ELSE 'resolved' END AS state FROM a FULL JOIN b USING (k, issue_type)""".replace("a.k IS NOT NULL AND b.k IS NOT NULL", "x = 1 AND y = 1").replace("WHEN b.k IS NOT NULL", "WHEN y = 1").replace("a AS (SELECT DISTINCT", "a AS (SELECT DISTINCT 1 AS x,").replace("b AS (SELECT DISTINCT", "b AS (SELECT DISTINCT 1 AS y,"))
def set_risk_diff(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d).withColumn("k", F.col("sql_id") % 100000)
    return catalog.set_difference(i.filter("report_id = 1995"), i.filter("report_id = 1996"), ["k", "issue_type"])


@query("set.dedup_consecutive", TOP + "SELECT id, (1 + p_size % 5) // 2 + 1 AS n FROM top_sqls")
def set_dedup_consecutive(s: SparkSession, d: str) -> DataFrame:
    runs = F.expr("transform(sequence(1, 1 + int(p_size % 5)), x -> string(x div 2))")
    return sqls(s, d).select("id", F.size(fn.dedup_consecutive(runs)).cast("long").alias("n"))


# ---- scalars over statements


def scalar(name: str, sql: str, make: Column, column: str = "x", source: str = "top_sqls") -> None:
    """A query id -> value over the statements."""
    query(name, ctes(source) + f"SELECT id, {sql} AS {column} FROM {source}")(lambda s, d: load(s, d, source).select("id", make().alias(column)))


scalar("fn.fingerprint", FP, lambda: fn.fingerprint("sql_text"))
scalar("fn.num_commas", "CAST(buffer_gets AS DOUBLE)", lambda: fn.num_commas(F.format_number("buffer_gets", 0)))
scalar("fn.num_pct", "round(CAST(disk_reads AS DOUBLE), 1)", lambda: fn.num_pct(F.concat(F.format_number("disk_reads", 1), F.lit("%"))))
scalar("fn.num_range", "CAST(disk_reads AS DOUBLE)", lambda: fn.num_range(F.concat(F.lit("[1.5,"), F.col("disk_reads").cast("string"), F.lit("]"))))
scalar("fn.pct_change", "CASE WHEN total_elapsed_time <> 0 THEN (cpu_time - total_elapsed_time) / total_elapsed_time * 100 END", lambda: fn.pct_change("total_elapsed_time", "cpu_time"))
scalar("fn.metric_card", "CASE WHEN io_time > 0 THEN (cpu_time - io_time) / io_time * 100 ELSE 0 END", lambda: fn.metric_card_percent("io_time", "cpu_time"))
scalar("fn.avg_time", "CASE WHEN executions > 0 THEN total_elapsed_time / executions ELSE 0 END", lambda: fn.avg_time("total_elapsed_time", "executions"))
scalar("fn.gauge_target", "CASE WHEN rank_by_time >= 50 THEN 'healthy' WHEN rank_by_time >= 45 THEN 'warning' ELSE 'bad' END", lambda: fn.gauge_target("rank_by_time", F.lit(50)))
scalar("fn.gauge_fixed", "CASE WHEN rank_by_time >= 90 THEN 'good' WHEN rank_by_time >= 70 THEN 'warn' ELSE 'bad' END", lambda: fn.gauge_fixed("rank_by_time"))
scalar("fn.plan_score", "greatest(0, least(100, 100 - (rank_by_time % 30) * 5))", lambda: fn.plan_score(F.col("rank_by_time") % 30).cast("long"))
scalar("fn.plan_potential", "CASE WHEN rank_by_time % 100 >= 80 THEN 'Low - Minor optimizations may be available' WHEN rank_by_time % 100 >= 50 THEN 'Medium - Some optimization opportunities possible' ELSE 'High - Multiple optimization areas identified (requires execution plan for accuracy)' END", lambda: fn.plan_potential(F.col("rank_by_time") % 100))
scalar("fn.strip_explain", "trim(sql_text)", lambda: fn.strip_explain(F.concat(F.lit("EXPLAIN (FORMAT JSON) "), "sql_text", F.lit(";"))))
scalar("fn.make_explain", "concat('EXPLAIN (FORMAT JSON) ', trim(sql_text))", lambda: fn.make_explain("sql_text"))
scalar("fn.table_names", "CASE WHEN p_partkey % 6 IN (0, 1, 2, 5) THEN tbl ELSE '' END", lambda: F.array_join(fn.table_names("sql_text"), ","))
scalar("fn.validate_sql", "CASE WHEN p_partkey % 2 = 0 THEN 'unbalanced parentheses' END", lambda: fn.validate_sql(F.when(F.col("p_partkey") % 2 == 0, F.concat("sql_text", F.lit(" (("))).otherwise(F.col("sql_text"))))
scalar("fn.hints", "'hintLeading,hintRows'", lambda: F.array_join(fn.hints(F.concat(F.lit("/*+ Leading(a b) rows(a b #10) */ "), "sql_text")), ","))
scalar("fn.detect_sqlplan", "starts_with(upper(sql_text), 'SELECT') OR starts_with(upper(sql_text), 'UPDATE') OR starts_with(upper(sql_text), 'INSERT') OR starts_with(upper(sql_text), 'DELETE')", lambda: fn.detect_sql_with_plan(F.concat("sql_text", F.lit("\nSeq Scan on t  (cost=0.00..1.00 rows=1 width=1)"))))
scalar("fn.checksum", "sha256(concat('{\"id\":', id, '}'))", lambda: fn.checksum(F.col("id")))
scalar("fn.csv_escape", "CASE WHEN contains(sql_text, ',') THEN concat('\"', sql_text, '\"') ELSE sql_text END", lambda: fn.csv_field("sql_text"))
scalar("fn.progress", "CAST(rank_by_time AS DOUBLE) / 400 * 100", lambda: fn.progress_percent("rank_by_time", F.lit(400)))
scalar("fn.hypo_index", "total_elapsed_time * CAST(0.65 AS DOUBLE)", lambda: fn.hypothetical_index("total_elapsed_time", "rows_processed")["estimated_cost"])
scalar("fn.parse_status", "CASE WHEN status = 'ImportFailed' THEN 'disk full' END", lambda: fn.failure_message(F.when(F.col("status") == "ImportFailed", F.lit("ImportFailed(disk full)")).otherwise(F.col("status"))), source="reports")
scalar("fn.duration_s", "CAST(greatest(epoch(CAST(snapshot_end AS TIMESTAMP)) - epoch(CAST(snapshot_start AS TIMESTAMP)), 1) AS DOUBLE)", lambda: fn.duration_s("snapshot_start", "snapshot_end"), source="reports")
scalar("fn.conclusion", "concat('Performance remained stable with ', id, ' notable changes')", lambda: fn.conclusion(F.lit(3), "id"), source="reports")


@query("fn.plan_improvement", TOP + "SELECT id, CASE WHEN rank_by_time % 100 < 50 THEN 15 + CAST(floor((80 - rank_by_time % 100) / 3.0) AS BIGINT) WHEN rank_by_time % 100 < 80 THEN 5 + CAST(floor((80 - rank_by_time % 100) / 4.0) AS BIGINT) END AS x FROM top_sqls")
def fn_plan_improvement(s: SparkSession, d: str) -> DataFrame:
    return sqls(s, d).select("id", fn.plan_improvement(F.col("rank_by_time") % 100).alias("x"))


@query("fn.wait_desc", WAIT + "SELECT DISTINCT event, CAST(NULL AS VARCHAR) AS x FROM wait_events")
def fn_wait_desc(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "wait_events").select("event", fn.wait_description("event").alias("x")).distinct()


# ---- thresholds

CHANGES = (("sys_cpu_usage", 59.0, "dba", "a long enough reason"), ("sys_memory_usage", 96.0, "dba", "a long enough reason"), ("sql_scan_rows", 100000.5, "dba", "a long enough reason"), ("ai_confidence", 0.9, "dba", "too short"), ("no_such_key", 1.0, "dba", "a long enough reason"), ("sql_top_time", 2000.0, "dba", "a long enough reason"), ("wait_max_io", 2000.0, "", "a long enough reason"))
ERRORS = {"sys_cpu_usage": "value is below the minimum", "sys_memory_usage": "value is above the maximum", "sql_scan_rows": "value must be an integer", "ai_confidence": "reason is too short", "no_such_key": "unknown key", "sql_top_time": None, "wait_max_io": "changed_by is empty"}
JUDGED = values(tuple((k, v, ERRORS[k]) for k, v, _, _ in CHANGES), "config_key, new_value, error")


def judged(s: SparkSession) -> DataFrame:
    return thresholds.judge(schemas.thresholds(s), s.createDataFrame(list(CHANGES), "config_key string, new_value double, changed_by string, reason string"))


for _name in ("thr.validate", "fn.bounds_check", "fn.type_check", "fn.dto_check"):
    query(_name, f"SELECT config_key, CAST(new_value AS DOUBLE) AS new_value, error FROM {JUDGED}")(lambda s, d: judged(s).select("config_key", "new_value", "error"))


@query("agg.batch_result", f"SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS succeeded, count(error) AS failed FROM {JUDGED}")
def agg_batch_result(s: SparkSession, d: str) -> DataFrame:
    return thresholds.batch_result(judged(s))


query("thr.batch", f"SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS succeeded, count(error) AS failed FROM {JUDGED}")(agg_batch_result)


@query("thr.get", f"SELECT {CFG_COLS} FROM {CFG} WHERE config_key = 'ai_confidence'")
def thr_get(s: SparkSession, d: str) -> DataFrame:
    return catalog.by_value(schemas.thresholds(s), "config_key", "ai_confidence")


@query("thr.list", f"SELECT {CFG_COLS} FROM {CFG} ORDER BY category, config_key")
def thr_list(s: SparkSession, d: str) -> DataFrame:
    return schemas.thresholds(s).orderBy("category", "config_key")


for _name in ("thr.update", "snk.update_threshold"):

    @query(_name, f"SELECT config_key, CASE WHEN config_key = 'sql_top_time' THEN 2000.0 ELSE CAST(value AS DOUBLE) END AS value FROM {CFG}")
    def thr_update(s: SparkSession, d: str) -> DataFrame:
        return thresholds.current(schemas.thresholds(s), thresholds.accepted(judged(s), "2024-01-01", 1)).select("config_key", "value")


@query("thr.reset", f"SELECT config_key, CAST(default_value AS DOUBLE) AS new_value FROM {CFG}")
def thr_reset(s: SparkSession, d: str) -> DataFrame:
    return thresholds.reset(schemas.thresholds(s))


TPL = values(schemas.TEMPLATES, "template, config_key, value")


@query("thr.templates", f"SELECT template, config_key, CAST(value AS DOUBLE) AS value FROM {TPL}")
def thr_templates(s: SparkSession, d: str) -> DataFrame:
    return schemas.templates(s)


@query("thr.apply", f"SELECT t.config_key, CAST(t.value AS DOUBLE) AS value, CAST(c.value AS DOUBLE) AS old_value, c.value IS NOT NULL AS matched FROM (SELECT * FROM {TPL}) t LEFT JOIN (SELECT * FROM {CFG}) c ON c.config_key = t.config_key WHERE t.template = 'Development'")
def thr_apply(s: SparkSession, d: str) -> DataFrame:
    return thresholds.apply_template(schemas.templates(s), schemas.thresholds(s), "Development")


LOG = "SELECT event_id AS seq, CAST(ts AS VARCHAR) AS at, concat('key', user_id % 5) AS config_key, CASE event_type WHEN 'click' THEN 'Update' WHEN 'purchase' THEN 'Reset' ELSE 'View' END AS action FROM events"
for _name in ("thr.history", "flt.threshold_history"):

    @query(_name, f"SELECT seq, config_key, action FROM ({LOG}) WHERE action IN ('Update', 'Reset') AND config_key = 'key3' ORDER BY seq DESC LIMIT 100")
    def thr_history(s: SparkSession, d: str) -> DataFrame:
        e = load(s, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("key"), (F.col("user_id") % 5).cast("string")).alias("config_key"), F.when(F.col("event_type") == "click", "Update").when(F.col("event_type") == "purchase", "Reset").otherwise("View").alias("action"))
        return thresholds.history(e, "key3")


LOGGED = "SELECT event_id AS id, CAST(ts AS {STR}) AS timestamp, concat('user', user_id) AS user_id, event_type AS action, 'Event' AS entity_type, CAST(event_id AS {STR}) AS entity_id, event_type <> 'error' AS success FROM "


@query("log.audit", f"SELECT id, timestamp, user_id, action, success FROM ({LOGGED.replace('{STR}', 'VARCHAR')} events) ORDER BY timestamp DESC, id DESC LIMIT 50")
def log_audit(s: SparkSession, d: str) -> DataFrame:
    kept = scratch(s)
    kept.log_rows(s.sql(LOGGED.replace("{STR}", "STRING") + "{events}", events=load(s, d, "events")))
    return kept.logged(50).select("id", "timestamp", "user_id", "action", "success")


# ---- risks, export, integrity, generic comparison


@query("risk.report", OBJ + "SELECT report_id, 'error' AS level, 'dead_tuples' AS risk, min(object_name) AS object_name, count(*) AS n FROM object_stats WHERE dead_tuples > 10000 GROUP BY report_id UNION ALL SELECT s_nationkey, 'warning', 'buffer_hit', NULL, 1 FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0)")
def risk_report(s: SparkSession, d: str) -> DataFrame:
    eff = load(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("report_id"), F.when(F.col("s_nationkey") % 3 == 0, 90.0).otherwise(99.0).alias("buffer_hit_percent")).distinct()
    return catalog.report_risks(eff, load(s, d, "object_stats").withColumn("report_id", F.col("report_id").cast("long")))


@query("risk.dead_highlight", OBJ + "SELECT report_id, object_name, object_type, dead_tuples > 1000 AS flag FROM object_stats")
def risk_dead_highlight(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "object_stats").select("report_id", "object_name", "object_type", (F.col("dead_tuples") > 1000).alias("flag"))


@query("cmp.category_models", WAIT.rstrip() + ", e AS (SELECT event, report_id % 10000 AS y, sum(waits) AS waits FROM wait_events GROUP BY 1, 2), a AS (SELECT event, waits FROM e WHERE y = (SELECT min(y) FROM e)), b AS (SELECT event, waits FROM e WHERE y = (SELECT max(y) FROM e)) SELECT event, 'waits' AS measure, CAST(coalesce(a.waits, 0) AS DOUBLE) AS value1, CAST(coalesce(b.waits, 0) AS DOUBLE) AS value2, CAST(coalesce(b.waits, 0) - coalesce(a.waits, 0) AS DOUBLE) AS diff, round((b.waits - a.waits) / CAST(a.waits AS DOUBLE) * 100, 4) AS change_rate FROM a FULL JOIN b USING (event)")
def cmp_category_models(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "wait_events").groupBy("event", (F.col("report_id") % 10000).alias("y")).agg(F.sum("waits").alias("waits"))
    ends = e.agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda c: e.join(ends, e["y"] == ends[c]).select("event", "waits")
    return compare.compare(side("y0"), side("y1"), ["event"], ["waits"]).withColumn("change_rate", F.round("change_rate", 4))


@query("snk.manifest", TOP + "SELECT '1.0' AS version, '2024-01-01' AS export_date, 'Report' AS export_type, count(*) AS item_count FROM top_sqls")
def snk_manifest(s: SparkSession, d: str) -> DataFrame:
    return store.manifest(sqls(s, d), "Report", "2024-01-01")


@query("snk.export_json", TOP_REP + "SELECT r.id, count(t.id) AS n FROM reports r LEFT JOIN top_sqls t ON t.report_id = r.id GROUP BY r.id")
def snk_export_json(s: SparkSession, d: str) -> DataFrame:
    doc = store.export_json(load(s, d, "reports").withColumn("snapshot_start", F.col("snapshot_start").cast("string")).withColumn("snapshot_end", F.col("snapshot_end").cast("string")), sqls(s, d), "2024-01-01")
    return doc.select("id", F.get_json_object("document", "$.manifest.item_count").cast("long").alias("n"))


@query("snk.export_json_cli", ctes(*INSERT_VIEWS) + "SELECT r.id, r.instance_name, r.status, (SELECT count(*) FROM top_sqls t WHERE t.report_id = r.id) AS n_sqls, (SELECT CAST(sum(id) AS BIGINT) FROM top_sqls t WHERE t.report_id = r.id) AS sql_ids, (SELECT count(DISTINCT tbl) FROM top_sqls t WHERE t.report_id = r.id) AS n_databases, (SELECT count(*) FROM object_stats o WHERE " + OBJECTS_OF.replace("report_id", "o.report_id") + " = r.id) AS n_objects, (SELECT CAST(sum(executions) AS BIGINT) FROM top_sqls t WHERE t.report_id = r.id) AS transactions, (SELECT floor(100 * sum(cpu_time) / sum(total_elapsed_time)) FROM top_sqls t WHERE t.report_id = r.id) AS cpu FROM reports r")
def snk_export_json_cli(s: SparkSession, d: str) -> DataFrame:
    # a document has all statements and objects of a report, so it is read in the pieces in which it is written
    pieces = written(filled(s, d, "reports", *store.DOCUMENT).document_pieces())
    get = lambda path, kind: F.variant_get("v", f"$.{path}", kind)
    in_list = lambda name: F.col("section") == store.LIST_SECTIONS[name]
    cut = len(f',"{store.DOCUMENT[2]}":[')
    head = pieces.filter("section = 0").select("id", F.parse_json(F.concat(F.col("text").substr(F.lit(1), F.length("text") - cut), F.lit("}"))).alias("v"))
    item = pieces.filter("section % 2 = 1").select("id", "section", F.parse_json(F.regexp_replace("text", "^,", "")).alias("v"))
    n = lambda name: F.count_if(in_list(name)).alias(f"n_{name}")
    lists = item.groupBy("id").agg(n("top_sqls"), F.sum(F.when(in_list("top_sqls"), get("id", "long"))).alias("sql_ids"), n("database_stats"), n("object_stats"))
    many = lambda name: F.coalesce(f"n_{name}", F.lit(0)).cast("long")
    return head.join(lists, "id", "left").select("id", get("report.instance_name", "string").alias("instance_name"), get("report.status", "string").alias("status"), many("top_sqls").alias("n_sqls"), "sql_ids", many("database_stats").alias("n_databases"), many("object_stats").alias("n_objects"), get("load_profile.total_transactions", "long").alias("transactions"), get("efficiency_metrics.cpu_efficiency_percent", "double").alias("cpu"))


@query("snk.export_comparison", SUMMARY_SQL.replace("SELECT c.source_report_id, c.target_report_id, c.common, c.score,", "SELECT c.source_report_id, c.target_report_id, c.common, c.score, CAST(c.score AS VARCHAR) AS doc_score,", 1).replace("FROM scored c LEFT JOIN nf", "FROM scored c LEFT JOIN nf", 1))
def snk_export_comparison(s: SparkSession, d: str) -> DataFrame:
    out = cmp_run(s, d)
    doc = F.to_json(F.struct(*out.columns))
    return out.withColumn("doc_score", F.get_json_object(doc, "$.score"))


@query("src.json_import", "SELECT event_id AS document_id, event_id % 3 = 0 AS ok, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'manifest is missing' ELSE 'not JSON' END AS error FROM events")
def src_json_import(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    docs = load(s, d, "events").select(F.col("event_id").alias("document_id"), F.when(k == 0, F.lit('{"manifest": {"version": "1.0"}, "report": {}}')).when(k == 1, F.lit('{"report": {}}')).otherwise(F.lit("{broken")).alias("document"))
    return store.check_import(docs)


@query("int.import", REP + "SELECT id, CASE WHEN id % 2 = 0 THEN 'stored' ELSE 'imported' END AS origin FROM reports")
def int_import(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "reports").select("id")
    return store.import_rows(r.withColumn("origin", F.lit("imported")), r.filter("id % 2 = 0").withColumn("origin", F.lit("stored")), "id")


_TEXT = "md5(length(CAST(id AS VARCHAR)) || ':' || id || length(sql_text) || ':' || sql_text)"
_HALF = "CAST(sum(CAST(CAST('0x' || substr(h, {}, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)"


@query("int.check", TOP.rstrip() + f", x AS (SELECT id, {_TEXT} AS h FROM top_sqls UNION ALL SELECT id, {_TEXT} FROM top_sqls WHERE id % 3 = 0)\nSELECT count(*) AS record_count, count(DISTINCT id) AS distinct_keys, {_HALF.format(1)} || '-' || {_HALF.format(17)} AS checksum FROM x")
def int_check(s: SparkSession, d: str) -> DataFrame:
    t = sqls(s, d).select("id", "sql_text")
    return store.integrity(t.unionByName(t.filter("id % 3 = 0")), "id")


@query("rep.detail", ctes("reports", "top_sqls", "object_stats") + "SELECT r.id, r.instance_name, (SELECT count(*) FROM top_sqls t WHERE t.report_id = r.id) AS statements, (SELECT CAST(sum(executions) AS BIGINT) FROM top_sqls t WHERE t.report_id = r.id) AS executions, (SELECT count(*) FROM object_stats o WHERE " + OBJECTS_OF.replace("report_id", "o.report_id") + " = r.id) AS objects, (SELECT count(DISTINCT tbl) FROM top_sqls t WHERE t.report_id = r.id) AS databases, (SELECT CAST(sum(executions) AS BIGINT) FROM top_sqls t WHERE t.report_id = r.id) AS transactions FROM reports r")
def rep_detail(s: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    runs = F.aggregate("top_sqls.executions", F.lit(0).cast("long"), lambda a, x: a + x)
    return filled(s, d, "reports", *store.DOCUMENT).details().select("id", "instance_name", n("top_sqls").alias("statements"), runs.alias("executions"), n("object_stats").alias("objects"), n("database_stats").alias("databases"), F.col("load_profile.total_transactions").alias("transactions"))


def left(kept: store.Store, keys: dict[str, str]) -> DataFrame:
    """relation, key and number of rows of relations, by the column that keys names."""
    return reduce(DataFrame.unionByName, [kept.read(t).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("relation"), "key", "n") for t, c in keys.items()])


@query("rep.delete", ctes("reports", "top_sqls") + "SELECT 'reports' AS relation, id AS key, count(*) AS n FROM reports WHERE status <> 'ImportFailed' GROUP BY 2 UNION ALL SELECT 'top_sqls', report_id, count(*) FROM top_sqls WHERE report_id IN (SELECT id FROM reports WHERE status <> 'ImportFailed') GROUP BY 2 UNION ALL SELECT 'load_profile', id, 1 FROM reports WHERE status <> 'ImportFailed'")
def rep_delete(s: SparkSession, d: str) -> DataFrame:
    kept = filled(s, d, "reports", "top_sqls", "load_profile")
    kept.delete("report", kept.read("reports").filter("status = 'ImportFailed'").select("id"))
    return left(kept, {"reports": "id", "top_sqls": "report_id", "load_profile": "report_id"})


@query("snk.delete", ctes("reports", "plan_shapes") + "SELECT 'comparisons' AS relation, a.id AS key, count(*) AS n FROM reports a JOIN reports b ON b.id = a.id + 1 WHERE a.id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'execution_plans', plan_id, 1 FROM plan_shapes WHERE node_id = 0 AND plan_id % 3 <> 0")
def snk_delete(s: SparkSession, d: str) -> DataFrame:
    """Comparisons and plans deleted, the rest rewritten as one batch, and what it replaced cleaned away."""
    kept = filled(s, d, "comparisons", "sql_comparison_metrics", "execution_plans")
    kept.delete("comparison", kept.read("comparisons").filter("source_report_id % 2 = 1").select("id"))
    kept.delete("plan", kept.read("execution_plans").filter("id % 3 = 0").select("id"))
    kept.compact()
    kept.clean()
    return left(kept, {"comparisons": "source_report_id", "execution_plans": "id"})


RW = values(schemas.REWRITES, "id, category, safety_level, description, default_enabled")


@query("rw.rules", f"SELECT id, category, safety_level, description, default_enabled FROM {RW}")
def rw_rules(s: SparkSession, d: str) -> DataFrame:
    return schemas.rewrites(s)
