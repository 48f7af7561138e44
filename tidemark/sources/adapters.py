"""Report-shaped views over star-schema tables, in SQL that Spark and DuckDB both run.

A view names what it reads in braces; Spark gets DataFrames there, DuckDB the names of tables and CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "v_base": """SELECT CAST(r.r_regionkey AS BIGINT) * 10000 + CAST(year(o.o_orderdate) AS BIGINT) AS report_id, r.r_name AS instance_name,
 o.o_orderdate, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # the reports of v_base, without joining its parts or every line of an order
    "reports": """SELECT report_id AS id, instance_name, min(o_orderdate) AS snapshot_start, max(o_orderdate) AS snapshot_end,
 CASE WHEN report_id % 7 = 0 THEN 'ImportFailed' WHEN report_id % 5 = 0 THEN 'PartiallyImported' ELSE 'SuccessfullyImported' END AS status
FROM (SELECT CAST(r.r_regionkey AS BIGINT) * 10000 + CAST(year(o.o_orderdate) AS BIGINT) AS report_id, r.r_name AS instance_name, o.o_orderdate
 FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
 WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)) b GROUP BY report_id, instance_name""",
    "v_sql": """SELECT report_id, p_partkey, p_type, p_size, concat(replace(p_name, ' ', '_'), '_', replace(p_brand, 'Brand#', 'b')) AS tbl,
 count(*) * (1 + p_size) AS executions, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total_elapsed_time,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS cpu_time,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS io_time,
 CAST(sum(l_quantity) AS BIGINT) * 20000 AS buffer_gets, CAST(sum(l_quantity * l_linenumber) AS BIGINT) * 2000 AS disk_reads,
 CAST(floor(CAST(sum(floor(l_extendedprice)) AS DOUBLE) * (p_size % 20) * (p_size % 20) / 20.0) AS BIGINT) AS rows_processed
FROM {v_base} GROUP BY report_id, p_partkey, p_name, p_brand, p_type, p_size""",
    "top_sqls": """SELECT report_id * 100000 + p_partkey AS id, report_id, CAST(p_partkey AS {STR}) AS sql_id,
 CASE p_partkey % 6 WHEN 0 THEN concat('SELECT * FROM ', tbl, ' WHERE UPPER(name) = ?')
  WHEN 1 THEN concat('SELECT id,  name FROM ', tbl, ' ORDER BY name')
  WHEN 2 THEN concat('select a.id from ', tbl, ' a, ', tbl, '_dim b where a.k = b.k')
  WHEN 3 THEN concat('UPDATE ', tbl, ' SET qty = qty - 1')
  WHEN 4 THEN concat('INSERT INTO ', tbl, ' VALUES (?, ?)')
  ELSE concat('DELETE FROM ', tbl, ' WHERE k NOT IN (1, 2)') END AS sql_text,
 executions, total_elapsed_time, cpu_time, io_time, buffer_gets, disk_reads, rows_processed, total_elapsed_time > 50000 AS is_hot_sql,
 row_number() OVER (PARTITION BY report_id ORDER BY total_elapsed_time DESC, p_partkey) AS rank_by_time, tbl, p_partkey, p_size
FROM {v_sql}""",
    "wait_events": """SELECT user_id * 10000 + CAST(year(ts) AS BIGINT) AS report_id, event_type AS event,
 CASE event_type WHEN 'error' THEN 'Lock' WHEN 'purchase' THEN 'IO' ELSE 'Other' END AS wait_class,
 count(*) AS waits, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_wait_time, CAST(max(value) AS DOUBLE) AS max_wait_time
FROM {events} GROUP BY user_id, year(ts), event_type""",
    "object_stats": """SELECT s.s_nationkey AS report_id, 'public' AS schema_name, p.p_name AS object_name,
 CASE WHEN p.p_size % 4 = 0 THEN 'index' ELSE 'table' END AS object_type, count(*) AS total_scans, CAST(sum(l.l_quantity) AS BIGINT) AS seq_scans,
 CAST(sum(l.l_linenumber) AS BIGINT) AS idx_scans, CAST(sum(floor(l.l_extendedprice)) AS BIGINT) % 20000 AS dead_tuples
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_nationkey, p.p_name, CASE WHEN p.p_size % 4 = 0 THEN 'index' ELSE 'table' END""",
    # a plan of four operators for each statement; the text form of it is made by plan_texts
    "plan_truth": """SELECT t.id AS plan_id, n.node_id, n.parent_id, n.depth,
 CASE n.node_id WHEN 0 THEN CASE WHEN t.p_partkey % 2 = 0 THEN 'Sort' ELSE 'HashAggregate' END
  WHEN 1 THEN CASE WHEN t.p_partkey % 3 = 0 THEN 'Nested Loop' ELSE 'Hash Join' END
  WHEN 2 THEN concat('Seq Scan on ', t.tbl) ELSE concat('Index Scan using idx_', t.tbl, ' on ', t.tbl, '_dim') END AS operation,
 CAST(CASE n.node_id WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 15 ELSE 5 END * (1 + t.p_size) * 7 AS DOUBLE) AS total_cost,
 CAST(CASE n.node_id WHEN 3 THEN 1 ELSE floor(t.total_elapsed_time / (1 + n.node_id)) END AS BIGINT) AS est_rows,
 CAST(8 * (1 + n.node_id) AS BIGINT) AS width,
 CAST(CASE WHEN t.p_partkey % 4 = 0 THEN floor(t.total_elapsed_time / 20) ELSE floor(t.total_elapsed_time / (1 + n.node_id)) END AS BIGINT) AS actual_rows,
 CAST(CASE n.node_id WHEN 0 THEN 400 WHEN 1 THEN 300 WHEN 2 THEN 200 ELSE 50 END * (1 + t.p_size % 10) AS DOUBLE) AS actual_time,
 CASE n.node_id WHEN 2 THEN concat('Filter: (k = ', CAST(t.p_size AS {STR}), ')') WHEN 1 THEN 'Hash Cond: (a.k = b.k)' END AS detail,
 CASE n.node_id WHEN 2 THEN t.tbl WHEN 3 THEN concat(t.tbl, '_dim') END AS table_name
FROM {top_sqls} t CROSS JOIN (VALUES (0, NULL, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2)) AS n(node_id, parent_id, depth)""",
    # a plan of one of ten shapes for each order, up to six levels deep: joins of all kinds, subplans, partitions, bitmaps, spills
    "plan_shapes": """SELECT o.o_orderkey AS plan_id, n.shape, n.node_id, n.parent_id, n.depth, n.operation, n.detail,
 CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 3000 + 10 * (8 - n.node_id) AS DOUBLE) AS total_cost,
 (CAST(floor(o.o_totalprice) AS BIGINT) + 7919 * n.node_id) % 200000 + 1 AS est_rows, CAST(4 + 4 * n.node_id AS BIGINT) AS width,
 ((CAST(floor(o.o_totalprice) AS BIGINT) + 7919 * n.node_id) % 200000 + 1) * CASE WHEN o.o_orderkey % 3 = 0 THEN 11 ELSE 1 END AS actual_rows,
 CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 7000 AS DOUBLE) AS actual_time
FROM {orders} o JOIN (VALUES
  (0, 0, NULL, 0, 'Sort', 'Sort Method: external merge  Disk: 1024kB'), (0, 1, 0, 1, 'Hash Join', 'Hash Cond: (o.k = l.k)'), (0, 2, 1, 2, 'Seq Scan on lines l', 'Filter: (qty > 5)'), (0, 3, 1, 2, 'Hash', NULL), (0, 4, 3, 3, 'Index Scan using idx_o on heads o', 'Filter: (k > 1)'),
  (1, 0, NULL, 0, 'Limit', NULL), (1, 1, 0, 1, 'Nested Loop', NULL), (1, 2, 1, 2, 'Seq Scan on parts p', NULL), (1, 3, 1, 2, 'Materialize', NULL), (1, 4, 3, 3, 'CTE Scan recent', NULL),
  (2, 0, NULL, 0, 'Nested Loop', NULL), (2, 1, 0, 1, 'Seq Scan on lands n', NULL), (2, 2, 0, 1, 'Index Scan using pk_c on buyers c', 'Index Cond: (c.k = n.k)'),
  (3, 0, NULL, 0, 'Nested Loop', 'Join Filter: (a.x < b.x)'), (3, 1, 0, 1, 'Seq Scan on a', NULL), (3, 2, 0, 1, 'Sample Scan', NULL),
  (4, 0, NULL, 0, 'HashAggregate', NULL), (4, 1, 0, 1, 'Partition Iterator', 'Iterations: 12'), (4, 2, 1, 2, 'Partitioned Seq Scan on sales', 'Selected Partitions:  1..12'),
  (5, 0, NULL, 0, 'Aggregate', NULL), (5, 1, 0, 1, 'Partition Iterator', 'Iterations: 1'), (5, 2, 1, 2, 'Partitioned Seq Scan on sales', NULL),
  (6, 0, NULL, 0, 'Bitmap Heap Scan on parts', 'Recheck Cond: (k = 3)'), (6, 1, 0, 1, 'Bitmap Index Scan on idx_parts', 'Index Cond: (k = 3)'),
  (7, 0, NULL, 0, 'Result', NULL), (7, 1, 0, 1, 'InitPlan 1 (returns $0)', NULL), (7, 2, 0, 1, 'Subquery Scan on q1', NULL), (7, 3, 2, 2, 'Seq Scan on t1', NULL), (7, 4, 0, 1, 'Subquery Scan on q2', NULL), (7, 5, 4, 2, 'Merge Join', 'Merge Cond: (a = b)'),
  (8, 0, NULL, 0, 'Function Scan on func_report', NULL),
  (9, 0, NULL, 0, 'Rownum', NULL), (9, 1, 0, 1, 'Sort', 'Sort Key: a'), (9, 2, 1, 2, 'HashAggregate', NULL), (9, 3, 2, 3, 'Hash Right Join', 'Hash Cond: (a = b)'), (9, 4, 3, 4, 'Hash', NULL), (9, 5, 4, 5, 'Seq Scan on deep_one', 'Filter: (f(x) > 1)'), (9, 6, 3, 4, 'Seq Scan on deep_two', NULL)) AS n(shape, node_id, parent_id, depth, operation, detail)
 ON n.shape = CAST(floor(o.o_totalprice) AS BIGINT) % 10""",
}


def needs(view: str) -> list[str]:
    """Names in braces, in order of first use."""
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[view])) if n != "STR"]


def load(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A given table or a view over the given tables; given: what a view reads in place of those of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name].replace("{STR}", "STRING"), **{n: given[n] if n in given else load(spark, sf_dir, n) for n in needs(name)})


#: Low bits of a statement's key that hold its part.
PART_BITS = 40


def keyed(statements: DataFrame) -> DataFrame:
    """top_sqls with a key of each statement as id: the id of the view is that of several statements where parts exceed 100,000."""
    return statements.withColumn("id", F.shiftleft("report_id", PART_BITS).bitwiseOR(F.col("p_partkey")))


def id_of(key: str) -> Column:
    """The id in top_sqls of a key that keyed() gave."""
    return F.shiftright(key, PART_BITS) * 100000 + F.col(key).bitwiseAND((1 << PART_BITS) - 1)


def duckdb_ctes(*names: str) -> str:
    """WITH clause that defines the named views and all they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in needs(name):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    plain = {n: n for n in (*BASE, *VIEWS)}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(STR='VARCHAR', **plain)})" for n in order) + "\n" if order else ""
