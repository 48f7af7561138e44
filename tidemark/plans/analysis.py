"""Plan analytics over the node relation: costs, metadata, rule sets, diffs, advice, heatmap and waterfall."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn


def table_of(operation: str = "operation") -> Column:
    """The table that a scan names, or null."""
    return F.nullif(F.regexp_extract(F.col(operation), r"(?i)\s+on\s+([^\s()]+)", 1), F.lit(""))


def filter_of(details: str = "details") -> Column:
    """The condition of a Filter line, or null."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(F.col(details), F.lit("")), r"(?m)^\s*Filter:\s*(.*)$", 1)), F.lit(""))


def index_of(operation: str = "operation") -> Column:
    return F.nullif(F.regexp_extract(F.col(operation), r"(?i)\busing\s+([^\s()]+)", 1), F.lit(""))


def metadata(nodes: DataFrame, *more: Column) -> DataFrame:
    """Highest cost, sum of rows, depth, number of nodes, actual figures and estimated milliseconds of each plan; more: further aggregates."""
    return nodes.groupBy("plan_id").agg(
        F.max("total_cost").alias("total_cost"), F.sum("est_rows").alias("total_rows"), (F.max("depth") + 1).alias("plan_depth"), F.count(F.lit(1)).alias("node_count"),
        F.bool_or(F.col("actual_rows").isNotNull()).alias("has_actual_stats"), (F.max("total_cost") * 0.01).alias("estimated_time_ms"), *more,
    )


def self_cost(nodes: DataFrame) -> DataFrame:
    """Nodes with self_cost (cost less that of the children, not below 0) and percentage of the root's cost."""
    children = nodes.filter("parent_id IS NOT NULL").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.sum("total_cost").alias("child_cost"))
    root = F.max(F.when(F.col("node_id") == 0, F.col("total_cost"))).over(Window.partitionBy("plan_id"))
    own, cost = F.coalesce("total_cost", F.lit(0.0)) - F.coalesce("child_cost", F.lit(0.0)), F.coalesce("total_cost", F.lit(0.0))
    return nodes.join(children, ["plan_id", "node_id"], "left").withColumn("self_cost", F.greatest(F.lit(0.0), own)).withColumn("percentage", F.when(root > 0, cost / F.nullif(root, F.lit(0.0)) * 100).otherwise(F.lit(0.0))).drop("child_cost")


def _found(rules: list[tuple[str, Column, Column | None, Column | None]]) -> Column:
    """Array of the rules that hold for a node: rule_id, warning, suggestion."""
    found = [F.when(when, F.struct(F.lit(i).alias("rule_id"), (w if w is not None else F.lit(None).cast("string")).alias("warning"), (s if s is not None else F.lit(None).cast("string")).alias("suggestion"))) for i, when, w, s in rules]
    return F.array_compact(F.array(*found))


def _hits(nodes: DataFrame, rules: list[tuple[str, Column, Column | None, Column | None]]) -> DataFrame:
    """One row for each node and rule that holds: rule_id, warning, suggestion."""
    return nodes.select("plan_id", "node_id", "operation", F.explode(_found(rules)).alias("h")).select("plan_id", "node_id", "operation", "h.*")


def _core() -> list[tuple[str, Column, Column | None, Column | None]]:
    """The six core rules. Texts are fixed values."""
    op, rows, cost = F.col("operation"), F.coalesce("est_rows", F.lit(0)), F.coalesce("total_cost", F.lit(0.0))
    actual = F.col("actual_rows")
    t = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    table = F.coalesce(table_of(), F.lit("unknown"))
    r, a = rows.cast("double"), actual.cast("double")
    return [
        ("seq_scan", op.contains("Seq Scan") & (rows > 100000), t("Full table scan on '", table, "' will process ", rows.cast("string"), " rows"), F.when(table_of().isNotNull(), t("Consider creating an index on table '", table, "' to reduce full table scans"))),
        ("nested_loop", op.contains("Nested Loop") & (cost > 1000), t("Nested Loop join has high cost (", F.format_string("%.2f", cost), "), consider Hash Join instead"), F.lit("Consider increasing work_mem to enable Hash Join for better performance")),
        ("filter_scan", op.contains("Seq Scan") & filter_of().isNotNull(), t("Sequential scan with filter condition may benefit from an index: ", F.coalesce(filter_of(), F.lit(""))), None),
        ("sort", op.contains("Sort") & (rows > 10000), t("Sort operation on ", rows.cast("string"), " rows may be expensive"), F.lit("Consider adding an index with ORDER BY columns to avoid sorting")),
        ("hash_join", op.contains("Hash Join") & (rows > 100000), t("Hash Join on ", rows.cast("string"), " rows may require significant memory"), F.lit("Ensure work_mem is sufficient for hash table size")),
        ("estimate", (a > r * 10) | (a < r * 0.1), t("Row estimation error: estimated ", rows.cast("string"), " but actual ", actual.cast("string"), " rows (", (F.greatest(a, r) / F.nullif(F.least(a, r), F.lit(0.0))).cast("string"), "x difference)"), F.lit("Run ANALYZE on the involved tables to update statistics")),
    ]


def core_rules(nodes: DataFrame) -> DataFrame:
    """Hits of the six core rules."""
    return _hits(nodes, _core())


def alternative_rules(nodes: DataFrame) -> DataFrame:
    """The four alternative rules, on exact operator names. Texts are fixed values."""
    op, rows, cost = F.col("operation"), F.col("est_rows"), F.col("total_cost")
    bare = F.trim(F.regexp_replace(op, r"(?i)\s+on\s+.*$", ""))
    return _hits(
        nodes,
        [
            ("seq_scan", (bare == "Seq Scan") & (rows > 1000000), None, F.lit("Consider creating an index on frequently filtered columns")),
            ("nested_loop", bare == "Nested Loop", None, F.lit("Nested loop join detected. Consider hash join for larger datasets")),
            ("sort", bare == "Sort", None, F.lit("Sort operation detected. Consider adding an index to avoid sorting")),
            ("cost", cost > 1000, None, F.concat(F.lit("High cost operation ("), F.format_string("%.2f", cost), F.lit("). Review query structure"))),
        ],
    )


#: Severity and kind of the visualiser's rules.
UI_RULES = {
    "Gauss-XN-001": ("High", "Risk"), "Gauss-XN-002": ("Medium", "Suggestion"), "Gauss-XN-003": ("Medium", "Suggestion"), "Gauss-XN-004": ("High", "Risk"), "Gauss-XN-005": ("High", "Risk"), "Gauss-XN-006": ("High", "Risk"),
    "Gauss-XN-007": ("Medium", "Suggestion"), "Gauss-XN-008": ("High", "Risk"), "Gauss-XN-009": ("High", "Suggestion"), "Gauss-XN-011": ("High", "Risk"), "Gauss-XN-012": ("High", "Suggestion"), "Gauss-XN-013": ("High", "Risk"),
}


def ui_rules(nodes: DataFrame) -> DataFrame:
    """Hits of the twelve visualiser rules: plan_id, node_id, rule_id, severity, kind. Nodes that hold child_operations meet no others."""
    if "child_operations" in nodes.columns:
        has = lambda x, *words: reduce(or_, [F.lower(x).contains(w) for w in words])
        n = nodes.withColumn("index_child", F.exists("child_operations", lambda x: has(x, "index scan"))).withColumn("sub_children", F.size(F.filter("child_operations", lambda x: has(x, "subquery", "initplan"))))
    else:
        child_op = F.lower("operation")
        children = nodes.filter("parent_id IS NOT NULL").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.bool_or(child_op.contains("index scan")).alias("index_child"), F.count_if(child_op.contains("subquery") | child_op.contains("initplan")).alias("sub_children"))
        n = nodes.join(children, ["plan_id", "node_id"], "left")
    op, details = F.lower("operation"), F.lower(F.concat_ws("\n", "operation", "details"))
    rows, cost, root = F.coalesce("est_rows", F.lit(0)), F.coalesce("total_cost", F.lit(0.0)), F.col("node_id") == 0
    times = F.regexp_extract(details, r"iterations:?\s*(\d+|part)", 1)
    many = F.when(times == "", ~details.contains("iterations: 1")).when(times == "part", F.lit(True)).otherwise(times.try_cast("long") > 5)
    when = {
        "Gauss-XN-001": root & (cost > 1000),
        "Gauss-XN-002": op.contains("seq scan") & (rows > 10000) & (cost > 100),
        "Gauss-XN-003": op.contains("subplan") | op.contains("subquery scan"),
        "Gauss-XN-004": op.contains("nested loop") & ~F.coalesce("index_child", F.lit(False)) & ~details.contains("join filter") & ~details.contains("index cond"),
        "Gauss-XN-005": op.contains("partition iterator") & many,
        "Gauss-XN-006": root & (F.col("actual_time") > 3000),
        "Gauss-XN-007": op.contains("bitmap heap scan"),
        "Gauss-XN-008": fn.spills(details),
        "Gauss-XN-009": op.contains("index scan") & details.contains("filter:"),
        "Gauss-XN-011": details.contains("func") | details.contains("fnc"),
        "Gauss-XN-012": F.coalesce("sub_children", F.lit(0)) >= 3,
        "Gauss-XN-013": op.contains("rownum") & (rows > 10000),
    }
    found = [F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(UI_RULES[i][0]).alias("severity"), F.lit(UI_RULES[i][1]).alias("kind"))) for i, c in when.items()]
    return n.select("plan_id", "node_id", "operation", F.explode(F.array_compact(F.array(*found))).alias("h")).select("plan_id", "node_id", "operation", "h.*")


def rule_hits(hits: DataFrame) -> DataFrame:
    """Nodes of each plan and rule, in order, with their number."""
    return hits.groupBy("plan_id", "rule_id").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"), F.count(F.lit(1)).alias("n"))


def analysis(nodes: DataFrame, cost_limit: float | None = None, rows_limit: int | None = None) -> DataFrame:
    """Score, potential and estimated improvement of each plan, by the core rules and optional limits."""
    # the rules are judged in each node's row, so one aggregate of the nodes gives all
    warned = F.size(F.filter(_found(_core()), lambda h: h["warning"].isNotNull()))
    out = metadata(nodes, F.sum(warned).alias("warnings"))
    over = F.lit(0)
    if cost_limit is not None:
        over = over + F.when(F.col("total_cost") > cost_limit, 1).otherwise(0)
    if rows_limit is not None:
        over = over + F.when(F.col("total_rows") > rows_limit, 1).otherwise(0)
    out = out.withColumn("score", fn.plan_score("warnings", over))
    return out.withColumn("potential", fn.plan_potential("score")).withColumn("improvement", fn.plan_improvement("score"))


def issues(nodes: DataFrame) -> DataFrame:
    """Warnings of the core rules as issues with class, severity and cost impact."""
    meta = metadata(nodes).select("plan_id", "total_rows", (F.col("total_cost") * 0.1).cast("int").alias("cost_impact"))
    w = core_rules(nodes).filter("warning IS NOT NULL")
    return w.join(meta, "plan_id").select("plan_id", "node_id", "rule_id", fn.classify_issue("warning").alias("issue_type"), fn.warning_severity("warning").alias("severity"), F.col("total_rows").alias("affected_rows"), "cost_impact", "warning")


def contains(nodes: DataFrame, words: str) -> DataFrame:
    """Whether any operator of each plan contains a text."""
    return nodes.groupBy("plan_id").agg(F.bool_or(F.col("operation").contains(words)).alias("found"))


def diff_risks(nodes: DataFrame) -> DataFrame:
    """Nodes with the array of their risks."""
    op, rows = F.lower("operation"), F.coalesce("est_rows", F.lit(0))
    ratio = F.col("actual_rows") / F.nullif(rows, F.lit(0))
    risks = {"diskSpill": fn.spills("details"), "largeSeqScan": op.contains("seq scan") & (rows > 10000), "highCost": F.col("total_cost") > 10000, "nestLoop": op.contains("nested loop") & (rows > 10000), "badEst": (rows > 0) & ((ratio > 10) | (ratio < 0.1))}
    return nodes.withColumn("risks", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in risks.items()])))


def match_scores(left: dict, right: dict) -> int:
    """Score of two nodes, given as dicts with op, target, kind and ext_id."""
    score = 50 if left["op"] == right["op"] else 25 if left["op"] in right["op"] or right["op"] in left["op"] else 0
    score += 30 if left["ext_id"] and left["ext_id"] == right["ext_id"] else 0
    score += 60 if left["target"] and left["target"] == right["target"] else 0
    if left["kind"] == right["kind"] and (left["kind"] == "Join" or left["kind"] == "Scan" and left["target"] == right["target"]):
        score += 20
    return score


def match_nodes(left: DataFrame, right: DataFrame, least: int = 40) -> DataFrame:
    """plan_id, left_node, right_node, score: nodes of two plans with one plan_id, matched one to one.

    Left nodes pick by falling cost (then id) the best free right node; a pair needs a score of `least`.
    """
    node = F.struct("node_id", F.coalesce("total_cost", F.lit(0.0)).alias("cost"), fn.normalize_op("operation").alias("op"), fn.extract_target("operation").alias("target"), fn.node_type("operation").alias("kind"), "ext_id")
    # one row for each pair of plans, so Python gets batches of plans and not a group for each
    side = lambda df, name: df.groupBy("plan_id").agg(F.collect_list(node).alias(name))
    both = side(left, "l").join(side(right, "r"), "plan_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for plan_id, l, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                order = lambda n: (-n["cost"], n["node_id"])
                free = sorted(r, key=order)
                for x in sorted(l, key=order):
                    scores = [match_scores(x, y) for y in free]
                    best = max(scores, default=-1)
                    if best >= least:
                        y = free.pop(scores.index(best))
                        out.append((plan_id, x["node_id"], y["node_id"], best))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["plan_id", "left_node", "right_node", "score"])

    return both.mapInArrow(run, "plan_id long, left_node int, right_node int, score int")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every node of both plans with its partner, verdict, and new, resolved and persisting risks."""
    m = match_nodes(left, right)
    take = lambda df, side: diff_risks(df).select("plan_id", F.col("node_id").alias(f"{side}_node"), F.col("operation").alias(f"{side}_operation"), F.coalesce("actual_time", "total_cost").alias(f"{side}_value"), F.col("risks").alias(f"{side}_risks"))
    out = take(left, "left").join(m, ["plan_id", "left_node"], "left").join(take(right, "right"), ["plan_id", "right_node"], "full")
    a, b = F.col("left_value"), F.col("right_value")
    verdict = F.when(F.col("left_operation").isNull(), "new").when(F.col("right_operation").isNull(), "removed").when(b < a * 0.9, "improved").when(b > a * 1.1, "regressed").otherwise("similar")
    none = F.expr("cast(array() AS array<string>)")
    l, r = F.coalesce("left_risks", none), F.coalesce("right_risks", none)
    return out.select("plan_id", "left_node", "right_node", "left_operation", "right_operation", "score", verdict.alias("verdict"), F.array_except(r, l).alias("new_risks"), F.array_except(l, r).alias("resolved_risks"), F.array_intersect(l, r).alias("persisting_risks"))


def verdict(left: DataFrame, right: DataFrame) -> DataFrame:
    """Improved, Regressed or Similar for each pair of plans, by the roots' time or else cost, within five per cent."""
    root = lambda df, name: df.filter("node_id = 0").select("plan_id", F.coalesce("actual_time", "total_cost").alias(name))
    a, b = F.col("a"), F.col("b")
    return root(left, "a").join(root(right, "b"), "plan_id").select("plan_id", F.when(b < a * 0.95, "Improved").when(b > a * 1.05, "Regressed").otherwise("Similar").alias("verdict"))


def advice(nodes: DataFrame) -> DataFrame:
    """Index, statistics and rewrite advice: plan_id, node_id, kind, statement, explanation. Texts are fixed values."""
    op, table, cond = F.col("operation"), table_of(), filter_of()
    column = F.try_element_at(F.filter(F.split(F.split(cond, "=")[0], r"\s+"), lambda x: x != ""), F.lit(-1))
    clean = ~column.contains("(") & ~column.contains(")")
    f = F.format_string
    none = F.lit(None).cast("string")
    seq = op.contains("Seq Scan") & table.isNotNull()
    s = lambda kind, statement, text: F.struct(F.lit(kind).alias("kind"), statement.alias("statement"), text.alias("explanation"))
    found = [
        F.when(seq & cond.isNotNull() & clean, s("index", f("-- Consider: CREATE INDEX idx_%s_%s ON %s(%s);", table, column, table, column), f("Sequential scan on %s with filter '%s' - consider index on %s", table, cond, column))),
        F.when(seq & cond.isNotNull() & ~F.coalesce(clean, F.lit(False)), s("index", none, f("Sequential scan on %s with complex filter '%s' - manual analysis needed", table, cond))),
        F.when(seq & cond.isNull(), s("index", none, f("Sequential scan on %s without filter - check if index needed", table))),
        F.when(table.isNotNull(), s("statistics", f("-- Consider: ANALYZE %s;", table), f("Table %s may benefit from updated statistics for better query planning", table))),
        F.when(op.contains("Nested Loop") & (F.col("total_cost") > 1000), s("rewrite", F.lit("-- Consider: Rewrite with explicit JOIN syntax and appropriate indexes"), F.lit("High-cost nested loop join detected - consider hash join or better indexes"))),
        F.when(op.contains("Sort") & (F.col("est_rows") > 10000), s("rewrite", F.lit("-- Consider: Add covering index to avoid sorting"), F.lit("Large sort operation detected - consider index on ORDER BY columns"))),
    ]
    return nodes.select("plan_id", "node_id", F.explode(F.array_compact(F.array(*found))).alias("a")).select("plan_id", "node_id", "a.*")


def advice_confidence(advised: DataFrame) -> DataFrame:
    """High where a plan's advice of a kind holds a statement, else Low."""
    return advised.groupBy("plan_id", "kind").agg(F.count("statement").alias("statements"), F.when(F.count("statement") > 0, "High").otherwise("Low").alias("confidence"))


def table_names(nodes: DataFrame) -> DataFrame:
    """Distinct tables of each plan, without derived ones."""
    t = table_of()
    return nodes.select("plan_id", t.alias("table_name")).filter(F.col("table_name").isNotNull() & ~F.col("table_name").startswith('"*SELECT*')).distinct()


def flatten(nodes: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Nodes in pre-order. With expanded (plan_id, node_id), children show only below expanded parents."""
    out = nodes
    if expanded is not None:
        open_ = expanded.select("plan_id", F.col("node_id").alias("parent_id"))
        out = nodes.filter("parent_id IS NULL").unionByName(nodes.join(open_, ["plan_id", "parent_id"], "left_semi").select(*nodes.columns))
    return out.orderBy("plan_id", "path")


def node_labels(nodes: DataFrame) -> DataFrame:
    """Text label of each node, and its severity by the number of its warnings."""
    w = core_rules(nodes).filter("warning IS NOT NULL").groupBy("plan_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(w, ["plan_id", "node_id"], "left").withColumn("n_warnings", F.coalesce("n", F.lit(0)))
    label = F.concat_ws(" ", "operation", F.concat(F.lit("(cost: "), F.col("total_cost").cast("decimal(20,2)").cast("string"), F.lit(", rows: "), F.col("est_rows").cast("string"), F.lit(")")))
    return out.select("plan_id", "node_id", "depth", label.alias("label"), "n_warnings", F.when(F.col("n_warnings") > 1, "high").when(F.col("n_warnings") == 1, "warning").otherwise("normal").alias("severity"))


def heatmap(nodes: DataFrame) -> DataFrame:
    """Q-error of each node (Moerkotte et al., VLDB 2009) and whether it lies on the path of greatest actual time.

    There is no result to match: the figures follow the cited definition.
    """
    e, a = F.greatest(F.col("est_rows").cast("double"), F.lit(1.0)), F.greatest(F.col("actual_rows").cast("double"), F.lit(1.0))
    first = F.row_number().over(Window.partitionBy("plan_id", "parent_id").orderBy(F.desc_nulls_last("actual_time"), "node_id")) == 1
    marked = nodes.withColumn("q_error", F.greatest(e / a, a / e)).withColumn("row_ratio", a / e).withColumn("is_first", first)
    heads = marked.filter("is_first").groupBy("plan_id").agg(F.collect_set(F.to_json("path")).alias("firsts"))
    # a node is critical if it and all its ancestors are the slowest child of their parents
    chain = F.expr("forall(sequence(1, size(path)), k -> array_contains(firsts, to_json(slice(path, 1, k))))")
    return marked.join(heads, "plan_id").select("plan_id", "node_id", "operation", "est_rows", "actual_rows", "q_error", "row_ratio", F.coalesce(chain, F.lit(False)).alias("critical"))


def heatmap_summary(heat: DataFrame, deviated: float = 2, severe: float = 10) -> DataFrame:
    return heat.groupBy("plan_id").agg(F.max("q_error").alias("max_q_error"), F.count_if(F.col("q_error") > deviated).alias("deviated"), F.count_if(F.col("q_error") > severe).alias("severe"))


def waterfall(nodes: DataFrame, bottleneck: float = 30) -> DataFrame:
    """Own time of each node (actual time less that of its children), its share of the plan's, and bottlenecks.

    There is no result to match: the figures follow from the actual times.
    """
    kids = nodes.filter("parent_id IS NOT NULL").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.sum("actual_time").alias("child_time"))
    own = F.greatest(F.lit(0.0), F.coalesce("actual_time", F.lit(0.0)) - F.coalesce("child_time", F.lit(0.0)))
    out = nodes.join(kids, ["plan_id", "node_id"], "left").withColumn("own_ms", own)
    total = F.sum("own_ms").over(Window.partitionBy("plan_id"))
    share = F.when(total > 0, F.col("own_ms") / F.nullif(total, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    return out.select("plan_id", "node_id", "operation", "own_ms", share.alias("percent"), (share >= bottleneck).alias("bottleneck"))


def catalog_findings(nodes: DataFrame) -> DataFrame:
    """Hits of the catalogue rules that a plan's nodes can decide; the conditions are this engine's own.

    There is no result to match: the catalogue gives names and severities only.
    """
    op, d = F.col("operation"), F.lower(F.concat_ws("\n", "operation", "details"))
    rows, a = F.coalesce("est_rows", F.lit(0)), F.col("actual_rows")
    far = (a > rows * 10) | (a < rows * 0.1)
    when = {
        "SCAN-001": (op.contains("Seq Scan") & (rows > 100000), "Warning"),
        "SCAN-004": (op.contains("Seq Scan") & filter_of().isNotNull() & (rows > 1000), "Warning"),
        "JOIN-001": (op.contains("Nested Loop") & (rows > 10000), "Warning"),
        "JOIN-002": (op.contains("Hash Join") & fn.spills("details"), "Critical"),
        "MEM-001": (op.contains("Sort") & fn.spills("details"), "Critical"),
        "NET-001": (d.contains("broadcast") & (rows > 10000), "Warning"),
        "EST-001": (far, "Warning"),
        "EST-004": (op.contains("Nested Loop") & (a > rows * 10), "Warning"),
        "TYPE-004": (d.rlike(r"like '%|~~ '%"), "Info"),
        "VEC-001": (d.contains("row adapter") | d.contains("vector adapter"), "Info"),
        "GEN-001": (F.col("depth") >= 15, "Info"),
        "SUBQ-001": (d.contains("subquery scan"), "Warning"),
        "AGG-001": (op.contains("GroupAggregate") & (rows > 100000), "Info"),
        "AGG-002": (op.contains("HashAggregate") & fn.spills("details"), "Critical"),
        "PART-001": (d.rlike(r"partition iterator") & d.rlike(r"selected partitions:\s*1\.\."), "Warning"),
    }
    found = [F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, (c, s) in when.items()]
    return nodes.select("plan_id", "node_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("plan_id", "node_id", "f.*")


def root_lines(lines: DataFrame, gap: int = 10) -> DataFrame:
    """Line numbers of plan roots that lie more than `gap` lines after the last accepted one; lines: plan_id, line_no."""
    fold = F.expr(f"aggregate(l, cast(array() AS array<int>), (a, x) -> CASE WHEN size(a) = 0 OR x > element_at(a, -1) + {gap} THEN array_append(a, x) ELSE a END)")
    return lines.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.col("line_no").cast("int"))).alias("l")).select("plan_id", fold.alias("roots"))



def convert(nodes: DataFrame) -> DataFrame:
    """Nodes in the model of the viewer: missing costs and rows are 0, condition, index and table stand in own columns."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return nodes.select(
        "plan_id", "node_id", "parent_id", "operation", F.coalesce("total_cost", F.lit(0.0)).alias("cost"), zero("est_rows").alias("rows"), "actual_rows", "actual_time", "width",
        filter_of().alias("filter"), index_of().alias("index_name"), table_of().alias("table_name"),
    )
