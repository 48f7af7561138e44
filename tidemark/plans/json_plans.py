"""JSON plans to relations of nodes, as VARIANT values walked level by level, without Python workers.

The children of all plans' nodes of a level are taken out together and written to the shared folder, so the number of
jobs is the depth of the deepest plan, any number of plans is walked at once, and a lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Property names of JSON plans; the second names are those of the engine's own node form.
JSON_KEYS = {"operation": ("Node Type", "operation"), "startup_cost": ("Startup Cost",), "total_cost": ("Total Cost", "cost"), "est_rows": ("Plan Rows", "rows"), "width": ("Plan Width", "width"), "actual_rows": ("Actual Rows", "actual_rows"), "actual_time": ("Actual Total Time", "actual_time"), "loops": ("Actual Loops",)}
JSON_DETAILS = ("Filter", "Index Cond", "Hash Cond", "Join Filter", "Join Type", "Index Name", "Sort Key")


def is_object(v: str) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def value(names: tuple[str, ...], kind: str) -> Column:
    """The first of these properties that a node has, as a type; null where it can't be one."""
    return F.coalesce(*[F.try_variant_get("node", f"$['{n}']", kind) for n in names])


def walk(roots: DataFrame, children: tuple[str, ...]) -> DataFrame:
    """plan_id, path, node of all nodes below roots (plan_id, node), the roots included; children: properties that hold them."""
    level, levels = roots.select("plan_id", F.array(F.lit(0)).alias("path"), "node"), []
    while not levels or not level.isEmpty():
        levels.append(level := written(level))
        below = level.select("plan_id", "path", F.posexplode(value(children, "array<variant>")).alias("i", "node"))
        level = written(below.select("plan_id", F.array_append("path", F.col("i")).alias("path"), "node"))
    return reduce(DataFrame.unionByName, levels)


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes (plan_id, path) with node_id in the order of the text, parent_id and depth; both joins stay within a plan's partition."""
    out = nodes.withColumn("node_id", (F.row_number().over(Window.partitionBy("plan_id").orderBy("path")) - 1).cast("int"))
    parents = out.select("plan_id", F.col("path").alias("up"), F.col("node_id").alias("parent_id"))
    up = F.when(F.size("path") > 1, F.expr("slice(path, 1, size(path) - 1)"))
    return out.withColumn("up", up).join(parents, ["plan_id", "up"], "left").withColumn("depth", F.size("path") - 1).drop("up")


def parse_json(plans: DataFrame) -> DataFrame:
    """Nodes of plans in JSON form: an object with Plan, a list of one, or the engine's own node form.

    Texts that are no JSON object, or a list that doesn't start with one, nulls included, give no row; children that
    are no objects are passed over.
    """
    parsed = plans.select("plan_id", F.try_parse_json("plan_text").alias("v"))
    first = parsed.select("plan_id", F.coalesce(F.try_variant_get("v", "$[0]", "variant"), F.col("v")).alias("v")).filter(is_object("v"))
    roots = first.select("plan_id", F.coalesce(F.try_variant_get("v", "$.Plan", "variant"), F.col("v")).alias("node"))
    nodes = walk(roots, ("Plans", "children")).filter(is_object("node"))
    kinds = {"operation": "string"}
    columns = [value(names, kinds.get(k, "double")).alias(k) for k, names in JSON_KEYS.items()]
    details = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), value((k,), "string")) for k in JSON_DETAILS])
    out = numbered(nodes.select("plan_id", "path", *columns, value(("Index Name",), "string").alias("index"), value(("Relation Name",), "string").alias("relation"), details.alias("details")))
    some = lambda word, c: F.coalesce(F.concat(F.lit(word), c), F.lit(""))
    operation = F.concat(F.coalesce("operation", F.lit("")), some(" using ", "index"), some(" on ", "relation"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return out.select("plan_id", "node_id", "parent_id", "depth", "path", operation.alias("operation"), "startup_cost", "total_cost", whole("est_rows"), whole("width"), "actual_time", whole("actual_rows"), whole("loops"), "details", F.lit(None).cast("string").alias("ext_id"))


#: Properties of the native node form, with their types; the first four and children must be there.
NATIVE = {"node_type": "string", "cost": "double", "rows": "long", "width": "long", "actual_rows": "long", "actual_time": "double", "filter": "string", "buffers": "string", "join_type": "string", "index_name": "string", "table_name": "string", "output": "array<string>", "hash_keys": "array<string>"}


def parse_native_json(plans: DataFrame) -> DataFrame:
    """Nodes of plans in the engine's native JSON form: plan_id, node_id, parent_id, depth, path and the properties of NATIVE.

    A plan counts as a whole: one node that lacks its type, cost, rows, width or list of children, or has a negative
    number for rows or width, or a child that is no object, and the plan gives no row.
    """
    roots = plans.select("plan_id", F.try_parse_json("plan_text").alias("node")).filter("node IS NOT NULL")
    nodes = walk(roots, ("children",)).withColumns({k: value((k,), kind) for k, kind in NATIVE.items()})
    fine = is_object("node") & F.col("node_type").isNotNull() & F.col("cost").isNotNull() & F.coalesce(F.col("rows") >= 0, F.lit(False)) & F.coalesce(F.col("width") >= 0, F.lit(False)) & value(("children",), "array<variant>").isNotNull()
    judged = nodes.withColumn("fine", fine)
    wrong = judged.filter(~F.coalesce("fine", F.lit(False))).select("plan_id").distinct()
    return numbered(judged.join(wrong, "plan_id", "left_anti").drop("node", "fine")).select("plan_id", "node_id", "parent_id", "depth", "path", *NATIVE)
