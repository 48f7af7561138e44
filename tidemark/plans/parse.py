"""EXPLAIN output to a relation of plan nodes.

A node row is (plan_id, node_id, parent_id, depth, path, operation, startup_cost, total_cost, est_rows, width,
actual_time, actual_rows, loops, details, ext_id). Text and tabular plans are read line by line over Arrow batches of
plans, so no plan is shuffled; the parent of a node is the last earlier node with a smaller indent. Columns that the
caller doesn't want are not made. JSON plans are walked by json_plans.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.json_plans import parse_json

COST = r"\(cost=([0-9.]+)\.\.([0-9.]+)\s+rows=([0-9]+)(?:\s+width=([0-9]+))?"
ACTUAL = r"\(actual time=([0-9.]+)\.\.([0-9.]+)\s+rows=([0-9]+)\s+loops=([0-9]+)\)"
IGNORED = r"(?i)^\s*(set\s|explain[\s(]|select\s|insert\s|update\s|delete\s|create\s|drop\s|with\s|--|-+\s*$|=+\s*$|query plan|\(\d+ rows?\)|gaussdb=#|total runtime|planning time|execution time)"
TABULAR = r"(?im)\|\s*operation\s*\||^\s*\d+\s*\|"


def plan_format(text: Column) -> Column:
    """tabular, json or text."""
    return F.when(F.trim(text).rlike(r"^[\[{]"), "json").when(text.rlike(TABULAR), "tabular").otherwise("text")


def plan_type(text: Column) -> Column:
    """Explain Performance for tabular plans, Explain Analyze with actual figures, else Explain Only."""
    return F.when(plan_format(text) == "tabular", "Explain Performance").when(text.rlike(r"\(actual time="), "Explain Analyze").otherwise("Explain Only")


def barrier(df: DataFrame) -> DataFrame:
    """The same rows, with columns computed once: Catalyst doesn't push expressions through a generator.

    Without it an array column would be inlined into the lambdas that use it and computed for each element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: Columns of a node after plan_id, with their types in Spark and Arrow.
NODE = {
    "node_id": ("int", pa.int32()), "parent_id": ("int", pa.int32()), "depth": ("int", pa.int32()), "path": ("array<int>", pa.list_(pa.int32())), "operation": ("string", pa.string()), "startup_cost": ("double", pa.float64()), "total_cost": ("double", pa.float64()), "est_rows": ("bigint", pa.int64()),
    "width": ("bigint", pa.int64()), "actual_time": ("double", pa.float64()), "actual_rows": ("bigint", pa.int64()), "loops": ("bigint", pa.int64()), "details": ("string", pa.string()), "ext_id": ("string", pa.string()),
    "child_operations": ("array<string>", pa.list_(pa.string())),
}
#: Made only for callers that name them.
ASKED_FOR = ("child_operations",)
#: Nodes of an Arrow batch.
BATCH_NODES = 20_000


def tree(indents: list[int | None]) -> tuple[list[int | None], list[int], list[list[int]]]:
    """(parents, depths, paths) of nodes by their indents; the first is the root, an unknown indent hangs below it."""
    parents, depths, paths, children = [None], [0], [[0]], [0] * len(indents)
    for i in range(1, len(indents)):
        j, own = i - 1, indents[i]
        # what lies between a node and its parent is indented as far as the node at least
        while j and (own is None or indents[j] is None or indents[j] >= own):
            j = j - 1 if indents[j] is None else parents[j]
        parents.append(j)
        depths.append(depths[j] + 1)
        paths.append([*paths[j], children[j]])
        children[j] += 1
    return parents, depths, paths


def _parsed(plans: DataFrame, nodes_of: Callable[[str], tuple[list, list[tuple]]], columns: Sequence[str] | None) -> DataFrame:
    """Nodes of plans (plan_id, plan_text); nodes_of gives the indents and the values, from operation on, of a text's nodes."""
    wanted = [c for c in NODE if (c not in ASKED_FOR if columns is None else c in columns)]
    own = list(NODE)[4:-1]
    places = {c: own.index(c) for c in wanted if c in own}
    shape = any(c in wanted for c in ("parent_id", "depth", "path", *ASKED_FOR))
    kinds = [c for c in NODE if c not in own]

    def batch(ids: pa.Array, at: list[int], out: dict[str, list], values: list[tuple]) -> pa.RecordBatch:
        got = list(zip(*values))
        return pa.record_batch([ids.take(pa.array(at, pa.int32())), *[pa.array(got[places[c]] if c in places else out[c], NODE[c][1]) for c in wanted]], ["plan_id", *wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, values, out = b.column(0), [], [], {c: [] for c in kinds}
            for i, text in enumerate(b.column(1).to_pylist()):
                indents, nodes = nodes_of(text) if text else ((), ())
                if not nodes:
                    continue
                values += nodes
                at += [i] * len(nodes)
                out["node_id"] += range(len(nodes))
                if shape:
                    parents, depths, paths = tree(indents)
                    out["parent_id"] += parents
                    out["depth"] += depths
                    out["path"] += paths
                    below = [[] for _ in nodes]
                    for node, parent in zip(nodes[1:], parents[1:]):
                        below[parent].append(node[0])
                    out["child_operations"] += below
                if len(at) >= BATCH_NODES:
                    yield batch(ids, at, out, values)
                    at, values, out = [], [], {c: [] for c in out}
            if at:
                yield batch(ids, at, out, values)

    schema = StructType([plans.schema["plan_id"], *StructType.fromDDL(", ".join(f"{c} {NODE[c][0]}" for c in wanted)).fields])
    return plans.select("plan_id", "plan_text").mapInArrow(run, schema)


def _num(line: str, pattern: str, group: int, kind: str) -> str:
    p = pattern.replace("\\", "\\\\")
    return f"try_cast(nullif(regexp_extract({line}, '{p}', {group}), '') AS {kind})"


#: SQL over a line x: whether it is a node, and the operator it names.
IS_NODE = f"x RLIKE '{COST.replace(chr(92), chr(92) * 2)}' OR x RLIKE '{ACTUAL.replace(chr(92), chr(92) * 2)}' OR instr(x, '->') > 0 OR ltrim(x) RLIKE '^CTE [A-Za-z_]'"
OPERATION = "trim(regexp_replace(trim(split(regexp_replace(x, '^[ \\t|]*', ''), '\\\\(cost=|\\\\(actual|  \\\\(')[0]), '^->', ''))"


def parse_roots(plans: DataFrame) -> DataFrame:
    """plan_id, node_id, operation, total_cost, est_rows, actual_time, actual_rows of the root of each plan in text form.

    Only the first node's line is read, which parse_text() makes the root. Plans without a node give no row.
    """
    lines = F.filter(F.split("plan_text", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(IGNORED))
    root = barrier(plans.select("plan_id", lines.alias("lines"))).select("plan_id", F.expr(f"get(filter(lines, x -> {IS_NODE}), 0)").alias("x"))
    return barrier(root).filter("x IS NOT NULL").select(
        "plan_id", F.lit(0).alias("node_id"), F.expr(OPERATION).alias("operation"), F.expr(_num("x", COST, 2, "double")).alias("total_cost"), F.expr(_num("x", COST, 3, "bigint")).alias("est_rows"),
        F.expr(_num("x", ACTUAL, 2, "double")).alias("actual_time"), F.expr(_num("x", ACTUAL, 3, "bigint")).alias("actual_rows"),
    )


def _real(text: str | None) -> float | None:
    """A number as try_cast has it."""
    try:
        return float(text) if text else None
    except ValueError:
        return None


def _whole(text: str | None) -> int | None:
    n = int(text) if text and text.isdecimal() else None
    return n if n is not None and n < 1 << 63 else None


# as Java reads them: classes of ASCII
_COST, _ACTUAL, _IGNORED, _CTE, _MARGIN, _FIGURES = (re.compile(p, re.ASCII) for p in (COST, ACTUAL, IGNORED, r" *CTE [A-Za-z_]", r"[ \t|]*", r"\(cost=|\(actual|  \("))


def _text_nodes(text: str) -> tuple[list[int], list[tuple]]:
    indents, nodes, details = [], [], []
    lines = text.replace("\r\n", "\n").split("\n")
    for x in lines:
        line = x.strip(" ")
        if not line or _IGNORED.match(x):
            continue
        cost = _COST.search(x) if "(cost=" in x else None
        actual = _ACTUAL.search(x) if "(actual time=" in x else None
        arrow = x.find("->")
        if cost or actual or arrow >= 0 or _CTE.match(x):
            indents.append(-1 if not nodes else arrow if arrow >= 0 else x.find("CTE") if x.lstrip(" ").startswith("CTE") else _MARGIN.match(x).end())
            operation = _FIGURES.split(x.lstrip(" \t|"), maxsplit=1)[0].strip(" ").removeprefix("->").strip(" ")
            c = cost.groups() if cost else (None,) * 4
            a = actual.groups() if actual else (None,) * 4
            details = []
            nodes.append((operation, _real(c[0]), _real(c[1]), _whole(c[2]), _whole(c[3]), _real(a[1]), _whole(a[2]), _whole(a[3]), details, None))
        elif nodes:
            details.append(line)
    return indents, [(*n[:8], "\n".join(n[8]), None) for n in nodes]


def parse_text(plans: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nodes of plans in text form; plans: plan_id, plan_text. columns: those wanted besides plan_id, all by default.

    A node is a line with a cost, actual figures or an arrow, or a CTE heading. Other lines are details of the
    node before them; statements, comments, headings and footers are skipped. Plans without a node, nulls
    included, give no row.
    """
    return _parsed(plans, _text_nodes, columns)


_PREDICATES, _ROW, _PREDICATE, _NUMBER, _LOW = (re.compile(p, re.ASCII) for p in (r"(?i)Predicate Information \(identified by plan id\)", r"\s*[0-9]+\s*[|]", r"\s*([0-9]+)\s*--", r"([0-9]+(?:[.][0-9]+)?)[^0-9.]*$", r"([0-9.]+)[.][.]"))
_HEADER = "id | operation | a-time | a-rows | e-rows | e-width | e-costs"


def _tabular_nodes(text: str) -> tuple[list[int | None], list[tuple]]:
    parts = [p.replace("\r\n", "\n").split("\n") for p in _PREDICATES.split(text)]
    header = [h.strip(" ") for h in next((x for x in parts[0] if "|" in x and "operation" in x.lower()), _HEADER).lower().split("|")]
    place = {}
    for i, h in enumerate(header):
        place.setdefault(h, i)
    # of sections with one id the last counts
    details, lines = {}, None
    for y in parts[1] if len(parts) > 1 else ():
        if m := _PREDICATE.match(y):
            details[m[1]] = lines = []
        if lines is not None:
            lines.append(y.strip(" "))

    def cell(c: list[str], *names: str) -> str | None:
        return next((c[place[n]].strip(" ") for n in names if n in place and place[n] < len(c)), None)

    def last(x: str | None) -> str | None:
        m = _NUMBER.search(x.replace(",", "")) if x else None
        return m[1] if m else None

    indents, nodes = [], []
    at = max(place.get("operation", -1), 1)
    for x in parts[0]:
        if not _ROW.match(x):
            continue
        c = x.split("|")
        op = c[at] if at < len(c) else None
        arrow = op.find("->") if op is not None else -1
        indents.append(-1 if not nodes else None if op is None else arrow if arrow >= 0 else len(op) - len(op.lstrip(" ")))
        cost = cell(c, "e-costs", "e-cost", "cost")
        low = _LOW.search(cost) if cost else None
        key = c[0].strip(" ")
        nodes.append((
            op.strip(" ").removeprefix("->").strip(" ") if op is not None else None, _real(low[1] if low else None), _real(last(cost)), _whole(last(cell(c, "e-rows"))), _whole(last(cell(c, "e-width"))),
            _real(last(cell(c, "a-time"))), _whole(last(cell(c, "a-rows"))), None, "\n".join(details.get(key, ())), key,
        ))
    return indents, nodes


def parse_tabular(plans: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nodes of plans in tabular form; the header names the columns, so tables with and without actual figures are read alike.

    The predicate section's lines become the details of the node with their id; where an id stands twice there, the last counts.
    columns: those wanted besides plan_id, all by default.
    """
    return _parsed(plans, _tabular_nodes, columns)


def parse_plans(plans: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nodes of plans in any of the three forms. columns: those wanted besides plan_id, all by default."""
    kind = plan_format(F.col("plan_text"))
    only = lambda k: plans.filter(kind == k)
    json = parse_json(only("json"))
    return parse_text(only("text"), columns).unionByName(parse_tabular(only("tabular"), columns)).unionByName(json.select("plan_id", *columns) if columns else json)


def split_sql_and_plan(texts: DataFrame) -> DataFrame:
    """plan_id, sql_text and plan_text of texts that hold a statement and then its plan."""
    lines = F.split("plan_text", "\r?\n")
    first = F.expr(r"coalesce(array_min(filter(transform(lines, (x, i) -> CASE WHEN x RLIKE '(?i)QUERY PLAN|\\(cost=|^\\s*->|^\\s*\\d+ \\||operation\\s*\\|' THEN i END), z -> z IS NOT NULL)), size(lines))")
    out = barrier(barrier(texts.select("plan_id", lines.alias("lines"))).withColumn("cut", first))
    sql = F.expr(r"trim(regexp_replace(array_join(filter(slice(lines, 1, cut), x -> NOT x RLIKE '^\\s*-+\\s*$'), '\n'), '(?i)^\\s*(gaussdb=#)?\\s*(explain\\s*(\\([^)]*\\)|analyze|performance|verbose)?)?\\s*', ''))")
    return out.select("plan_id", sql.alias("sql_text"), F.expr("array_join(slice(lines, cut + 1, size(lines)), '\n')").alias("plan_text"))


#: Lines that separate two plans, in the order in which they are tried.
SEPARATORS = ("^-{10,}$", "^={10,}$", "(?i)^Plan *2:?$", "(?i)^Optimized *Plan:?$")


def split_two(texts: DataFrame) -> DataFrame:
    """plan_id, left_text, right_text: one text cut into two plans, the second empty if there is none. Null counts as empty.

    The first rule that finds two plans cuts: before the second EXPLAIN; before the second table header; before the
    first root that stands more than ten lines after the first root, with all from the first blank or comment line
    between them on (a lone hyphen ends the search); at separator lines, of which the first kind with two parts of over 20 characters decides.
    """
    lines = F.split(F.coalesce("plan_text", F.lit("")), "\n")
    at = lambda p: rf"filter(transform(lines, (x, i) -> CASE WHEN x RLIKE '{p}' THEN i END), z -> z IS NOT NULL)"
    found = {"e": at(r"(?i)^\\s*explain\\s+"), "h": at(r"(?i)id\\s*[|]\\s*operation"), "r": at(r"^\\s{0,2}[a-zA-Z].+[(](cost|actual time)=|^\\s*1\\s*[|]")}
    out = barrier(barrier(texts.select("plan_id", lines.alias("lines"))).withColumns({k: F.expr(v) for k, v in found.items()}))
    out = barrier(out.withColumn("root", F.expr("get(filter(r, z -> z > get(r, 0) + 10), 0)")))
    # the last lone hyphen between the roots, and the first of the blank and comment lines after it
    ruler = "coalesce(array_max(filter(transform(slice(lines, 1, root), (x, i) -> CASE WHEN i > get(r, 0) AND trim(x) RLIKE '^-+$' AND NOT startswith(trim(x), '--') THEN i END), z -> z IS NOT NULL)), get(r, 0))"
    out = barrier(out.withColumn("ruler", F.expr(ruler)))
    back = "coalesce(array_min(filter(transform(slice(lines, 1, root), (x, i) -> CASE WHEN i > ruler AND (trim(x) = '' OR startswith(trim(x), 'set explain') OR startswith(trim(x), '--')) THEN i END), z -> z IS NOT NULL)), root)"
    out = barrier(out.withColumn("cut", F.expr(f"coalesce(get(e, 1), get(h, 1), {back})")))
    text = lambda a, n: rf"trim(BOTH ' \t\r\n' FROM array_join(slice(lines, {a}, {n}), '\n'))"
    ends = lambda p: f"concat(array(-1), {at(p)}, array(size(lines)))"
    pieces = [f"filter(transform(slice({ends(p)}, 2, size(lines) + 1), (b, k) -> {text(f'get({ends(p)}, k) + 2', f'b - get({ends(p)}, k) - 1')}), t -> length(t) > 20)" for p in SEPARATORS]
    out = barrier(out.withColumn("pieces", F.when(F.col("cut").isNull(), F.expr(f"get(filter(array({', '.join(pieces)}), p -> size(p) > 1), 0)"))))
    left, right = F.expr(text("1", "cut")), F.expr(text("cut + 1", "size(lines)"))
    by_line = F.col("cut").isNotNull()
    return out.select(
        "plan_id",
        F.when(by_line, left).when(F.col("pieces").isNotNull(), F.get("pieces", F.lit(0))).otherwise(F.array_join("lines", "\n")).alias("left_text"),
        F.when(by_line, right).when(F.col("pieces").isNotNull(), F.get("pieces", F.lit(1))).otherwise(F.lit("")).alias("right_text"),
    )


def text_of(nodes: DataFrame) -> DataFrame:
    """plan_id, plan_text: text form of plan nodes (plan_id, node_id, depth, operation, total_cost, est_rows, width, actual_time, actual_rows, detail)."""
    arrow = F.when(F.col("node_id") == 0, F.lit("")).otherwise(F.concat(F.expr("repeat(' ', depth * 6 - 4)"), F.lit("->  ")))
    line = F.concat(
        arrow, "operation", F.lit("  (cost=0.00.."), F.col("total_cost").cast("decimal(20,2)").cast("string"), F.lit(" rows="), F.col("est_rows").cast("string"), F.lit(" width="), F.col("width").cast("string"), F.lit(")"),
        F.lit(" (actual time=0.010.."), F.col("actual_time").cast("decimal(20,3)").cast("string"), F.lit(" rows="), F.col("actual_rows").cast("string"), F.lit(" loops=1)"),
        F.when(F.col("detail").isNotNull(), F.concat(F.lit("\n"), F.expr("repeat(' ', depth * 6 + 2)"), "detail")).otherwise(F.lit("")),
    )
    return nodes.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))).alias("l")).select("plan_id", F.array_join(F.expr("transform(l, x -> x.line)"), "\n").alias("plan_text"))
