"""Parsers with results of their own beside those of parse.py: core text, core tables and diff input.

Each gives a relation of nodes. Trees are folded over the array of a plan's lines by a stack: an entry stays while its
indent is smaller than the line's, so what remains are the line's ancestors, and the last of them is its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.parse import barrier

FOLD = (
    "aggregate(nodes, named_struct('stack', cast(array() AS array<struct<indent: int, at: int>>), 'parents', cast(array() AS array<int>), 'depths', cast(array() AS array<int>)),"
    " (a, n) -> transform(array(filter(a.stack, s -> s.indent < n.indent)), up -> named_struct('stack', array_append(up, named_struct('indent', n.indent, 'at', size(a.parents))),"
    " 'parents', array_append(a.parents, CASE WHEN size(up) > 0 THEN element_at(up, -1).at WHEN size(a.parents) > 0 THEN 0 END), 'depths', array_append(a.depths, CASE WHEN size(up) > 0 THEN size(up) WHEN size(a.parents) > 0 THEN 1 ELSE 0 END)))[0])"
)


def fold_tree(plans: DataFrame, fields: list[str]) -> DataFrame:
    """plan_id, node_id, parent_id, depth and fields of the elements of nodes, which have an indent (the first one's is least).

    A line without a smaller indent before it hangs on the first one. Plans without nodes give no row.
    """
    folded = barrier(plans.filter(F.size("nodes") > 0).select("plan_id", "nodes").withColumn("t", F.expr(FOLD)))
    rows = folded.select("plan_id", F.expr("posexplode(arrays_zip(nodes, t.parents, t.depths))").alias("node_id", "z"))
    return rows.select("plan_id", "node_id", F.col("z.parents").alias("parent_id"), F.col("z.depths").alias("depth"), *[F.col(f"z.nodes.{c}").alias(c) for c in fields])


def _cut(x: str, pattern: str) -> str:
    """SQL: group 1 of a pattern in x, null where it isn't found."""
    p = pattern.replace("\\", "\\\\")
    return f"CASE WHEN {x} RLIKE '{p}' THEN regexp_extract({x}, '{p}', 1) END"


# ---- core text form

CORE_FIELDS = ["operation", "total_cost", "est_rows", "actual_rows", "table_name", "index_name", "filter", "join_type", "hash_keys", "buffers", "output"]
#: What marks a statement, and what marks its plan, in the first 20 lines of a text.
STATEMENT = "^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|WITH) "
PLAN_WORDS = "QUERY PLAN|HASH JOIN|SEQ SCAN|INDEX SCAN|NESTED LOOP|STREAMING|RETRIEVE|HASH COND|SPAWN ON|^->"
PLAN_START = "QUERY PLAN|STREAMING|^->|HASH JOIN|SEQ SCAN|INDEX SCAN"
PROMPT = "GAUSSDB=#"


def core_node(x: str, indent: str) -> str:
    """SQL: the node of a trimmed line x. Its operator ends at ' on ', else at ' using ', else after one word."""
    before = f"split_part({x}, ' (cost=', 1)"
    operation = f"CASE WHEN instr({x}, ' (cost=') = 0 THEN split_part({x}, ' ', 1) WHEN instr({before}, ' on ') > 0 THEN split_part({before}, ' on ', 1) WHEN instr({before}, ' using ') > 0 THEN split_part({before}, ' using ', 1) ELSE split_part({before}, ' ', 1) END"
    cost = f"coalesce(try_cast(CASE WHEN {x} RLIKE 'cost=[0-9.]*?[.][.]' THEN regexp_extract({x}, 'cost=[0-9.]*?[.][.]([0-9.]*)', 1) ELSE regexp_extract({x}, 'cost=([0-9.]*)', 1) END AS double), 0D)"
    joins = "CASE " + " ".join(f"WHEN instr({x}, '{j}') > 0 THEN '{j}'" for j in ("Hash Join", "Merge Join", "Nested Loop")) + " END"
    table = f"CASE WHEN instr({x}, ' on ') > 0 THEN regexp_extract({x}, ' on ([^ (]*)', 1) WHEN instr({x}, ' Scan ') > 0 THEN regexp_extract({x}, ' Scan ([^ (]*)', 1) END"
    found = {
        "indent": indent, "operation": operation, "total_cost": cost, "est_rows": f"coalesce(try_cast(regexp_extract({x}, 'rows=([0-9]*)', 1) AS bigint), 0L)", "actual_rows": f"try_cast({_cut(x, 'actual rows=([0-9]+)')} AS bigint)",
        "table_name": table, "index_name": _cut(x, " using ([^ (]*)"), "filter": f"trim({_cut(x, ' Filter: ([^)]*)')})", "join_type": joins, "hash_keys": f"trim({_cut(x, ' Hash Cond: ([^)]*)')})", "buffers": f"trim({_cut(x, ' Buffers: ([^)]*)')})", "output": "cast(NULL AS string)",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in found.items()) + ")"


def _core_lines(plans: DataFrame) -> DataFrame:
    """plan_id, lines, upper (trimmed, upper-cased) and statement: whether the first 20 lines hold a statement and a plan."""
    lines = plans.select("plan_id", F.split(F.regexp_replace("plan_text", "\r?\n$", ""), "\r?\n").alias("lines"))
    upper = barrier(lines.withColumn("upper", F.expr("transform(lines, x -> upper(trim(x)))"))).withColumn("head", F.expr("slice(upper, 1, 20)"))
    asked = f"exists(transform(head, (u, i) -> contains(u, 'EXPLAIN') AND exists(slice(head, 1, i + 1), p -> startswith(p, '{PROMPT}'))), q -> q)"
    return barrier(upper.withColumn("statement", F.expr(f"(exists(head, u -> u RLIKE '{STATEMENT}') OR {asked}) AND exists(head, u -> u RLIKE '{PLAN_WORDS}')")).drop("head"))


def _is_table() -> Column:
    return F.expr("exists(lines, x -> startswith(trim(x), 'id |') OR contains(x, '| E-rows |') OR startswith(trim(x), '----+'))")


def parse_core_text(plans: DataFrame) -> DataFrame:
    """Nodes of plans (plan_id, plan_text) by the core text parser.

    The first line is the root, and each line indented by two or more blanks after it is a node, details included; the
    plan ends at the first line that isn't. Text that holds a statement too gives a SQL+PLAN node over its first plan
    line (lines lose their indent there), with the statement as output. Tables are left to parse_core_tabular. Texts
    whose first line is blank, or without a plan line after the statement, give no row; so do nulls.
    """
    known = _core_lines(plans)
    depth = "length(x) - length(ltrim(x))"
    plain = known.filter(~F.col("statement") & (F.trim(F.col("lines")[0]) != ""))
    plain = plain.withColumn("rest", F.expr(f"filter(transform(slice(lines, 2, size(lines)), x -> named_struct('line', trim(x), 'indent', {depth})), r -> r.line != '')"))
    ended = F.expr("coalesce(array_position(transform(rest, r -> r.indent <= 1), true), 0L)")
    plain = barrier(barrier(plain).withColumn("n", F.when(ended == 0, F.size("rest")).otherwise(ended - 1).cast("int")))
    nodes = f"concat(array({core_node('trim(lines[0])', '-1')}), transform(slice(rest, 1, n), r -> {core_node('r.line', 'r.indent')}))"
    both = known.filter(F.col("statement") & ~_is_table())
    first = lambda cond, after="-1": f"array_min(filter(transform(upper, (u, i) -> CASE WHEN i > {after} AND ({cond}) THEN i END), i -> i IS NOT NULL))"
    ends = f"coalesce({first(f'''(startswith(u, '{PROMPT}') AND contains(u, 'EXPLAIN')) OR startswith(u, 'EXPLAIN') OR (contains(u, 'EXPLAIN') AND endswith(u, ';'))''')}, {first('''endswith(u, ';') AND u RLIKE '^(SELECT|INSERT|UPDATE|DELETE) ' ''')}, 0)"
    both = barrier(both.withColumn("at", F.expr(ends)))
    both = barrier(both.withColumn("start", F.expr(first(f"u RLIKE '{PLAN_START}' AND u RLIKE '[^-]'", "at"))))
    both = barrier(both.withColumn("begin", F.expr(f"CASE WHEN contains(upper[start], 'QUERY PLAN') THEN {first('''u != '' AND u RLIKE '[^-]' ''', 'start')} ELSE start END"))).filter("begin IS NOT NULL")
    child = barrier(both.select("plan_id", F.expr("concat('SQL: ', trim(replace(trim(lines[at]), 'gaussdb=# ', '')))").alias("sql"), F.expr(core_node("trim(lines[begin])", "0")).alias("node")))
    wrapped = child.select("plan_id", F.array(F.col("node").withField("indent", F.lit(-1)).withField("operation", F.lit("SQL+PLAN")).withField("output", F.col("sql")), F.col("node")).alias("nodes"))
    return fold_tree(plain.select("plan_id", F.expr(nodes).alias("nodes")).unionByName(wrapped), CORE_FIELDS)


def parse_core_tabular(plans: DataFrame) -> DataFrame:
    """Nodes of tables behind a statement (plan_id, plan_text) by the core parser: a SQL+PLAN node, the first row, and the others below that.

    Cells count by place: rows is the fourth cell of a line and the cost the sixth, whatever the header says; the rows
    of the SQL+PLAN node are the third cell of the first line. Lines of the predicate section, prompts, SET and those
    that begin with a bracket are passed over. Texts of another form give no row.
    """
    known = _core_lines(plans).filter(F.col("statement")).filter(_is_table())
    state = (
        f"aggregate(arrays_zip(lines, upper), named_struct('off', false, 'kept', cast(array() AS array<string>), 'sql', ''), (a, z) -> CASE WHEN startswith(z.upper, '{PROMPT}') AND contains(z.upper, 'EXPLAIN') THEN named_struct('off', a.off, 'kept', a.kept, 'sql', trim(replace(trim(z.lines), 'gaussdb=# ', '')))"
        " WHEN startswith(z.upper, 'ID |') OR startswith(z.upper, '----+') THEN named_struct('off', false, 'kept', a.kept, 'sql', a.sql) WHEN startswith(z.upper, 'PREDICATE INFORMATION') OR startswith(z.upper, '----') THEN named_struct('off', true, 'kept', a.kept, 'sql', a.sql)"
        " WHEN NOT a.off AND z.upper != '' AND NOT startswith(z.upper, '(') AND NOT startswith(z.upper, 'SET') THEN named_struct('off', a.off, 'kept', array_append(a.kept, trim(z.lines)), 'sql', a.sql) ELSE a END)"
    )
    read = barrier(known.withColumn("s", F.expr(state)))
    cells = "transform(filter(s.kept, x -> trim(split(x, '[|]')[0]) RLIKE '^[+-]?[0-9]{1,9}$' AND size(split(x, '[|]')) > 2), x -> split(x, '[|]'))"
    read = barrier(read.withColumn("rows", F.expr(cells))).filter(F.size("rows") > 0)
    whole = lambda c, i: f"coalesce(CASE WHEN trim(get({c}, {i})) RLIKE '^[+]?[0-9]+$' THEN try_cast(trim(get({c}, {i})) AS bigint) END, 0L)"
    op = "trim(regexp_replace(trim(c[1]), '^->', ''))"
    operation = f"CASE WHEN instr({op}, '(') > 0 THEN trim(split_part({op}, '(', 1)) ELSE split_part({op}, ' ', 1) END"
    none = "cast(NULL AS string)"
    table = f"nullif(CASE WHEN instr({op}, ' on ') > 0 THEN trim(element_at(split({op}, ' on '), -1)) END, '')"
    node = lambda indent, operation, cost, rows, table, output: f"named_struct('indent', {indent}, 'operation', {operation}, 'total_cost', {cost}, 'est_rows', {rows}, 'actual_rows', cast(NULL AS bigint), 'table_name', {table}, 'index_name', {none}, 'filter', {none}, 'join_type', {none}, 'hash_keys', {none}, 'buffers', {none}, 'output', {output})"
    cost = "coalesce(try_cast(trim(get(c, 5)) AS double), 0D)"
    nodes = f"transform(rows, (c, k) -> {node('CASE WHEN k = 0 THEN 0 ELSE 1 END', operation, cost, whole('c', 3), table, 'trim(c[1])')})"
    top = node("-1", "'SQL+PLAN'", "found[0].total_cost", whole("split(s.kept[0], '[|]')", 2), "found[0].table_name", "concat('SQL: ', trim(regexp_replace(s.sql, ';$', '')))")
    found = barrier(read.withColumn("found", F.expr(nodes)))
    return fold_tree(found.select("plan_id", F.expr(f"concat(array({top}), found)").alias("nodes")), CORE_FIELDS)


# ---- diff input

DIFF_FIELDS = ["ext_id", "operation", "total_cost", "est_rows", "actual_time", "actual_rows"]
#: Lines that are no part of a plan.
DIFF_NOISE = r"(?i)^\s*((set|explain|select|insert|update|delete|create|drop) |--|-+\s*$)"


def parse_diff(plans: DataFrame) -> DataFrame:
    """Nodes of plans (plan_id, plan_text) as the diff reads them: statements, settings, comments and rules are passed over.

    Text lines count if they have a cost, an actual time or an arrow, and operators end at the first bracket. Rows of
    tables count if their id is a number; cells count by place, [a,b] is b, and the cost is the last cell. Texts
    without nodes give no row.
    """
    noise = DIFF_NOISE.replace("\\", "\\\\")
    tabular = F.col("plan_text").contains("|") & (F.col("plan_text").contains("operation") | F.col("plan_text").rlike(r"(?m)^\s*\d+\s*\|"))
    lines = plans.select("plan_id", tabular.alias("tabular"), F.expr(f"filter(split(plan_text, '\n'), x -> trim(x) RLIKE '[^\\\\s]' AND NOT x RLIKE '{noise}')").alias("lines"))
    number = lambda x: f"try_cast(regexp_extract({x}, '^\\\\s*([+-]?[0-9]+(?:[.][0-9]*)?)', 1) AS double)"
    cell = lambda i: f"CASE WHEN startswith(trim(get(c, {i})), '[') THEN {number(f'''coalesce(get(split(translate(get(c, {i}), '[]', ''), ','), 1), translate(get(c, {i}), '[]', ''))''')} ELSE {number(f'get(c, {i})')} END"
    last = "get(c, size(c) - 1)"
    cost = f"coalesce(try_cast(nullif(regexp_extract({last}, '([0-9.]+)[.][.]([0-9.]+)', 2), '') AS double), {cell('size(c) - 1')})"
    indent = lambda x: f"CASE WHEN instr({x}, '->') > 0 THEN instr({x}, '->') - 1 ELSE length({x}) - length(ltrim({x})) END"
    row = f"named_struct('indent', CASE WHEN k = 0 THEN -1 ELSE {indent('c[1]')} END, 'ext_id', trim(c[0]), 'operation', trim(regexp_replace(trim(c[1]), '^->', '')), 'total_cost', {cost}, 'est_rows', CASE WHEN size(c) > 4 THEN cast({cell(4)} AS bigint) ELSE 0L END, 'actual_time', CASE WHEN size(c) > 2 THEN {cell(2)} END, 'actual_rows', CASE WHEN size(c) > 3 THEN cast({cell(3)} AS bigint) END)"
    rows = f"transform(filter(transform(filter(lines, x -> NOT startswith(x, '---')), x -> split(x, '[|]')), c -> size(c) > 1 AND trim(c[0]) RLIKE '^[0-9]+$'), (c, k) -> {row})"
    operation = "trim(regexp_replace(trim(split_part(regexp_replace(x, '^[\\\\s|]*', ''), '(', 1)), '^->', ''))"
    is_node = f"(x RLIKE '[(]cost=[0-9.]+[.][.][0-9.]+' OR x RLIKE '[(]actual time=[0-9.]+[.][.][0-9.]+' OR instr(x, '->') > 0) AND {operation} != ''"
    depth = "CASE WHEN instr(x, '->') > 0 THEN instr(x, '->') - 1 ELSE length(regexp_extract(x, '^[\\\\s|]*', 0)) END"
    line = (
        f"named_struct('indent', CASE WHEN k = 0 THEN -1 ELSE {depth} END, 'ext_id', cast(NULL AS string), 'operation', {operation}, 'total_cost', coalesce(try_cast({_cut('x', '[(]cost=[0-9.]+?[.][.]([0-9.]+)')} AS double), 0D), 'est_rows', coalesce(try_cast({_cut('x', 'rows=([0-9]+)')} AS bigint), 0L),"
        f" 'actual_time', try_cast({_cut('x', '[(]actual time=[0-9.]+?[.][.]([0-9.]+)')} AS double), 'actual_rows', try_cast({_cut('x', 'rows=([0-9]+)[ ]+loops=')} AS bigint))"
    )
    text = f"transform(filter(lines, x -> {is_node}), (x, k) -> {line})"
    known = barrier(lines)
    return fold_tree(known.filter("tabular").select("plan_id", F.expr(rows).alias("nodes")).unionByName(known.filter("NOT tabular").select("plan_id", F.expr(text).alias("nodes"))), DIFF_FIELDS)
