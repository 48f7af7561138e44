"""Scalar functions of the engine as Column expressions; none of them needs Python at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CI = "(?i)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num_commas(x: Column | str, kind: str = "double") -> Column:
    """A number with thousands separators; 0 where it is none. As a long, a text with a fraction is none."""
    return F.coalesce(F.replace(F.trim(_c(x)), F.lit(","), F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def num_pct(x: Column | str) -> Column:
    """The number that a text starts with, without separators and per-cent sign; 0 where there is none."""
    plain = F.replace(F.replace(_c(x), F.lit(","), F.lit("")), F.lit("%"), F.lit(""))
    return F.coalesce(F.regexp_extract(plain, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def num_range(x: Column | str) -> Column:
    """The upper end of [a,b], the value of [a] or of a plain number; 0 for null and empty texts, null for other texts."""
    s = F.trim(_c(x))
    inner = F.split(F.translate(s, "[]", ""), ",")
    text = F.when(s.startswith("["), F.when(F.size(inner) > 1, inner[1]).otherwise(inner[0])).otherwise(s)
    number = F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(_c(x).isNull() | (_c(x) == ""), F.lit(0.0)).otherwise(number)


def normalised_sql(x: Column | str) -> Column:
    """Upper case, runs of white space squeezed to one space."""
    return F.upper(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))


def fingerprint(x: Column | str) -> Column:
    """Hash of the normalised statement; equal for statements that differ in case and white space alone."""
    return F.md5(normalised_sql(x))


def pct_change(source: Column | str, target: Column | str) -> Column:
    """Change from source to target in per cent; null if source is 0."""
    s, t = _c(source).cast("double"), _c(target).cast("double")
    return F.when(s != 0, (t - s) / s * 100)


def delta_percent(base: Column | str, value: Column | str) -> Column:
    """Change in per cent; 0 from a base of 0, null if both are 0."""
    b, v = _c(base).cast("double"), _c(value).cast("double")
    return F.when((b == 0) & (v == 0), F.lit(None)).when(b == 0, F.lit(0.0)).otherwise((v - b) / F.nullif(b, F.lit(0.0)) * 100)


def delta_is_bad(base: Column | str, value: Column | str, reverse: bool = False) -> Column:
    """Whether a change is for the worse; reverse: less is worse."""
    d = _c(value) - _c(base)
    return d < 0 if reverse else d > 0


def metric_card_percent(base: Column | str, value: Column | str) -> Column:
    """Change in per cent, 0 unless the base is positive."""
    b, v = _c(base).cast("double"), _c(value).cast("double")
    return F.when(b > 0, (v - b) / F.nullif(b, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


#: Weights of the performance score.
SCORE_WEIGHTS = {"sql_elapsed_time": 0.35, "sql_cpu_time": 0.25, "sql_io_time": 0.15, "buffer_hit_ratio": 0.10, "disk_reads": 0.10, "executions": 0.05}


def performance_score(changes: dict[str, Column]) -> Column:
    """Weighted mean of changes by metric name, from -100 to 100, cut to an integer; 0 without any change.

    Changes of times and reads count with their sign turned. A null change is a metric that is not there.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SCORE_WEIGHTS.items():
        if name in changes:
            x = -changes[name] if "time" in name or "reads" in name else changes[name]
            total = total + F.coalesce(x * w, F.lit(0.0))
            weight = weight + F.when(changes[name].isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(weight == 0, F.lit(0)).otherwise(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), total / F.nullif(weight, F.lit(0.0)))).cast("int"))


def score_status(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 15, "Improved").when(s <= -15, "Degraded").otherwise("NoSignificantChange")


def conclusion(score: Column | str, findings: Column | str) -> Column:
    s, n = _c(score), _c(findings).cast("string")
    return (
        F.when(s >= 15, F.concat(F.lit("Performance improved by "), s.cast("string"), F.lit(" points with "), n, F.lit(" significant changes")))
        .when(s <= -15, F.concat(F.lit("Performance degraded by "), F.abs(s).cast("string"), F.lit(" points with "), n, F.lit(" significant changes")))
        .otherwise(F.concat(F.lit("Performance remained stable with "), n, F.lit(" notable changes")))
    )


def comparison_type(source_instance: Column | str, target_instance: Column | str) -> Column:
    return F.when(_c(source_instance) == _c(target_instance), "TimeBased").otherwise("InstanceBased")


def finding_severity(change: Column | str, least: float, critical: float, warning: float | None = None) -> Column:
    """Severity of a change by its size; null below `least`."""
    a = F.abs(_c(change))
    other = F.when(a >= warning, "Warning").otherwise("Info") if warning is not None else F.lit("Warning")
    return F.when(a >= least, F.when(a >= critical, "Critical").otherwise(other))


def duration_s(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end, 1 where that is not positive or unknown."""
    d = (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / 1e6
    return F.when(d > 0, d).otherwise(F.lit(1.0))


def per_second(calls: Column | str, seconds: Column | str) -> Column:
    return F.coalesce(_c(calls) / F.nullif(_c(seconds), F.lit(0.0)), F.lit(0.0))


def avg_time(total: Column | str, calls: Column | str) -> Column:
    """total / calls, 0 without calls."""
    return F.when(_c(calls) > 0, _c(total) / F.nullif(_c(calls), F.lit(0))).otherwise(F.lit(0.0)).cast("double")


def gauge_target(value: Column | str, target: Column | str) -> Column:
    v, t = _c(value), _c(target)
    return F.when(v >= t, "healthy").when(v >= t * 0.9, "warning").otherwise("bad")


def gauge_fixed(value: Column | str) -> Column:
    v = _c(value)
    return F.when(v >= 90, "good").when(v >= 70, "warn").otherwise("bad")


def plan_score(warnings: Column | str, over_limits: Column | int = 0) -> Column:
    """100 less 5 for each warning and 10 for each limit that is passed, from 0 to 100."""
    over = over_limits if isinstance(over_limits, Column) else F.lit(over_limits)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - _c(warnings).cast("int") * 5 - over * 10))


def plan_potential(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 80, "Low - Minor optimizations may be available").when(s >= 50, "Medium - Some optimization opportunities possible").otherwise("High - Multiple optimization areas identified (requires execution plan for accuracy)")


def plan_improvement(score: Column | str) -> Column:
    """Estimated improvement in per cent, by integer division; null for scores of 80 or more."""
    s = _c(score).cast("long")
    third, quarter = F.floor((80 - s) / 3), F.floor((80 - s) / 4)
    return F.when(s < 50, (15 + third).cast("long")).when(s < 80, (5 + quarter).cast("long"))


def warning_severity(text: Column | str) -> Column:
    t = _c(text)
    return F.when(t.contains("Critical") | t.contains("High"), "Critical").when(t.contains("may") | t.contains("consider"), "Medium").otherwise("Low")


#: Words that place a warning in an issue class, first match wins.
ISSUE_WORDS = ((("scan", "Scan"), "FullTableScan"), (("index", "Index"), "MissingIndex"), (("join", "Join"), "InefficientJoin"), (("sort", "Sort"), "SortOperation"), (("statistics", "ANALYZE"), "MissingStatistics"))


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def classify_issue(text: Column | str) -> Column:
    t = _c(text)
    return first_match([(t.contains(a) | t.contains(b), name) for (a, b), name in ISSUE_WORDS], "MissingIndex")


def recommendation_priority(text: Column | str) -> Column:
    t = _c(text)
    return F.when(t.contains("index") | t.contains("Index"), "High").otherwise("Medium")


EXPLAIN_PREFIX = CI + r"^EXPLAIN\s*(\((?:[^()]*)\)|ANALYZE\s+VERBOSE|ANALYZE|PERFORMANCE|VERBOSE)?\s*"


def strip_explain(sql: Column | str) -> Column:
    """A statement without its EXPLAIN prefix and closing semicolon."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(sql)), EXPLAIN_PREFIX, ""), r"\s*;\s*$", ""))


def make_explain(sql: Column | str, analyze: bool = False) -> Column:
    return F.concat(F.lit("EXPLAIN ANALYZE " if analyze else "EXPLAIN (FORMAT JSON) "), F.regexp_replace(F.trim(_c(sql)), r";+$", ""))


def table_names(sql: Column | str) -> Column:
    """Tables after the first FROM and after every JOIN, in order, repeats in a row dropped."""
    name = r"([A-Za-z_][A-Za-z0-9_.$]*)"
    first = F.regexp_extract(_c(sql), CI + r"\bFROM\s+\(?\s*" + name, 1)
    joined = F.regexp_extract_all(_c(sql), F.lit(CI + r"\bJOIN\s+\(?\s*" + name), 1)
    return dedup_consecutive(F.filter(F.concat(F.array(first), joined), lambda x: x != ""))


def dedup_consecutive(xs: Column) -> Column:
    """An array without elements that equal the one before them."""
    return F.filter(xs, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(xs, i - 1)))


#: Words that a statement may start with.
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "WITH", "EXPLAIN")


def validate_sql(sql: Column | str) -> Column:
    """Why a statement is not valid, or null: empty, unbalanced parentheses, a semicolon inside, unknown first word."""
    s = F.trim(F.coalesce(_c(sql), F.lit("")))
    bare = F.regexp_replace(s, r"'[^']*'|\"[^\"]*\"", "")
    parens = F.regexp_replace(bare, r"[^()]", "")
    depth = F.aggregate(F.filter(F.split(parens, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, c: F.struct((a["at"] + F.when(c == "(", 1).otherwise(-1)).alias("at"), F.least(a["low"], a["at"] + F.when(c == "(", 1).otherwise(-1)).alias("low")))
    return (
        F.when(s == "", "empty statement")
        .when((depth["at"] != 0) | (depth["low"] < 0), "unbalanced parentheses")
        .when(F.regexp_replace(bare, r";\s*$", "").contains(";"), "semicolon inside the statement")
        .when(~F.upper(F.regexp_extract(s, r"^\(*\s*([A-Za-z]+)", 1)).isin(*STATEMENTS), "unknown statement")
    )


def detect_sql_with_plan(text: Column | str) -> Column:
    """Whether the first 20 lines hold both a statement and a plan."""
    head = F.slice(F.split(_c(text), "\n"), 1, 20)
    sql = F.exists(head, lambda line: F.trim(line).rlike(CI + r"^(SELECT|INSERT|UPDATE|DELETE|WITH|MERGE)\b"))
    plan = F.exists(head, lambda line: line.rlike(CI + r"QUERY PLAN|->\s|\(cost=|Streaming|Seq Scan|Index Scan|Hash Join|Nested Loop"))
    return sql & plan


#: Words of optimiser hints by class.
HINTS = {
    "hintLeading": r"leading",
    "hintJoinMethod": r"nestloop|hashjoin|mergejoin|nestloop_index",
    "hintRows": r"rows",
    "hintScan": r"tablescan|indexscan|indexonlyscan|bitmapscan",
    "hintStream": r"broadcast|redistribute",
    "hintBlock": r"blockname",
    "hintOther": r"no_expand|no_gpc|predpush|wlmrule|use_cplan|use_gplan|material_subplan|materialize_inner|use_hash_agg|use_sort_agg",
}


def hints(sql: Column | str) -> Column:
    """Classes of the optimiser hints in a statement's hint comments."""
    text = F.lower(F.array_join(F.regexp_extract_all(_c(sql), F.lit(r"(?s)/\*\+\s*(.*?)\s*\*/"), 1), "\n"))
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in HINTS.items()]))


def normalize_op(op: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(op), r"^->", ""), r"\(\d+(,\d+)*\)", ""), r"\s+", " ")))


def extract_target(op: Column | str) -> Column:
    """The object after " on ", lower-cased, or null."""
    return F.nullif(F.lower(F.regexp_extract(_c(op), CI + r"\s+on\s+([^\s()]+)", 1)), F.lit(""))


def node_type(op: Column | str) -> Column:
    o = F.lower(_c(op))
    return F.when(o.contains("scan"), "Scan").when(o.contains("join") | o.contains("loop"), "Join").when(o.contains("sort"), "Sort").when(o.contains("agg") | o.contains("group"), "Agg").otherwise("Other")


#: Words that lead from an operator to its help entry, in order of precedence.
KNOWLEDGE = (
    ("userFunc", ("func", "fnc")), ("rownum", ("rownum",)), ("idxOnlyScan", ("index only scan",)), ("bitmapScan", ("bitmap heap scan", "bitmap index scan")), ("partIter", ("partition iterator",)),
    ("idxScan", ("index scan", "partitioned index scan")), ("seqScan", ("seq scan", "tablesample scan")), ("cteScan", ("cte scan",)), ("subqueryScan", ("subquery scan", "subplan")), ("nestLoop", ("nested loop",)),
    ("hashJoin", ("hash join", "hash right join", "hash left join", "hash anti join")), ("mergeJoin", ("merge join",)), ("append", ("append",)), ("result", ("result",)), ("materialize", ("materialize",)),
    ("agg", ("aggregate", "group", "hashaggregate", "windowagg")), ("sort", ("sort",)), ("limit", ("limit",)),
)
SPILL_WORDS = ("disk", "spill", "external merge")


def knowledge_key(op: Column | str, details: Column | str | None = None) -> Column:
    """Help entry of an operator; a spill in its details comes first."""
    o = F.lower(_c(op))
    rules = [] if details is None else [(spills(details), "diskSpill")]
    for key, words in KNOWLEDGE:
        found = F.lit(False)
        for w in words:
            found = found | o.contains(w)
        rules.append((found, key))
    return first_match(rules)


def spills(details: Column | str) -> Column:
    d = F.lower(F.coalesce(_c(details), F.lit("")))
    return d.contains(SPILL_WORDS[0]) | d.contains(SPILL_WORDS[1]) | d.contains(SPILL_WORDS[2])


#: Parts of wait-event names that have a description.
WAIT_WORDS = ("LockMgrLock", "WALSync", "DataFileRead", "DataFileWrite")


def wait_description(event: Column | str) -> Column:
    """Key of a wait event's description, or null."""
    return first_match([(F.lower(_c(event)).contains(w.lower()), w) for w in WAIT_WORDS])


def checksum(*columns: Column) -> Column:
    """SHA-256 of the JSON form of the columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def bounds_error(value: Column | str, least: Column | str, most: Column | str) -> Column:
    v = _c(value)
    return F.when(v < _c(least), "value is below the minimum").when(v > _c(most), "value is above the maximum").when(v < 0, "value is negative")


def type_error(value: Column | str, data_type: Column | str) -> Column:
    v, t = _c(value), _c(data_type)
    return F.when((t == "Integer") & (v != F.floor(v)), "value must be an integer").when((t == "Percentage") & ~v.between(0, 100), "percentage must lie between 0 and 100")


def request_error(changed_by: Column | str, reason: Column | str) -> Column:
    who, why = F.trim(F.coalesce(_c(changed_by), F.lit(""))), F.coalesce(_c(reason), F.lit(""))
    return F.when(who == "", "changed_by is empty").when(F.trim(why) == "", "reason is empty").when(F.length(why) > 500, "reason is too long").when(F.length(F.trim(why)) < 10, "reason is too short")


def truncate_text(text: Column | str, most: int) -> Column:
    """A text cut to `most` characters, the last three of them dots."""
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def failure_message(status: Column | str) -> Column:
    """The message in ImportFailed(message), or null."""
    return F.nullif(F.regexp_extract(_c(status), r'^ImportFailed\("?(.*?)"?\)$', 1), F.lit(""))


def hypothetical_index(cost: Column | str, rows: Column | str) -> Column:
    """Placeholder estimate of an index's effect, as constant factors; there is no model behind it."""
    return F.struct((_c(cost) * 0.65).alias("estimated_cost"), F.lit(35.0).alias("cost_reduction_percent"), F.lit(60.0).alias("row_reduction_percent"), F.lit(True).alias("is_placeholder"), _c(rows).alias("rows"))


def progress_percent(current: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) == 0, F.lit(100.0)).otherwise(_c(current) / F.nullif(_c(total), F.lit(0)) * 100)


def csv_field(text: Column | str) -> Column:
    """A CSV field, quoted if it holds a comma, a quote or a line break."""
    t = _c(text)
    return F.when(t.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def severity_rank(severity: Column | str) -> Column:
    """0 for the worst."""
    order = {"Critical": 0, "High": 1, "Warning": 1, "Medium": 2, "Low": 3, "Info": 4}
    return first_match_int([(_c(severity) == k, v) for k, v in order.items()], 5)


def first_match_int(rules: Sequence[tuple[Column, int]], otherwise: int) -> Column:
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))
