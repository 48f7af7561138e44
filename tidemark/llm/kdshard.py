"""Sharding by a k-d tree over metadata (DataFrame functions only).

One scan reduces every document to its key, byte size, text checksum and integer coordinates. The tree is
grown level by level for all nodes at once: two radix passes over the coordinates of the widest dimension
and two over the tie-breaking key give each node's weighted median. A pass is one partial aggregation to
at most nodes x dimensions x 1024 rows, which is all that the driver ever sees.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

SHARDS, RADIX = 16, 1024
DIMS = ("d_size", "d_source", "d_lang", "d_id")


def _grid(x: Column, low: float | None, high: float | None) -> Column:
    """x on an integer grid of RADIX * RADIX cells between low and high."""
    if low is None or high is None or high <= low:
        return F.lit(0).cast("int")
    cells = RADIX * RADIX
    return F.least(F.lit(cells - 1), F.floor((x.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * cells)).cast("int")


def _name_code(name: Column, least: str | None, largest: str | None) -> Column:
    """The three bytes of a name after what all names begin with, as a number: names keep their alphabetical order."""
    shared = len(os.path.commonprefix([(least or "").encode(), (largest or "").encode()]))
    return F.conv(F.rpad(F.substring(F.hex(name), 2 * shared + 1, 6), 6, "0"), 16, 10).cast("long")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every row of docs; missing metadata columns count as null, null names as empty."""
    name = lambda c: F.coalesce(docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string"), F.lit(""))
    text = F.coalesce(docs["text"], F.lit(""))
    raw = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), name("source").alias("source"), name("lang").alias("lang"))
    raw = checkpoint(raw)
    ends = {"d_size": F.log("size"), "source": F.nullif(F.col("source"), F.lit("")), "lang": F.nullif(F.col("lang"), F.lit("")), "d_id": F.col("doc_id")}
    b = raw.agg(*[f(x).alias(f"{n}{k}") for k, x in ends.items() for n, f in (("lo_", F.min), ("hi_", F.max))]).first()
    codes = {c: _name_code(F.col(c), b[f"lo_{c}"], b[f"hi_{c}"]) for c in ("source", "lang")}
    c = raw.agg(*[f(x).alias(f"{n}{k}") for k, x in codes.items() for n, f in (("lo_", F.min), ("hi_", F.max))]).first()
    names = [_grid(x, c[f"lo_{k}"], c[f"hi_{k}"]).alias(f"d_{k}") for k, x in codes.items()]
    return raw.select("doc_id", "size", "text_crc32", _grid(F.log("size"), b["lo_d_size"], b["hi_d_size"]).alias("d_size"), *names, F.coalesce(_grid(F.col("doc_id"), b["lo_d_id"], b["hi_d_id"]), F.lit(0)).alias("d_id"))


def _bins(rows: DataFrame, keys: list[str], value: Column) -> list:
    return rows.groupBy(*keys, value.alias("bin")).agg(F.sum("size").alias("w")).collect()


def _cut(bins: list[tuple[int, int]], want: float) -> tuple[int, float]:
    """The bin in which the running weight passes want, and the weight before it."""
    before = 0.0
    ordered = sorted(bins)
    for b, w in ordered:
        if before + w > want:
            return b, before
        before += w
    return ordered[-1][0], before - ordered[-1][1]


def _case(node: Column, values: dict[int, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(node == k, F.lit(v)).otherwise(out)
    return out.cast(kind)


def split_level(rows: DataFrame, share: dict[int, tuple[int, int]]) -> DataFrame:
    """rows with node replaced by 2 * node or 2 * node + 1, split at each node's weighted median.

    share: for each node the numbers of leaves on its two sides; weights are divided in that proportion.
    """
    wide = rows.select("node", "size", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("x")) for i, d in enumerate(DIMS)])).alias("c")).select("node", "size", "c.dim", "c.x")
    hist: dict[int, dict[int, list]] = {}
    for r in _bins(wide, ["node", "dim"], F.expr(f"x div {RADIX}").cast("int")):
        hist.setdefault(r["node"], {}).setdefault(r["dim"], []).append((r["bin"], r["w"]))
    dim, want, path = {}, {}, {}
    for node, by_dim in hist.items():
        spread = {d: max(b for b, _ in bins) - min(b for b, _ in bins) for d, bins in by_dim.items()}
        dim[node] = max(spread, key=lambda d: (spread[d], -d))
        left, right = share.get(node, (1, 1))
        total = sum(w for _, w in by_dim[0])
        b, before = _cut(by_dim[dim[node]], total * left / (left + right))
        path[node], want[node] = [b], total * left / (left + right) - before
    node = F.col("node")
    x = F.coalesce(*[F.when(_case(node, dim, "int") == i, F.col(d)) for i, d in enumerate(DIMS)])
    digits = [F.expr(f"_x div {RADIX}").cast("int"), F.expr(f"_x % {RADIX}").cast("int"), F.expr(f"d_id div {RADIX}").cast("int"), F.expr(f"d_id % {RADIX}").cast("int")]
    rows = rows.withColumn("_x", x)
    digits.append(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(RADIX)).cast("int"))
    for level in range(1, len(digits)):
        at = rows
        for k in range(level):
            at = at.filter(digits[k] == _case(node, {n: p[k] for n, p in path.items()}, "int"))
        found: dict[int, list] = {}
        for r in _bins(at, ["node"], digits[level]):
            found.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n, bins in found.items():
            b, before = _cut(bins, want[n])
            path[n].append(b)
            want[n] -= before
    less, same = F.lit(False), F.lit(True)
    for k, d in enumerate(digits):
        cut = _case(node, {n: p[k] for n, p in path.items()}, "int")
        less, same = less | (same & (d < cut)), same & (d == cut)
    # the last cell goes whole to the side where it leaves less imbalance
    cell = {r["node"]: r["w"] for r in rows.filter(same).groupBy("node").agg(F.sum("size").alias("w")).collect()}
    left_too = [n for n, w in cell.items() if want[n] * 2 >= w]
    less = less | (same & node.isin(left_too)) if left_too else less
    return rows.withColumn("node", F.when(less, node * 2).otherwise(node * 2 + 1)).drop("_x")


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs; sizes of shards are near equal.

    size: UTF-8 bytes plus one (null text: 1). Leaves are split until there are `shards` of them, each
    node in proportion to the leaves below it, so a leaf's target is total bytes / shards. The dimensions are log
    size, source and language (by alphabetical order) and doc_id, each on a grid of about a million cells; ties in a coordinate are cut
    by doc_id, then by a hash of doc_id and text, so a group with a third of all rows is split as well;
    rows equal in all of these stay together. Slots count from 0 in each shard, by doc_id.
    Null doc_ids come first. An empty table gives an empty result.
    """
    rows = metadata(docs).withColumn("node", F.lit(1))
    leaves = {1: shards}
    while max(leaves.values()) > 1:
        share = {n: (m // 2, m - m // 2) for n, m in leaves.items() if m > 1}
        done = {n: m for n, m in leaves.items() if m == 1}
        split = split_level(rows.filter(~F.col("node").isin(list(done)) if done else F.lit(True)), share)
        rows = split.unionByName(rows.filter(F.col("node").isin(list(done)))) if done else split
        rows = checkpoint(rows)
        leaves = {**done, **{2 * n: a for n, (a, _) in share.items()}, **{2 * n + 1: b for n, (_, b) in share.items()}}
    order = {n: i for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[3:]))}
    return number_slots(rows.select("doc_id", "size", "text_crc32", _case(F.col("node"), order, "int").alias("shard")))


def number_slots(rows: DataFrame) -> DataFrame:
    """rows with slot, counted from 0 in each shard by doc_id.

    A range sort by (shard, doc_id) and one offset for each (partition, shard) number any shard in
    parallel. The offsets are at most partitions + shards rows, so broadcasting them is bounded.
    """
    ordered = rows.repartitionByRange(F.col("shard"), F.col("doc_id"), F.col("text_crc32")).sortWithinPartitions("shard", "doc_id", "text_crc32")
    at = F.monotonically_increasing_id()
    ordered = checkpoint(ordered.withColumn("_p", F.shiftrightunsigned(at, 33)).withColumn("_i", at.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = sorted(ordered.groupBy("shard", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["shard"], r["_p"]))
    start, out = {}, []
    for r in parts:
        out.append((r["shard"], r["_p"], start.get(r["shard"], 0) - r["_first"]))
        start[r["shard"]] = start.get(r["shard"], 0) + r["n"]
    offsets = rows.sparkSession.createDataFrame(out, "shard int, _p long, _shift long")
    return ordered.join(F.broadcast(offsets), ["shard", "_p"]).withColumn("slot", F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift")


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of kd_shards with the name of the law that holds; grown_shard belongs to another law and is null."""
    out = kd_shards(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
