"""Merkle manifest of a dataset: trees of SHA-256 digests, collapsed block by block inside ordered arrays.

Rows become leaves where they lie; from then on only digests move. The leaves of a tree are numbered by one range
partitioning, and every 512 consecutive ones form the ordered array of a block. Higher-order functions collapse a
block's three levels in place (sequence names the runs, slice cuts them, transform hashes them, aggregate goes from
level to level), so one row carries a whole subtree. The roots of the blocks are the leaves of the next round, which
works alike; a tree of n leaves takes log512(n) rounds. On the way down a block hands its members the siblings above
it, and a leaf's proof and its check are again folds over one array.

A tree that holds a third of all rows, or all, is as many blocks as its size asks for, in any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, checkpoint

#: Children of a node, levels collapsed in one block, and leaves of a block (512).
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3


def field(value: Column) -> Column:
    """A value as the leaf's digest takes it: its UTF-8 byte count, a colon and the value; null is -."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (tree, doc_id, leaf, tampered, n): n numbers the rows of a written table; tampered is null for rows left alone.

    tree is the lang with = before it, and empty for null, so its order is the order of langs.
    """
    row = {"doc_id": docs["doc_id"].cast("long"), "source": docs["source"], "lang": docs["lang"], "n_chars": docs["n_chars"].cast("long"), "text": docs["text"]}
    chosen = F.crc32(row["doc_id"].cast("string")) % TAMPER_EVERY == 0
    tampered = digest([ascii_lower(v) if c == "text" else v for c, v in row.items()])
    tree = F.coalesce(F.concat(F.lit("="), row["lang"]), F.lit(""))
    return docs.select(tree.alias("tree"), row["doc_id"].alias("doc_id"), digest([row[c] for c in FIELDS]).alias("leaf"), F.when(chosen, tampered).alias("tampered"), F.monotonically_increasing_id().alias("n"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (gapless from 0 within tree, by order) and size (rows of the tree), as a written table joined with offsets.

    The offsets have one row for each tree and partition that meet, at most partitions plus trees.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = checkpoint(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    spans = spans.select("tree", "part", (F.sum("rows").over(tree.orderBy("part")) - F.col("rows") - F.col("start")).alias("shift"), F.sum("rows").over(tree).alias("size"))
    return placed.join(spans, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def collapse(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Blocks (tree, block, size, items, levels) of nodes (tree, pos, size, node and extra columns).

    items: structs of the members by rising pos. levels: an array for each level of the block, from its nodes to
    its root; a tree whose size one block holds ends at its own root, after no level if it has one node.
    """
    block = F.expr(f"pos div {BLOCK}").alias("block")
    items = F.sort_array(F.collect_list(F.struct("pos", "node", *extra))).alias("items")
    steps = "CASE " + " ".join(f"WHEN size <= {ARITY**k} THEN {k}" for k in range(LEVELS)) + f" ELSE {LEVELS} END"
    up = f"transform(sequence(0, int((size(acc[k - 1]) - 1) div {ARITY})), i -> sha2(array_join(slice(acc[k - 1], i * {ARITY} + 1, {ARITY}), ''), 256))"
    levels = F.expr(f"aggregate(slice(sequence(1, {LEVELS}), 1, {steps}), array(items.node), (acc, k) -> concat(acc, array({up})))")
    return nodes.groupBy("tree", block, "size").agg(items).withColumn("levels", levels)


def build(nodes: DataFrame, extra: list[str]) -> list[DataFrame]:
    """The blocks of every round, leaves first, each a written table; the last round has one block for each tree."""
    rounds = [checkpoint(collapse(nodes, extra))]
    largest = rounds[0].agg(F.max("size")).first()[0] or 0
    while largest > BLOCK:
        last = rounds[-1]
        above = last.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), top_of(last).alias("node"))
        rounds.append(checkpoint(collapse(above, [])))
        largest = -(-largest // BLOCK)
    return rounds


def top_of(blocks: DataFrame) -> Column:
    """The root of a block."""
    return F.element_at(F.element_at(blocks["levels"], -1), 1)


def with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """blocks with found: for each item a struct of the item and path, its siblings up to the last root.

    above: rows (tree, block, path, ...), the paths of the blocks themselves. A path is an array of
    (left, right), the digests before and after the node in its run, joined.
    """
    spot = "int(i div shiftleft(1, 3 * k))"
    run = f"({spot} - {spot} % {ARITY})"
    own = f"transform(slice(sequence(0, {LEVELS - 1}), 1, size(levels) - 1), k -> named_struct('left', array_join(slice(levels[k], {run} + 1, {spot} % {ARITY}), ''), 'right', array_join(slice(levels[k], {spot} + 2, {ARITY - 1} - {spot} % {ARITY}), '')))"
    return blocks.join(above, ["tree", "block"]).withColumn("found", F.expr(f"transform(items, (x, i) -> named_struct('item', x, 'path', concat({own}, path)))"))


def descend(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The leaf blocks with found (see with_paths); above has the path of each tree's root as block 0, and carried columns."""
    for blocks in reversed(rounds[1:]):
        found = with_paths(blocks, above).select("tree", F.explode("found").alias("f"), *carried)
        above = found.select("tree", F.col("f.item.pos").alias("block"), F.col("f.path").alias("path"), *carried)
    return with_paths(rounds[0], above)


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A tree is built for each lang, its leaves by rising doc_id (null first; rows that share one by leaf, and repeated
    rows have equal leaves, so that their order doesn't matter), and one over the subroots by lang (null first, then
    bytewise). Any null, empty or long value has its own form in the leaf (see field). The rows whose doc_id's CRC-32
    three divides are tampered with (A-Z of the text lower-cased) and folded_root is made from what they are then;
    a null doc_id or text is left alone. Extra columns are dropped; an empty table gives an empty result.
    """
    rows = numbered(checkpoint(leaves(docs.select(*FIELDS))), "doc_id", "leaf", "n").withColumnRenamed("leaf", "node")
    rounds = build(rows, ["doc_id", "tampered"])
    tops = rounds[-1].select("tree", top_of(rounds[-1]).alias("node"))
    crown = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), "lang")
    crowns = build(crown, ["lang"])
    none = F.expr("cast(array() as array<struct<left string, right string>>)")
    last = crowns[-1].select("tree", F.lit(0).cast("long").alias("block"), none.alias("path"), top_of(crowns[-1]).alias("root"))
    subtrees = descend(crowns, last, ["root"]).select("root", F.explode("found").alias("f"))
    above = subtrees.select(F.col("f.item.lang").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("f.path").alias("path"), F.col("f.item.node").alias("subroot"), "root")
    found = descend(rounds, above, ["subroot", "root"])
    folded = "aggregate(f.path, coalesce(f.item.tampered, f.item.node), (a, p) -> sha2(concat(p.left, a, p.right), 256))"
    proof = "sha2(array_join(transform(f.path, p -> concat(p.left, p.right)), ''), 256)"
    done = found.select("subroot", "root", F.expr(f"inline(transform(found, f -> named_struct('doc_id', f.item.doc_id, 'leaf', f.item.node, 'proof_sha256', {proof}, 'folded_root', {folded})))"))
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_sql(levels: int = 8) -> str:
    """The same by plain SQL, one level after the other; levels bounds the size of a tree to ARITY^levels."""
    part = lambda c, v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(part(c, c) for c in FIELDS) + ")"
    bad = "sha256(" + " || ".join(part(c, lower if c == "text" else c) for c in FIELDS) + ")"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"
    out = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf} AS leaf, CASE WHEN {crc} % {TAMPER_EVERY} = 0 THEN {bad} END AS tampered FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM d)",
        "a0 AS (SELECT tree, pos, size, leaf AS node FROM a)",
    ]

    def grow(t: str) -> None:
        for k in range(levels):
            out.append(f"{t}r{k} AS (SELECT tree, pos // {ARITY} AS run, list(node ORDER BY pos) AS l FROM {t}{k} WHERE size > 1 GROUP BY ALL)")
            out.append(f"{t}{k + 1} AS (SELECT tree, pos // {ARITY} AS pos, (size + {ARITY - 1}) // {ARITY} AS size, CASE WHEN size > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {t}{k} GROUP BY tree, pos // {ARITY}, size)")

    grow("a")
    out.append(f"b AS (SELECT tree AS lang, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, node AS subroot FROM a{levels})")
    out.append("b0 AS (SELECT tree, pos, size, subroot AS node FROM b)")
    grow("b")
    out.append(f"f0 AS (SELECT a.doc_id, a.leaf, b.subroot, b{levels}.node AS root, a.tree, a.pos, b.pos AS top, '' AS proof, coalesce(a.tampered, a.leaf) AS fold FROM a JOIN b ON a.tree = b.lang CROSS JOIN b{levels})")
    for i in range(2 * levels):
        t, k, pos, tree = ("a", i, "pos", "f.tree") if i < levels else ("b", i - levels, "top", "''")
        j = f"({pos} // {ARITY**k} % {ARITY})"
        left, right = f"coalesce(array_to_string(l[1:{j}], ''), '')", f"coalesce(array_to_string(l[{j} + 2:], ''), '')"
        out.append(f"f{i + 1} AS (SELECT f.* EXCLUDE (proof, fold), proof || {left} || {right} AS proof, CASE WHEN l IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold FROM f{i} f LEFT JOIN {t}r{k} r ON r.tree = {tree} AND r.run = {pos} // {ARITY ** (k + 1)})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{2 * levels}"
