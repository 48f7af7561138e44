"""Approximate nearest neighbours by vantage-point trees, one for each shard.

A small router, itself a vantage-point tree over a bounded sample, deals all vectors to regions; a region with
many vectors is dealt on by a hash, so shards hold a bounded number of vectors, whatever repeats. The router
keeps the true range of distances from a region to each vantage point above it, and so does every tree.

The triangle inequality turns a range into a least distance of query and region. With the region's largest
norm M, an inner product of s or more needs a distance of at most sqrt(|q|^2 + M^2 - 2s): a region, or a child in
a tree, is skipped if its least distance times a factor exceeds that for the query's k-th score so far. Factor
one gives exact results, larger ones skip more. |q| M below the k-th score also rules out a region, at any factor.

Queries first ask their own region, which gives a k-th score to start from; then only the regions that it does
not rule out. The factor is the largest of FACTORS whose recall, measured on a bounded sample of queries against
factor one over the whole index, reaches TARGET.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

K, LEAF, SHARD_ROWS, QUERY_ROWS, EVERY = 20, 128, 4096, 4096, 20
FACTORS, TARGET, SAMPLE_QUERIES = (16.0, 8.0, 4.0, 2.0, 1.0), 0.97, 64
#: Bounds of the router: sampled rows, their bytes, regions.
ROUTE_ROWS, ROUTE_BYTES, ROUTE_LEAVES = 8192, 1 << 25, 1024
#: Least distances are lowered and limits raised by this share of the figures they come from, which covers rounding.
SLACK = 1e-9


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of rows whose vector is not null, empty or zero and holds finite numbers only.

    Of several lengths only the commonest takes part (of equally common ones the largest); a vec_id with several
    vectors keeps the least of them.
    """
    v = F.col("embedding")
    ok = v.isNotNull() & F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))") & F.expr("exists(embedding, x -> x != 0)")
    rows = embeddings.filter(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("embedding") == (length["d"] if length else 0))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> double(x))").alias("vector"))
    return vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of equal shape; every row is summed in the same order, whatever stands beside it."""
    return np.add.reduce(q * x, axis=-1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(axis=1))


def ruled_out(least: np.ndarray, norm: float | np.ndarray, square: np.ndarray, kth: np.ndarray, factor: float) -> np.ndarray:
    """Whether no vector of norm at most `norm` and at least `least` away can reach the k-th score; square: |q|^2."""
    limit = square + norm**2 - 2 * kth
    limit = np.sqrt(np.maximum(limit + SLACK * (square + norm**2), 0))
    return (factor * least > limit) | (np.sqrt(square) * norm * (1 + SLACK) < kth)


def least_distance(d: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.maximum(np.maximum(low - d, d - high) - SLACK * (d + high), 0)


class Tree:
    """A vantage-point tree over distinct vectors; each keeps up to k + 1 of the smallest ids of its copies."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float = 1.0, k: int = K, leaf: int = LEAF) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        start = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]))
        counts = np.diff(np.concatenate([start, [len(ids)]]))
        self.vectors, self.scale = vectors[start], scale
        self.copies = [ids[s : s + min(c, k + 1)] for s, c in zip(start.tolist(), counts.tolist())]
        self.points = self.vectors * scale
        self.norms = np.sqrt((self.points**2).sum(axis=1))
        self.nodes: list[tuple] = []  # (vantage point, children, ranges of distance, largest norms) or (members,)
        self._grow(np.arange(len(start)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= leaf:
            self.nodes[at] = (members,)
            return at
        vantage = int(members[len(members) // 2])
        d = distances(self.points[members], self.points[vantage])
        order, half = d.argsort(kind="stable"), len(members) // 2
        d, members = d[order], members[order]
        sides = members[:half], members[half:]
        children = tuple(self._grow(side, leaf) for side in sides)
        self.nodes[at] = (vantage, children, ((d[0], d[half - 1]), (d[half], d[-1])), tuple(float(self.norms[side].max()) for side in sides))
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score) of the k best candidates of each query, its own id left out.

        floor: scores below it need not be found. Vectors that tie with the k-th score are all compared by id.
        """
        q = queries * self.scale
        square = (q**2).sum(axis=1)
        # a product of matrices rounds differently from exact_scores; what is this near to the k-th score is kept
        margin = 4e-16 * (q.shape[1] + 16) * np.sqrt(square) * (self.norms.max() if len(self.norms) else 0)
        floor = np.full(len(q), -np.inf) if floor is None else floor * self.scale * self.scale
        # copies may hide behind the query's own row, so one more is kept than asked for
        best = np.full((len(q), k + 1), -np.inf)
        kth = floor.copy()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            entry = self.nodes[node]
            if len(entry) == 1:
                s = q[who] @ self.points[entry[0]].T
                best[who] = np.partition(np.concatenate([best[who], s], axis=1), s.shape[1], axis=1)[:, s.shape[1] :]
                kth[who] = np.maximum(floor[who], best[who].min(axis=1))
                row, col = np.nonzero(s >= (kth[who] - margin[who])[:, None])
                kept.append((who[row], entry[0][col], s[row, col]))
                return
            vantage, children, ranges, norms = entry
            d = distances(q[who], self.points[vantage])
            least = [least_distance(d, *r) for r in ranges]
            near_first = least[0] <= least[1]
            for first, group in ((0, near_first), (1, ~near_first)):
                for side in (first, 1 - first):
                    out = ruled_out(least[side], norms[side], square[who], kth[who] - margin[who], factor)
                    visit(children[side], who[group & ~out])

        visit(0, np.arange(len(q)))
        row, found, s = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        near = s >= (kth - margin)[row]
        return self._answer(query_ids, queries, row[near], found[near], k)

    def _answer(self, query_ids: np.ndarray, queries: np.ndarray, row: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact scores of what was found, copies spelled out, ties to the smaller id."""
        score = np.concatenate([exact_scores(queries[row[a : a + 65536]], self.vectors[found[a : a + 65536]]) for a in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
        n = np.array([len(self.copies[i]) for i in found], np.int64)
        ids = np.concatenate([self.copies[i] for i in found]) if len(found) else np.zeros(0, np.int64)
        row, score = np.repeat(row, n), np.repeat(score, n)
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[top], ids[top], score[top]


class Router:
    """Regions of space: vantage points that halve a sample until there are `leaves` parts, and what their rows measure."""

    def __init__(self, sample: np.ndarray, leaves: int, scale: float = 1.0) -> None:
        self.scale, self.vantages, self.nodes, self.paths = scale, [], [], []
        self._grow(np.unique(sample * scale, axis=0), leaves, ())
        self.leaves = len(self.paths)
        self.rows, self.norms = np.zeros(self.leaves, np.int64), np.zeros(self.leaves)
        self.ranges: dict[tuple[int, int], tuple[float, float]] = {}

    def _grow(self, points: np.ndarray, leaves: int, path: tuple[int, ...]) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        d = distances(points, points[len(points) // 2]) if leaves > 1 and len(points) > 1 else np.zeros(1)
        cut = float(np.median(d))
        if cut >= d.max():
            cut = float(d[d < d.max()].max()) if (d < d.max()).any() else 0.0
        if cut >= d.max():
            self.nodes[at] = (len(self.paths),)
            self.paths.append(path)
            return at
        v = len(self.vantages)
        self.vantages.append(points[len(points) // 2])
        inner = self._grow(points[d <= cut], leaves // 2, (*path, v))
        self.nodes[at] = (v, cut, inner, self._grow(points[d > cut], leaves - leaves // 2, (*path, v)))
        return at

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        x, out = vectors * self.scale, np.zeros(len(vectors), np.int32)

        def go(node: int, who: np.ndarray) -> None:
            entry = self.nodes[node]
            if len(entry) == 1 or not len(who):
                out[who] = entry[0]
                return
            v, cut, inner, outer = entry
            near = distances(x[who], self.vantages[v]) <= cut
            go(inner, who[near])
            go(outer, who[~near])

        go(0, np.arange(len(x)))
        return out

    def measure(self, vectors: np.ndarray) -> list[tuple[int, int, float, float, int]]:
        """(region, vantage point, least and largest distance, rows) of vectors by region; vantage point -1: the norm."""
        x, region, out = vectors * self.scale, self.route(vectors), []
        for r in np.unique(region).tolist():
            part = x[region == r]
            for v in (-1, *self.paths[r]):
                d = distances(part, self.vantages[v] if v >= 0 else 0.0)
                out.append((r, v, float(d.min()), float(d.max()), len(part)))
        return out

    def learn(self, measured: list) -> None:
        for r in measured:
            if r["v"] < 0:
                self.norms[r["leaf"]], self.rows[r["leaf"]] = r["high"], r["n"]
            self.ranges[r["leaf"], r["v"]] = (r["low"], r["high"])

    def worth(self, queries: np.ndarray, kth: np.ndarray, factor: float) -> np.ndarray:
        """(query, region) matrix: regions that have rows and are not ruled out for a k-th score."""
        q, kth = queries * self.scale, kth * self.scale * self.scale
        square = (q**2).sum(axis=1)
        away = [distances(q, v) for v in self.vantages]
        out = np.zeros((len(q), self.leaves), bool)
        for r in np.flatnonzero(self.rows).tolist():
            least = np.zeros(len(q))
            for v in self.paths[r]:
                least = np.maximum(least, least_distance(away[v], *self.ranges[r, v]))
            out[:, r] = ~ruled_out(least, self.norms[r], square, kth - SLACK * np.abs(kth), factor)
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """found with rank from 1 to k within keys, by falling score and rising vec_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def measured_factor(trees: DataFrame, router: Router, sample: list, k: int, factors: tuple[float, ...], target: float) -> float:
    """The largest factor whose recall on the sample of queries reaches the target; one if none does.

    The trees are read where they lie; what reaches the driver is at most k rows for each factor and sampled query.
    """
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    vectors = np.array([r["vector"] for r in sample], np.float64)
    home = router.route(vectors)

    def ask(wanted: dict[float, np.ndarray], floors: dict[float, np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for leaf, data in zip(b.column(0).to_pylist(), b.column(1)):
                    tree = pickle.loads(data.as_py())
                    for f in factors:
                        who = np.flatnonzero(wanted[f][:, leaf])
                        row, found, score = tree.search(ids[who], vectors[who], k, f, floors[f][who])
                        yield pa.record_batch([pa.array(np.full(len(row), f)), pa.array(who[row]), pa.array(found), pa.array(score)], ["f", "q", "vec_id", "score"])

        return best_of(trees.select("leaf", "tree").mapInArrow(run, "f double, q long, vec_id long, score double"), k, "f", "q")

    at_home = np.arange(router.leaves)[None] == home[:, None]
    nothing = {f: np.full(len(ids), -np.inf) for f in factors}
    got = [r.asDict() for r in ask({f: at_home for f in factors}, nothing).collect()]
    floors = {f: x.copy() for f, x in nothing.items()}
    for r in got:
        if r["rank"] == k:
            floors[r["f"]][r["q"]] = r["score"]
    got += [r.asDict() for r in ask({f: router.worth(vectors, floors[f], f) & ~at_home for f in factors}, floors).collect()]
    answers: dict[tuple, list] = {}
    for r in got:
        answers.setdefault((r["f"], r["q"]), []).append((-r["score"], r["vec_id"]))
    top = {key: {v for _, v in sorted(x)[:k]} for key, x in answers.items()}
    exact = {q: x for (f, q), x in top.items() if f == 1.0}
    total = sum(map(len, exact.values()))
    for f in factors:
        if total and sum(len(x & top.get((f, q), set())) for q, x in exact.items()) >= target * total:
            return f
    return 1.0


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, factor: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by `every`; a query's own vec_id is no candidate. Ties go
    to the smaller vec_id. Vectors that are null, empty, zero, of an uncommon length or that hold null or
    non-finite components take no part. Repeated rows count once; see usable() for one id with several vectors.
    Fewer than k candidates: all of them. factor: one is exact; None measures one of FACTORS. Inner products that
    overflow are infinite. An empty table gives an empty result.
    """
    clean = checkpoint(usable(embeddings))
    stats = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("array_max(transform(vector, x -> abs(x)))")).alias("top"), F.max(F.size("vector")).alias("d")).first()
    if not stats["n"]:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    # a power of two, so that scaling loses nothing and no square overflows
    scale = 2.0 ** -max(min(int(np.frexp(stats["top"])[1]), 1000), -1000)
    mixed = F.xxhash64("vec_id")
    rows = clean.orderBy(mixed, "vec_id").limit(max(1, min(ROUTE_ROWS, ROUTE_BYTES // (8 * stats["d"])))).select("vector").toArrow()
    router = Router(matrix(rows["vector"].combine_chunks()), min(ROUTE_LEAVES, -(-stats["n"] // shard_rows)), scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(router.route(matrix(b.column(1))) if b.num_rows else [], pa.int32())], ["vec_id", "vector", "leaf"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = zip(*router.measure(matrix(b.column(0))))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()))], ["leaf", "v", "low", "high", "n"])

    placed = checkpoint(clean.mapInArrow(assign, "vec_id long, vector array<double>, leaf int"))
    ranges = placed.select("vector").mapInArrow(measure, "leaf int, v int, low double, high double, n long").groupBy("leaf", "v").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    router.learn(ranges.collect())  # regions times their depth
    salts = F.array(*[F.lit(int(x)) for x in np.maximum(-(-router.rows // shard_rows), 1)])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["vector"].to_numpy()).astype(np.float64), scale, k)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "salt": pdf["salt"].iloc[:1], "tree": [pickle.dumps(tree)]})

    of_leaf = lambda x: F.element_at(x, F.col("leaf") + 1)
    trees = placed.withColumn("salt", F.pmod(mixed, of_leaf(salts)).cast("int")).groupBy("leaf", "salt").applyInPandas(grow, "leaf int, salt int, tree binary")
    trees = checkpoint(trees)
    queries = placed.filter(F.col("vec_id") % every == 0)
    if factor is None:
        factor = measured_factor(trees, router, queries.orderBy(mixed, "vec_id").limit(SAMPLE_QUERIES).collect(), k, FACTORS, TARGET)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids = right["vec_id"].to_numpy(np.int64)
        row, found, score = pickle.loads(left["tree"].iloc[0]).search(ids, np.stack(right["vector"].to_numpy()).astype(np.float64), k, factor, right["floor"].to_numpy(np.float64))
        return pd.DataFrame({"query_id": ids[row], "vec_id": found, "score": score})

    def ask(asked: DataFrame, per_leaf: dict[int, int]) -> DataFrame:
        """Search of asked (vec_id, vector, floor, leaf) in all shards of each region, in blocks of about query_rows."""
        blocks = F.array(*[F.lit(-(-per_leaf.get(i, 0) // query_rows)) for i in range(router.leaves)])
        block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.greatest(of_leaf(blocks), F.lit(1))).cast("int")
        left = trees.filter(of_leaf(blocks) > 0).select("leaf", "salt", "tree", F.explode(F.sequence(F.lit(0), of_leaf(blocks) - 1)).alias("block"))
        right = asked.select("vec_id", "vector", "floor", "leaf", block.alias("block"), F.explode(F.sequence(F.lit(0), of_leaf(salts) - 1)).alias("salt"))
        keys = ["leaf", "salt", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def count(rows: DataFrame) -> dict[int, int]:
        return {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}

    first = checkpoint(ask(queries.withColumn("floor", F.lit(float("-inf"))), count(queries)))
    floors = best_of(first, k, "query_id").filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    started = checkpoint(queries.join(floors, "vec_id", "left").select("vec_id", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.col("leaf").alias("home")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            worth = router.worth(matrix(b.column(1)), b.column(2).to_numpy(), factor)
            worth[np.arange(len(worth)), b.column(3).to_numpy()] = False
            for leaf in np.flatnonzero(worth.any(axis=0)).tolist():
                part = b.filter(pa.array(worth[:, leaf])).select([0, 1, 2])
                yield pa.record_batch([*part.columns, pa.array(np.full(part.num_rows, leaf, np.int32))], ["vec_id", "vector", "floor", "leaf"])

    rest = started.mapInArrow(spread, "vec_id long, vector array<double>, floor double, leaf int")
    found = first.unionByName(ask(rest, count(rest)))
    return best_of(found, k, "query_id").select("query_id", "rank", "vec_id", "score")
