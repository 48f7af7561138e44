"""Embedding near-duplicates by the epsilon grid order join (Boehm et al., SIGMOD 2001).

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other. They are rotated onto their
principal axes, put in order of the eps-grid cells of the leading axes by a range sort, and cut into bounded
intervals of that sequence. The join is recursive from the whole sequence down: stretches of the sequence, eight
times shorter at each level, are joined with each other on their parents' pairs, and pairs whose boxes over all
axes are more than eps apart are skipped with all below them. What is left at the lowest level are pairs of bands
of neighbouring intervals; an interval is sent once for each pair of bands, not of intervals, and the recursion
goes on inside, by intervals and halves, down to small blocks that are compared at once. Copies are collapsed
before, and a pair of bands gives link counts and a spanning set of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint
from tidemark.llm.components import connected_components
from tidemark.llm.vptree import matrix, usable

THRESHOLD, GRID_DIMS, INTERVAL, LEAF, SLACK = 0.9, 6, 2048, 256, 1e-6
#: Range partitions of about an interval each in a band, and stretches in the stretch above; axes that boxes are measured on.
BAND, FAN, MAX_AXES = 8, 8, 256


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.add.reduce(v * v, axis=1))[:, None]


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Orthonormal axes as columns, by falling variance; each task sends its sums of products, added up by key.

    Of longer vectors only the leading MAX_AXES coordinates are turned, so at most (MAX_AXES + 1)^2 sums reach the
    driver; boxes over fewer axes skip less and are no less right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = None, 0
        for b in batches:
            if b.num_rows:
                whole = unit(matrix(b.column(0)))
                width, u = whole.shape[1], whole[:, :MAX_AXES]
                u = np.concatenate([u, np.ones((len(u), 1))], axis=1)
                total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel()), pa.array(np.full(total.size, width))], ["i", "j", "x", "width"])

    rows = vectors.select("vector").mapInArrow(run, "i long, j long, x double, width long").groupBy("i", "j").agg(F.sum("x").alias("x"), F.max("width").alias("width")).collect()
    n = 1 + max((r["i"] for r in rows), default=0)
    total = np.zeros((n, n))
    for r in rows:
        total[r["i"], r["j"]] = r["x"]
    mean = total[-1, :-1] / max(total[-1, -1], 1)
    _, axes = np.linalg.eigh(total[:-1, :-1] / max(total[-1, -1], 1) - np.outer(mean, mean))
    out = np.zeros((rows[0]["width"], axes.shape[1]))
    out[: len(axes)] = axes[:, ::-1]
    return out


def box_gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Least distance of two boxes."""
    g = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0)
    return float(np.sqrt((g * g).sum()))


class Interval:
    """The unit vectors of an interval, also turned onto the axes and in single precision, and how many copies each has."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, axes: np.ndarray) -> None:
        self.u, self.r, self.u32, self.weight = vectors, vectors @ axes, vectors.astype(np.float32), counts
        self.low, self.high = self.r.min(axis=0), self.r.max(axis=0)


class PairJoin:
    """Join of two intervals, or of one with itself."""

    def __init__(self, a: Interval, b: Interval, threshold: float, same: bool) -> None:
        self.u, self.v, self.same, self.threshold = a.u, b.u, same, threshold
        self.ru, self.rv, self.u32, self.v32 = a.r, b.r, a.u32, b.u32
        self.eps = float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK
        self.links_u, self.links_v = np.zeros(len(a.u)), np.zeros(len(b.u))
        self.weight_u, self.weight_v = a.weight, b.weight
        #: spanning links, the right side's positions counted on from the left's unless both are one interval
        self.spanning: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i0: int, i1: int, j0: int, j1: int) -> None:
        if self.same and j1 <= i0 or i0 >= i1 or j0 >= j1:
            return
        ru, rv = self.ru[i0:i1], self.rv[j0:j1]
        if box_gap(ru.min(axis=0), ru.max(axis=0), rv.min(axis=0), rv.max(axis=0)) > self.eps:
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            return self._leaf(i0, i1, j0, j1)
        if i1 - i0 >= j1 - j0:
            h = (i0 + i1) // 2
            self.join(i0, h, j0, j1)
            self.join(h, i1, j0, j1)
        else:
            h = (j0 + j1) // 2
            self.join(i0, i1, j0, h)
            self.join(i0, i1, h, j1)

    def _leaf(self, i0: int, i1: int, j0: int, j1: int) -> None:
        dot = self.u32[i0:i1] @ self.v32[j0:j1].T
        i, j = np.nonzero(dot >= self.threshold - 1e-4)
        sure = dot[i, j] >= self.threshold + 1e-4
        i, j = i + i0, j + j0
        if not sure.all():
            close = np.flatnonzero(~sure)
            sure[close] = np.add.reduce(self.u[i[close]] * self.v[j[close]], axis=1) >= self.threshold
        if self.same:
            sure &= i < j
        if not sure.any():
            return
        i, j = i[sure], j[sure]
        self.links_u += np.bincount(i, self.weight_v[j], len(self.u))
        self.links_v += np.bincount(j, self.weight_u[i], len(self.v))
        # a leaf keeps a spanning forest of its links, however many there are
        width = i1 - i0
        root = roots_of(i - i0, j - j0 + width, width + j1 - j0)
        hit = np.flatnonzero(root != np.arange(len(root)))
        shift = 0 if self.same else len(self.u)
        place = lambda x: np.where(x < width, x + i0, x - width + j0 + shift)
        self.spanning.append((place(hit), place(root[hit])))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weighted link counts of the left and then the right vectors, spanning links as two arrays); of one interval's if both are the same."""
        links = self.links_u + self.links_v if self.same else np.concatenate([self.links_u, self.links_v])
        a = np.concatenate([x for x, _ in self.spanning]) if self.spanning else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in self.spanning]) if self.spanning else np.zeros(0, np.int64)
        return links, a, b


def join_bands(blocks: list[Interval], left: list[int], right: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted link counts, least position in the component) of all vectors of blocks, in their order.

    left and right: the intervals of the two bands, or twice the same ones, of which each pair is joined once.
    """
    start = np.concatenate([[0], np.cumsum([len(b.u) for b in blocks])])
    links, ends = np.zeros(start[-1]), ([], [])
    eps = float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK
    for i in left:
        for j in right:
            if left is right and j < i or box_gap(blocks[i].low, blocks[i].high, blocks[j].low, blocks[j].high) > eps:
                continue
            work = PairJoin(blocks[i], blocks[j], threshold, i == j)
            work.join(0, len(blocks[i].u), 0, len(blocks[j].u))
            counted, a, b = work.result()
            place = np.arange(start[i], start[i + 1])
            place = place if i == j else np.concatenate([place, np.arange(start[j], start[j + 1])])
            links[place] += counted
            ends[0].append(place[a])
            ends[1].append(place[b])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ends)
    return links, roots_of(a, b, len(links))


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component, for links a-b between n nodes."""
    label = np.arange(n)
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    order = x.argsort(kind="stable")
    x, y = x[order], y[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    while len(x):
        new = label.copy()
        new[x[at]] = np.minimum(label[x[at]], np.minimum.reduceat(label[y], at))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def intervals(vectors: DataFrame, axes: np.ndarray, threshold: float, parts: int, size: int = INTERVAL) -> DataFrame:
    """Rows (block, ids, counts, vectors, low, high): intervals of the grid order, vectors as bytes of unit doubles.

    The sort key is the cells of the leading axes, then the position on the first axis and the id, so a cell
    that a third of all vectors share is cut into several intervals.
    """
    eps = float(np.sqrt(max(2 - 2 * threshold, 1e-12)))
    dims = min(GRID_DIMS, axes.shape[1])
    names = [f"c{i}" for i in range(dims)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column(2)))
                y = u @ axes[:, :dims]
                cell = np.floor(y / eps).astype(np.int32)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in u], pa.binary()), *[pa.array(cell[:, i]) for i in range(dims)], pa.array(y[:, 0])], ["rep", "n", "u", *names, "y"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            u = np.frombuffer(b"".join(rows["u"].to_pylist()), np.float64).reshape(len(rows), -1)
            y = u @ axes
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.record_batch([pa.array([at]), one(rows["rep"].to_numpy()), one(rows["n"].to_numpy()), one(u), pa.array([y.min(axis=0).tolist()]), pa.array([y.max(axis=0).tolist()])], ["block", "ids", "counts", "vectors", "low", "high"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            while n >= size:
                rows = pa.concat_tables(held)
                yield out(rows.slice(0, size))
                at, held, n = at + 1, [rows.slice(size)], n - size
        if n:
            yield out(pa.concat_tables(held))

    keyed = vectors.select("rep", "n", "vector").mapInArrow(cells, "rep long, n long, u binary, " + ", ".join(f"{c} int" for c in names) + ", y double")
    ordered = keyed.repartitionByRange(parts, *names, "y", "rep").sortWithinPartitions(*names, "y", "rep")
    return ordered.select("rep", "n", "u").mapInArrow(cut, "block long, ids binary, counts binary, vectors binary, low array<double>, high array<double>")


def _boxes(rows: DataFrame) -> DataFrame:
    """Rows (part, low, high): the box around all boxes of each part of rows (part, low, high)."""

    def around(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "low": [np.stack(pdf["low"].to_numpy()).min(axis=0)], "high": [np.stack(pdf["high"].to_numpy()).max(axis=0)]})

    return rows.groupBy("part").applyInPandas(around, "part long, low array<double>, high array<double>")


def near_bands(blocks: DataFrame, parts: int, eps: float) -> DataFrame:
    """Rows (a, b), a <= b: pairs of bands whose boxes, and those of all stretches above them, are at most eps apart.

    A pair meets at most FAN * FAN pairs of the next level, by two equi-joins on the stretches above. parts: range
    partitions that blocks were cut from.
    """
    levels = [checkpoint(_boxes(blocks.select(F.expr(f"(block >> 32) div {BAND}").alias("part"), "low", "high")))]
    n = -(-parts // BAND)
    while n > FAN:
        levels.append(checkpoint(_boxes(levels[-1].select(F.expr(f"part div {FAN}").alias("part"), "low", "high"))))
        n = -(-n // FAN)
    gap = F.expr("aggregate(zip_with(zip_with(la, hb, (x, y) -> x - y), zip_with(lb, ha, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, g) -> s + g * g)")
    # above the top level, of at most FAN stretches, lies the whole sequence
    pairs = blocks.sparkSession.range(1).select(F.col("id").alias("pa"), F.col("id").alias("pb"))
    for depth, boxes in enumerate(reversed(levels)):
        parent = F.expr(f"part div {FAN if depth else 1 << 40}")
        left = boxes.select(F.col("part").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), parent.alias("pa"))
        right = boxes.select(F.col("part").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), parent.alias("pb"))
        both = pairs.join(left, "pa").join(right, "pb").filter("a <= b").filter(gap <= float((eps + SLACK) ** 2))
        pairs = checkpoint(both.select(F.col("a").alias("pa"), F.col("b").alias("pb")))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def link(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings with an id.

    Links join vectors whose cosine is at least threshold; n_links counts the other rows linked directly.
    Vectors that are null, empty, zero, of an uncommon length or that hold null or non-finite components link with
    nothing and are kept. Rows with equal vectors are one class with a count, so copies meet no pair; rows that
    repeat a vec_id count once, with the least of its vectors. Rows whose vec_id is null are dropped. An empty table gives an empty result.
    """
    rows = embeddings.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    clean = checkpoint(usable(embeddings))
    classes = checkpoint(clean.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    if classes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(classes)
    parts = max(1, -(-classes.count() // INTERVAL))
    blocks = checkpoint(intervals(classes, axes, threshold, parts))
    parts = 1 + (blocks.agg(F.max("block")).first()[0] >> 32)
    pairs = near_bands(blocks, parts, float(np.sqrt(max(2 - 2 * threshold, 1e-12))))
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("band"))
    payload = sides.join(blocks.select(F.expr(f"(block >> 32) div {BAND}").alias("band"), "block", "ids", "counts", "vectors"), "band")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        counts = [np.frombuffer(x, np.int64) for x in pdf["counts"]]
        held = [Interval(np.frombuffer(x, np.float64).reshape(len(n), -1), n, axes) for x, n in zip(pdf["vectors"], counts)]
        band = pdf["band"].to_numpy()
        left = np.flatnonzero(band == pdf["a"].iloc[0]).tolist()
        right = left if pdf["a"].iloc[0] == pdf["b"].iloc[0] else np.flatnonzero(band == pdf["b"].iloc[0]).tolist()
        links, root = join_bands(held, left, right, threshold)
        every = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        hit = np.flatnonzero(links)
        return pd.DataFrame({"rep": every[hit], "links": links[hit].astype(np.int64), "root": every[root[hit]]})

    found = checkpoint(payload.groupBy("a", "b").applyInPandas(join, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    of_class = checkpoint(classes.join(links, "rep", "left").join(roots, "rep", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    # equal arrays meet again by value; classes holds one row for each
    member = clean.join(of_class, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.join(clean.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
