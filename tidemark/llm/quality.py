"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into rows of 16. Two sets of learned filters run over overlapping chunks of rows
that cover the whole document: filters over the places of a chunk of two rows (32 bytes), and filters over the
bytes of a chunk of four rows (64 bytes) whatever their places, whose rectified responses are combined by a
second layer of filters in each chunk. The largest response of each filter over the document goes into a small
dense layer and a logistic output. All weights, the byte embeddings included, are learned from labels; training
runs on the driver over a bounded sample of labelled rows.

A document's score has the same bits whatever stands beside it in a batch: embeddings and placed filters are
rounded to grids so coarse that their sums of products are whole numbers that single precision holds exactly,
in whatever order a matrix product adds them; all other sums have a fixed order.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks
from tidemark.llm.common import unused

#: Bytes in a row; rows in a chunk of placed filters and of filters over all bytes; rows that a product in order takes at a time.
ROW, PLACED_ROWS, WIDE_ROWS, TILE = 16, 2, 4, 512
EMBEDDING, PLACED, BYTE_FILTERS, WIDE, HIDDEN = 6, 24, 32, 16, 12
#: Largest whole numbers of the grids; ROW * EMBEDDING of their products add up to less than 2^24.
EMBEDDING_TOP, PLACED_TOP = 127, 1023
#: Bounds of the training sample: documents of each label, and bytes of all of them. Texts are whole and of any length;
#: where they are long, fewer documents make up the sample.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 1500, 32_000_000
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 600, 32, 0.01, 1e-4
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2


def byte_rows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in rows of ROW, first row of each document; then the end). A document has WIDE_ROWS rows at least, filled up with zero bytes."""
    rows = np.array([max(WIDE_ROWS, -(-len(d) // ROW)) for d in data], np.int64)
    flat = np.frombuffer(b"".join(d.ljust(int(n) * ROW, b"\0") for d, n in zip(data, rows)), np.uint8)
    return flat.reshape(-1, ROW), np.concatenate([[0], np.cumsum(rows)])


def on_grid(w: np.ndarray, top: int) -> tuple[np.ndarray, float]:
    """(whole numbers from -top to top, step) whose product is w, or as near to it as the grid has it."""
    step = float(np.abs(w).max()) / top or 1.0
    return np.rint(w / step).astype(np.float32), step


def ordered_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in the order of the columns of x."""
    out = np.zeros((len(x), w.shape[1]), np.float32)
    for a in range(0, len(x), TILE):
        part, to = np.ascontiguousarray(x[a : a + TILE].T)[:, :, None], out[a : a + TILE]
        for k in range(len(w)):
            to += part[k] * w[k]
    return out


@dataclass
class Model:
    """Weights: embedding and placed filters, byte filters and their combinations, dense layer, output."""

    embedding: np.ndarray
    placed: np.ndarray
    placed_bias: np.ndarray
    bytes: np.ndarray
    bytes_bias: np.ndarray
    wide: np.ndarray
    wide_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        z = lambda *shape: np.zeros(shape, np.float32)
        span, pooled = ROW * EMBEDDING, PLACED + WIDE
        return cls(
            n(256, EMBEDDING, scale=0.5), n(PLACED_ROWS, span, PLACED, scale=span**-0.5), z(PLACED),
            n(256, BYTE_FILTERS, scale=0.2), z(BYTE_FILTERS), n(BYTE_FILTERS, WIDE, scale=BYTE_FILTERS**-0.5), z(WIDE),
            n(pooled, HIDDEN, scale=pooled**-0.5), z(HIDDEN), n(HIDDEN, 1, scale=HIDDEN**-0.5), z(1),
        )

    def snapped(self) -> Model:
        """The model with embedding and placed filters moved onto the grids that scoring uses."""
        snap = lambda w, top: np.multiply(*on_grid(w, top)).astype(np.float32)
        return replace(self, embedding=snap(self.embedding, EMBEDDING_TOP), placed=snap(self.placed, PLACED_TOP))

    def placed_responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedded rows as whole numbers of the grid, response of each placed filter for the chunk that starts at each row but the last)."""
        embedding, step = on_grid(self.embedding, EMBEDDING_TOP)
        placed, step_placed = on_grid(self.placed, PLACED_TOP)
        x = embedding[rows].reshape(len(rows), -1)
        both = x @ np.concatenate([placed[0], placed[1]], axis=1)
        return x, (both[:-1, :PLACED] + both[1:, PLACED:]) * np.float32(step * step_placed) + self.placed_bias

    def wide_responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectified byte filters, response of each combination) of the chunk of WIDE_ROWS rows that starts at each row."""
        s = self.bytes[rows[:, 0]].copy()
        for k in range(1, ROW):
            s += self.bytes[rows[:, k]]
        n = len(s) - WIDE_ROWS + 1
        chunk = s[:n] + s[1 : n + 1] + s[2 : n + 2] + s[3 : n + 3]
        u = np.maximum(chunk / 8 + self.bytes_bias, 0)
        return u, ordered_product(u, self.wide) + self.wide_bias

    def pooled(self, data: list[bytes]) -> np.ndarray:
        """Largest response of each filter over each document, at least zero."""
        rows, first = byte_rows(data)
        h = self.placed_responses(rows)[1]
        w = self.wide_responses(rows)[1]
        for x, reach in ((h, PLACED_ROWS), (w, WIDE_ROWS)):
            for k in range(1, reach):  # chunks that would reach into the next document
                x[first[1:-1] - k] = -np.inf
        most = [np.maximum.reduceat(x, first[:-1], axis=0) for x in (h, w)]
        return np.maximum(np.concatenate(most, axis=1), 0)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        a = np.maximum(ordered_product(pooled, self.dense) + self.dense_bias, 0)
        z = ordered_product(a, self.out)[:, 0] + self.out_bias[0]
        return np.array([1 / (1 + math.exp(-x)) for x in np.clip(z, -40, 40).tolist()])

    def scores(self, data: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each document."""
        return self.head(self.pooled(data)) if data else np.zeros(0)


def gradients(model: Model, data: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean weighted logistic loss by all weights; they flow through the chunk that gave each filter its maximum."""
    rows, first = byte_rows(data)
    x, h = model.placed_responses(rows)
    u, w = model.wide_responses(rows)
    n = len(data)

    def best(r: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.stack([first[k] + r[first[k] : first[k + 1] - reach + 1].argmax(axis=0) for k in range(n)])
        return at, np.take_along_axis(r, at, axis=0)

    (at_h, best_h), (at_w, best_w) = best(h, PLACED_ROWS), best(w, WIDE_ROWS)
    top = np.concatenate([best_h, best_w], axis=1)
    pooled = np.maximum(top, 0)
    z = pooled @ model.dense + model.dense_bias
    act = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip((act @ model.out + model.out_bias)[:, 0], -30, 30)))
    d = ((p - labels) * weight / n).astype(np.float32)[:, None]
    g_act = d @ model.out.T * (z > 0)
    g_pool = g_act @ model.dense.T * (top > 0)
    g_h, g_w = g_pool[:, :PLACED], g_pool[:, PLACED:]
    doc, f = np.nonzero(g_h)
    at, g = at_h[doc, f], g_h[doc, f]
    step = np.float32(on_grid(model.embedding, EMBEDDING_TOP)[1])
    g_placed, g_emb = np.zeros_like(model.placed), np.zeros_like(model.embedding)
    for side in range(PLACED_ROWS):
        np.add.at(g_placed[side].T, f, g[:, None] * (x[at + side] * step))
        np.add.at(g_emb, rows[at + side].reshape(-1), (g[:, None] * model.placed[side].T[f]).reshape(-1, EMBEDDING))
    doc, f = np.nonzero(g_w)
    at, g = at_w[doc, f], g_w[doc, f]
    g_wide = np.zeros_like(model.wide)
    np.add.at(g_wide.T, f, g[:, None] * u[at])
    g_u = (g[:, None] * model.wide.T[f]) * (u[at] > 0)
    counts = np.zeros((len(at), 256), np.float32)
    held = np.concatenate([rows[at + k] for k in range(WIDE_ROWS)], axis=1)
    np.add.at(counts, (np.arange(len(at))[:, None], held), 1)
    return [g_emb, g_placed, g_h.sum(axis=0), counts.T @ g_u / 8, g_u.sum(axis=0), g_wide, g_w.sum(axis=0), pooled.T @ g_act, g_act.sum(axis=0), act.T @ d, d.sum(axis=0)]


def train(data: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int | None = None) -> Model:
    """Adam on the logistic loss, both labels weighted alike, with a cosine schedule; EPOCHS epochs, and STEPS steps at least."""
    epochs = epochs or max(EPOCHS, -(-STEPS * BATCH // max(len(data), 1)))
    model = Model.fresh(seed)
    r = np.random.default_rng(seed)
    parts = [getattr(model, f.name) for f in fields(model)]
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for epoch in range(epochs):
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        order = r.permutation(len(data))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            t += 1
            for q, grad, mm, vv in zip(parts, gradients(model, [data[i] for i in pick], labels[pick], weight[pick]), m, v):
                grad = grad + DECAY * q
                mm += 0.1 * (grad - mm)
                vv += 0.001 * (grad * grad - vv)
                q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-7)
    return model.snapped()


def fold(doc_id: object) -> object:
    """Column: remainder of the CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> list:
    """At most max_rows rows (text, quality) of each label, none of them held out, in the order of a hash of the id.

    The sample ends before the document that would take it over max_bytes. Of rows that share a doc_id the one with the
    least hash of its text stands.
    """
    good = labels.filter(labels["quality"].isin(0, 1)).select("doc_id", "quality").filter(fold(F.col("doc_id")) != HELD_OUT)
    picked = [good.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most 2 * max_rows rows of two numbers
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("hash"))
    sizes = met.groupBy("doc_id").agg(F.min(F.struct("hash", F.octet_length("text").alias("bytes"))).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids, left = [], max_bytes
    for r in sizes:
        left -= r["r"]["bytes"]
        if left < 0:
            break
        ids.append((r["doc_id"], r["r"]["hash"]))
    kept = docs.sparkSession.createDataFrame(ids, "doc_id long, hash long")
    rows = met.join(F.broadcast(kept), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "quality")
    return sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> bytes:
    """A trained model, pickled. Without labelled rows of both kinds the model is an untrained one."""
    rows = training_sample(docs, labels, max_rows)
    y = np.array([r["quality"] for r in rows], np.float32)
    data = [r["text"].encode("utf-8", "surrogatepass") for r in rows]
    return pickle.dumps(train(data, y) if len(set(y.tolist())) == 2 else Model.fresh().snapped())


_MODELS: dict[bytes, Model] = {}


def score_column(docs: DataFrame, model: bytes, keep_columns: list[str]) -> DataFrame:
    """keep_columns of docs with score (the last column, under an unused name); text is scored whole, null as empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in docs.columns if c in keep_columns]
    last = unused("score", names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _MODELS.get(model)
        if net is None:
            net = _MODELS[model] = pickle.loads(model)
        for batch in batches:
            pair = pa.record_batch([pa.array(range(batch.num_rows)), batch.column(batch.schema.get_field_index("text"))], ["i", "text"])
            score = np.zeros(batch.num_rows)
            for at, texts in text_chunks([pair]):
                score[at] = net.scores([t.encode("utf-8", "surrogatepass") for t in texts])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*columns, pa.array(score)], [*names, last])

    schema = StructType([*[docs.schema[c] for c in names], StructField(last, DoubleType())])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null and empty texts are scored as zero bytes; repeated rows get the same score; extra columns of docs are
    dropped. Rows of labels without a quality of 0 or 1 are ignored; two labels of one id count as the lesser.
    An empty table gives an empty result.
    """
    out = score_column(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose score reaches the threshold, with the columns of docs, whatever their names.

    Null and empty texts are scored like any other; repeated rows stay or go together. An empty table gives an empty result.
    """
    scored = score_column(docs, fit(docs, labels), docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= THRESHOLD).select(*docs.columns)
