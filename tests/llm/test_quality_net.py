"""The classifier's network against plain loops, numeric gradients and other batchings."""

from __future__ import annotations

from dataclasses import fields

import numpy as np

from tidemark.llm import quality


def texts(n: int, seed: int = 3) -> list[bytes]:
    r = np.random.default_rng(seed)
    return [b"", b"a", *(bytes(r.integers(32, 127, int(k), np.uint8)) for k in r.integers(1, 900, n - 2))]


def naive_score(m: quality.Model, text: bytes) -> float:
    """Chunk by chunk, filter by filter, in double precision."""
    rows = max(quality.WIDE_ROWS, -(-len(text) // quality.ROW))
    data = text.ljust(rows * quality.ROW, b"\0")
    f = {x.name: getattr(m, x.name).astype(np.float64) for x in fields(m)}
    size = quality.ROW * quality.PLACED_ROWS
    placed, wide = np.zeros(quality.PLACED), np.zeros(quality.WIDE)
    for a in range(0, len(data) - size + 1, quality.ROW):
        x = np.concatenate([f["embedding"][b] for b in data[a : a + size]])
        placed = np.maximum(placed, x @ f["placed"].reshape(-1, quality.PLACED) + f["placed_bias"])
    size = quality.ROW * quality.WIDE_ROWS
    for a in range(0, len(data) - size + 1, quality.ROW):
        u = np.maximum(sum(f["bytes"][b] for b in data[a : a + size]) / 8 + f["bytes_bias"], 0)
        wide = np.maximum(wide, u @ f["wide"] + f["wide_bias"])
    act = np.maximum(np.concatenate([placed, wide]) @ f["dense"] + f["dense_bias"], 0)
    return float(1 / (1 + np.exp(-(act @ f["out"] + f["out_bias"])[0])))


def test_scores_equal_plain_loops():
    m = quality.Model.fresh().snapped()
    data = texts(25)
    assert np.allclose(m.scores(data), [naive_score(m, t) for t in data], atol=1e-5)


def test_scores_have_the_same_bits_in_any_batch():
    data = texts(300)
    m = quality.train(data[:80], (np.arange(80) % 2).astype(np.float32), epochs=2)
    whole = m.scores(data)
    for size in (1, 2, 7, 64):
        parts = np.concatenate([m.scores(data[a : a + size]) for a in range(0, len(data), size)])
        assert (parts == whole).all()
    order = np.random.default_rng(5).permutation(len(data))
    assert (m.scores([data[i] for i in order]) == whole[order]).all()


def test_gradients_equal_differences():
    data = texts(12, seed=8)
    y = (np.arange(12) % 3 == 0).astype(np.float32)
    weight = np.linspace(0.5, 1.5, 12).astype(np.float32)
    m = quality.Model.fresh(1).snapped()

    def loss() -> float:
        p = np.array([naive_score(m, t) for t in data])
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads = quality.gradients(m, data, y, weight)
    for field, g in zip(fields(m), grads):
        w = getattr(m, field.name)
        assert g.shape == w.shape
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            old = w[at]
            step = np.float32(2e-3)
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * float(step)) - g[at]) < 2e-3 + 0.05 * abs(g[at]), field.name


def test_long_texts_are_in_the_sample(spark):
    rows = [(i, ("ab " * 40_000 if i % 2 else "cd ") + str(i)) for i in range(40)] + [(1, "another row of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(40)], "doc_id long, quality int")
    sample = quality.training_sample(docs, labels)
    ids = [r["doc_id"] for r in sample]
    assert any(len(r["text"]) > 100_000 for r in sample) and len(ids) == len(set(ids)) and set(ids) < set(range(40))
    few = quality.training_sample(docs, labels, max_bytes=400_000)
    assert 0 < sum(len(r["text"]) for r in few) <= 400_000 and {r["doc_id"] for r in few} < set(ids)
    assert quality.training_sample(docs, labels, max_bytes=0) == []
