"""The tree search where norms differ, scores tie or components are large."""

import numpy as np
import pytest

from tidemark.llm import ego, vptree


def vectors_of(kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.5, 2000)[:, None]
    elif kind == "clusters":
        x = x[np.arange(2000) % 40] + rng.standard_normal((2000, 32)) * 0.02
    elif kind == "ties":
        x = np.zeros((2000, 8))
        x[:, 0], x[np.arange(2000), 1 + np.arange(2000) % 7] = 1, np.arange(2000) // 7 % 5
        x[::20] = np.eye(8)[0]
    elif kind == "large":
        x *= 1e25
    elif kind == "one long":
        x[1] *= 3
    else:
        x[1] *= 3e5
    return x


@pytest.mark.parametrize("kind", ["one long", "one very long", "lognormal", "clusters", "ties", "large"])
def test_recall_and_exact_lists(spark, kind):
    x = vectors_of(kind)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = {}
    for i in range(0, 2000, 20):
        s = vptree.exact_scores(x[i], x)
        want[i] = [j for j in np.lexsort((np.arange(2000), -s)).tolist() if j != i][:20]
    for factor in (None, 1.0):
        got = {}
        for r in vptree.nearest(df, factor=factor, shard_rows=600, query_rows=50).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.95 * 20 * len(want)
        if factor == 1.0:
            assert got == want


def test_vectors_of_several_lengths_and_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.1]), (2, [1.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vptree.nearest(df).orderBy("rank").collect()] == [(0, 1, 3, 1.0), (0, 2, 1, 0.5)]
    assert {r["vec_id"]: r["n_links"] for r in ego.link(df).collect()} == {0: 2, 1: 2, 2: 0, 3: 2, 4: 0}


def test_links_over_many_bands(spark, monkeypatch):
    monkeypatch.setattr(ego, "INTERVAL", 20)
    monkeypatch.setattr(ego, "BAND", 1)
    monkeypatch.setattr(ego, "FAN", 2)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((60, 6)), 5, axis=0) + rng.standard_normal((300, 6)) * 0.25
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = ego.unit(x)
    near = u @ u.T >= 0.9
    root = ego.roots_of(*np.nonzero(np.triu(near, 1)), 300)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ego.link(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(300)}
