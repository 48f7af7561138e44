"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import packing, quality, simhash
from tidemark.llm.queries import word_tokenizer_file

SHARED = "this line stands in very many of the documents"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(90):
        t = text()
        if i % 5 == 0:
            t += "\n" + SHARED
        if i % 9 == 0:
            t += f"\nwrite to ann{i}.b@mail.example.com or +1 (555) 123-4567 now"
        if i % 3 == 1:
            t = t[:80] + " ### | !!! |" * 15
        rows.append((i, t, "en", "src0", len(t)))
    rows += [(100 + i, rows[i][1], "en", "src1", 1) for i in (0, 2, 3)] + [rows[2], (200, None, None, None, None), (201, "", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 1), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_lines(rows):
    split = [(r, (r["text"] or "").split("\n")) for r in rows]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r, lines in split:
        for line in lines:
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(r["doc_id"], None if r["text"] is None else "\n".join(x for x in lines if key(x) not in keep or r["doc_id"] == keep[key(x)])) for r, lines in split]


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    good = stages["quality_classifier"](spark, docs, corpus).cache()
    assert good.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    import pickle

    every = docs.collect()
    score = pickle.loads(model).scores([(r["text"] or "").encode() for r in every])
    assert pairs(good) == sorted([(r["doc_id"], r["text"]) for r, s in zip(every, score) if s >= 0.7], key=repr)
    ids = {r["doc_id"] for r in good.collect()}
    assert len([i for i in range(90) if i % 3 != 1 and i not in ids]) <= 2 and len([i for i in range(90) if i % 3 == 1 and i in ids]) <= 2

    lines = stages["line_dedup"](spark, good, corpus).cache()
    assert lines.columns == columns and pairs(lines) == sorted(brute_lines(good.collect()), key=repr)

    single = stages["near_dedup"](spark, lines, corpus).cache()
    rows = lines.collect()
    fp = [simhash.fingerprint(r["text"] or "") for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    groups = {}
    for r, g in zip(rows, root):
        groups.setdefault(g, []).append(r["doc_id"])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(min(v) for v in groups.values())

    clean = stages["pii"](spark, single, corpus).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert clean.columns == columns and clean.count() == len(before)
    for r in clean.collect():
        old = before[r["doc_id"]]
        if old is None or "@" not in old:
            assert r["text"] == old
        else:
            assert "@" not in r["text"] and "555" not in r["text"] and r["text"].startswith(old[:200])

    t = packing.WordTokenizer(word_tokenizer_file())
    packed = stages["packing"](spark, clean, corpus).collect()
    want = sum(len(x) // 4 + 1 for x in t.encode([r["text"] or "" for r in clean.collect()]))
    assert sum(r["length"] for r in packed) == want and {r["doc_id"] for r in packed} == set(before)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    rows = out.collect()
    assert rows and max(np.array([r["offset"] + r["length"] for r in rows])) <= 4096


CLASHING = ["score", "n_lines", "n_dropped", "keep_words", "_doc", "_k1", "_k2", "_text", "fp", "root", "text_hash", "_n", "cuts", "found", "t", "key", "a", "b"]


def test_stages_keep_columns_of_any_name(spark, corpus):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 40 OR doc_id >= 100")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name == "packing":
            assert out.filter("length > 0").count() == out.count() >= docs.count()
            continue
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING), name
        assert stage(spark, docs.limit(0), corpus).columns == docs.columns
