"""Alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import align

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, pair long, n_a int"


@pytest.fixture(scope="module")
def libraries():
    return (align.library_encoder(A), align.byte_level_tokens(A)), align.piece_tokens(B)


def tokens(libraries, text):
    (a, a_bytes), (b, b_bytes) = libraries
    a_ids, b_ids = a([" " + text])[0], b.encode(text)
    joined = [b"".join(t[i] for i in ids) for t, ids in ((a_bytes, a_ids), (b_bytes, b_ids))]
    if not text or any(j != (" " + text).encode() for j in joined):
        return [], [], [], []
    ends = lambda ids, t: [sum(len(t[i]) for i in ids[: k + 1]) for k in range(len(ids))]
    return a_ids, ends(a_ids, a_bytes), b_ids, ends(b_ids, b_bytes)


def brute(libraries, docs):
    rows, links = [], Counter()
    for key, text in docs:
        a, a_ends, b, b_ends = tokens(libraries, text or "")
        parts, own, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x = [t for t, e in zip(a, a_ends) if i < e <= end]
            y = [t for t, e in zip(b, b_ends) if i < e <= end]
            i = end
            parts.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            own.append((x[-1], y[-1]))
        links.update(own)
        rows.append((key, len(a), len(b), len(own), own, hashlib.sha256(";".join(parts).encode()).hexdigest() if own else ""))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((k, na, nb, ng, ng, sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), g) for k, na, nb, ng, own, g in rows), key=repr)


def sample(seed, n):
    r = random.Random(seed)
    parts = ["the", "The", "quick", "ing", " ", "  ", "\n", "\t", ".", ", ", "é", "日本語", "🤷", "▁", "<s>", "<|endoftext|>", "<0x41>", "\x00", "　", "x1", "''s", "ﬁ", "\x1c", "\xa0", "zzzq"]
    return [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 25)))) for i in range(n)]


def test_align_equals_plain_loops(spark, libraries):
    docs = sample(5, 150) + [(7, "twice the same"), (7, "twice the same"), (None, "no id"), (200, None), (201, ""), (202, "w" * 900), (203, "a b " * 400)]
    df = spark.createDataFrame([(k, t, "r", 1, 2) for k, t in docs], SCHEMA).repartition(3)
    assert sorted(map(tuple, align.align(df, A, B).collect()), key=repr) == brute(libraries, docs)


def test_light_pairs_take_the_other_way(spark, libraries, monkeypatch):
    """With few pairs counted as heavy most come by the shuffled join."""
    monkeypatch.setattr(align, "HEAVY", 8)
    docs = sample(6, 60)
    assert sorted(map(tuple, align.align(spark.createDataFrame([(k, t, "r", 1, 2) for k, t in docs], SCHEMA), A, B).collect()), key=repr) == brute(libraries, docs)


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_chunks_equal_whole_texts():
    """The cache of words gives what the libraries give for whole texts, also once it has been turned over."""
    pair = align.TokenPair(A, B)
    assert pair.cut
    texts = [t for _, t in sample(7, 3000)]
    plain = [x or (b"", b"") if t else (b"", b"") for t, x in zip(texts, pair._direct(texts))]
    assert [tuple(bytes(x) for x in row[::2]) for row in pair.encode(texts)] == plain
    pair.older, pair.cache = pair.cache, {}
    assert [tuple(bytes(x) for x in row[::2]) for row in pair.encode(texts)] == plain
    pair.a = align.library_encoder(A)
    assert [x or (b"", b"") if t else (b"", b"") for t, x in zip(texts, pair._direct(texts))] == plain
