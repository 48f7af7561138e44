"""Near duplicates by five-word shingles against brute force."""

import random

import corpus_pipeline
from tidemark.llm import jaccard


def brute_kept(texts):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return sorted(set(root))


def test_edited_copies_are_dropped(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(6))
    texts = []
    for _ in range(20):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(120)] = word()
            texts.append(" ".join(t))
    # a crowd of edited copies, each one to four words away from the base
    base = [word() for _ in range(150)]
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(150)] = word()
        texts.append(" ".join(t))
    texts += ["", "one two", "one two", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect())
    assert kept == brute_kept(texts)
    assert jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


def test_prefix_pairs_miss_no_similar_pair(spark):
    rng = random.Random(11)
    sets = []
    for n in (1, 2, 4, 5, 9, 40, 150):
        for _ in range(12):
            base = rng.sample(range(n * 10 + 10), n) if rng.random() < 0.5 else [10**6 + n * 1000 + i for i in range(n)]
            for edits in (0, 1, 2, n // 8, n // 5):
                t = set(base)
                for _ in range(edits):
                    t.discard(rng.choice(base))
                    t.add(rng.randrange(-(10**9), 0))
                if rng.random() < 0.3:
                    t |= {rng.randrange(-(10**9), 0) for _ in range(n // 6)}
                sets.append(frozenset(t))
    sets = list(set(sets))
    table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "fp long, shingles array<long>").cache()
    left = spark.createDataFrame([(i, len(x), i if i % 7 else 0) for i, x in enumerate(sets)], "fp long, size long, root long")
    root = [i if i % 7 else 0 for i in range(len(sets))]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    found = {(r["a"], r["b"]) for r in jaccard.prefix_pairs(left, table).collect()}
    exact = {(r["a"], r["b"]) for r in jaccard.similar(jaccard.prefix_pairs(left, table), table).collect()}
    assert len(want) > 100 and exact == want and len(found) < 10 * len(want)


def test_texts_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    common = " ".join(word() for _ in range(100))
    n = 400
    docs = spark.createDataFrame([(i, common + " " + " ".join(word() for _ in range(25))) for i in range(n)], "doc_id long, text string")
    compared, similar = [], jaccard.similar

    def counted(pairs, sets, *rest):
        compared.append(pairs.count())
        return similar(pairs, sets, *rest)

    monkeypatch.setattr(jaccard, "similar", counted)
    assert jaccard.drop_near_duplicates(docs).count() == n
    assert sum(compared) < 25 * n
