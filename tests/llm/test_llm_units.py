"""Unit tests of the numpy parts: brute force, library results and exact round trips."""

import base64
import random
import time

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, ego, packing, quality, simhash, vptree
from tidemark.llm.queries import rank_file, word_tokenizer_file

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(rank_file())


@pytest.fixture(scope="module")
def reference():
    with open(rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGE = ["", "'s", "'", "''s", " 's", "a'stop", "\n's", "  ", "a  ", "!'s", "'re've", "a'r", " " * 300, "x" * 700, "<|endoftext|>", "a　b", "é١٢", "\U0001f600'll", "\r\n \tx", "\x1c x"]


def test_bpe_equals_library(codec, reference):
    rng = random.Random(3)
    alphabet = "'''''stmdrevl  \n\t 　aZé9٣!.?\U0001f600'll're \r\x1céßΣ"
    texts = EDGE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [t.encode() for t in texts]
    offsets = codec.token_offsets(ids[5])
    assert offsets[-1] == len(texts[5].encode()) and len(offsets) == len(ids[5]) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_bpe_equals_library_on_any_text(codec, reference, texts):
    assert [x.tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_cache_can_be_cleared(codec):
    before = codec.encode(["one two three"])[0].tolist()
    codec.cache.clear()
    assert codec.encode(["one two three"])[0].tolist() == before


def test_word_tokenizer_equals_library():
    t, plain = packing.WordTokenizer(word_tokenizer_file()), Tokenizer.from_file(word_tokenizer_file())
    texts = [*EDGE, "É 's don't <|endoftext|> x", "a<|endoftext|>B <|startoftext|><|endoftext|>. <|ENDOFTEXT|> <|endoftext |>", "ΣΑΣ ΑΣ. ", "é ́x", "İstanbul ﬁ ​ x\u0085y", "The the THE", "a\x01b \x01 c", "\x01"]
    assert t.encode(texts) == [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def brute_place(counts, capacity, length):
    """Gap (capacity: a new bin) with the least sum of squares of open gaps afterwards."""
    def total(gap):
        n = counts.copy()
        if gap < capacity:
            n[gap] -= 1
        if gap - length:
            n[gap - length] += 1
        return int((n[1:capacity] ** 2).sum())

    gaps = [g for g in range(length, capacity) if counts[g]] + [capacity]
    return min(total(g) for g in gaps), {g: total(g) for g in gaps}


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(0)
    bins = packing.SumOfSquares(32)
    fill = {}
    for length in rng.integers(1, 33, 600):
        best, totals = brute_place(bins.counts, 32, int(length))
        b, offset = bins.place(int(length))
        assert totals[32 - offset] == best
        assert fill.get(b, 0) == offset
        fill[b] = offset + int(length)
        assert fill[b] <= 32


def test_packing_has_no_gaps_and_few_bins():
    lengths = np.random.default_rng(1).lognormal(6.5, 1, 3000).astype(np.int64).clip(1, 4096)
    used = {}
    for seq, offset, length in sorted(zip(*(x.tolist() for x in packing.place_all(lengths)), lengths.tolist())):
        assert used.get(seq, 0) == offset
        used[seq] = offset + length
    assert max(used.values()) <= 4096
    assert len(used) <= 1.01 * lengths.sum() / 4096 + 1


def test_long_pieces_take_n_log_n_steps(codec, reference):
    rng = random.Random(1)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    texts = [run[:3000], "see " + "ab" * 900 + " and " + run[:1001] + "!", "é" * 500]
    assert [x.tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    words = packing.WordTokenizer(word_tokenizer_file())
    plain = Tokenizer.from_file(word_tokenizer_file())
    assert words.encode(texts) == [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    start = time.time()
    ids = codec.encode([run])[0]
    assert codec.decode(ids) == run.encode()
    assert len(words.encode([run])[0]) > 0
    assert time.time() - start < 90


def test_golay_indices_meet_within_two_bits():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    a, am = simhash.golay_indices(words)
    for n in (0, 1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, n, replace=False)) for _ in words])
        b, bm = simhash.golay_indices(words ^ flips)
        assert all(set(x[m]) & set(y[k]) for x, m, y, k in zip(a, am, b, bm))


def test_fuzzy_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    for n in (1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in fp], np.uint64)
        keys = []
        for x in (fp, fp ^ flips):
            at, key = simhash.fuzzy_keys(x)
            keys.append([set(key[at == i]) for i in range(len(fp))])
        assert all(a & b for a, b in zip(*keys))


def test_fingerprint_against_the_definition():
    import re

    import xxhash

    for text in ["", "  ", "One", "a b", "A b C d\te  f\x0bg", "x " * 50, "é Ü ß a b c", "a b c d"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_tree_with_factor_one_is_exact_with_ties():
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (700, 5)).astype(float)
    x[:300, 0], x[300:360] = 3, x[5]
    x = x[(x != 0).any(axis=1)]
    ids = rng.permutation(len(x)) * 7
    tree = vptree.Tree(ids, x, leaf=16)
    who = np.arange(0, len(x), 9)
    for floor in (None, np.full(len(who), 4.0)):
        row, found, score = tree.search(ids[who], x[who], 20, 1.0, floor)
        for i, w in enumerate(who.tolist()):
            want = sorted((-float(s), int(j)) for s, j in zip(x @ x[w], ids) if j != ids[w])[:20]
            got = [(-float(s), int(j)) for s, j in zip(score[row == i], found[row == i])]
            assert [g for g in got if floor is None or g[0] <= -4] == [v for v in want if floor is None or v[0] <= -4]


def test_grid_order_join_equals_brute_force():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12))
    x[500:] = x[:400] + rng.standard_normal((400, 12)) * 0.2
    u = ego.unit(x)
    _, axes = np.linalg.eigh(np.cov(u.T))
    near = np.add.reduce(u[:, None] * u[None], axis=2) >= 0.9
    np.fill_diagonal(near, False)
    weights = rng.integers(1, 4, 900)
    want = ego.roots_of(*np.nonzero(np.triu(near)), 900)
    blocks = [ego.Interval(u[a : a + 100], weights[a : a + 100], axes[:, ::-1]) for a in range(0, 900, 100)]
    band = list(range(9))
    links, root = ego.join_bands(blocks, band, band, 0.9)
    assert np.array_equal(links, near @ weights) and np.array_equal(root, want)
    links, root = ego.join_bands(blocks, band[:6], band[6:], 0.9)
    across = near.copy()
    across[:600, :600] = across[600:, 600:] = False
    assert np.array_equal(links, across @ weights) and np.array_equal(root, ego.roots_of(*np.nonzero(np.triu(across)), 900))
    root = ego.roots_of(np.array([1, 2, 7]), np.array([2, 3, 6]), 9)
    assert root.tolist() == [0, 1, 1, 1, 4, 5, 6, 6, 8]


def test_classifier_learns_and_covers_the_whole_text():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(120)).encode() for _ in range(80)]
    bad = [g[: rng.randint(0, len(g))] + b" | ### | " * 12 + g[:200] for g in good]
    same = [g[:100] + (word() + " ").encode() * 30 for g in good]
    data = good + bad + same
    y = np.array([1] * 80 + [0] * 160, np.float32)
    net = quality.train(data, y, epochs=10)
    s = net.scores(data)
    assert ((s >= 0.7) == (y == 1)).mean() > 0.95
    assert np.allclose(net.scores(data[:3]), s[:3]) and np.allclose(net.scores([data[100]]), s[100])
    assert 0 <= net.scores([b""])[0] <= 1 and len(net.scores([])) == 0
    tail = good[0] * 40 + b" | ### | " * 12
    assert net.scores([tail])[0] < net.scores([good[0] * 40])[0]
