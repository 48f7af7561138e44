"""Groups of a batch of texts in array steps, against groups made by hand."""

import hashlib

import numpy as np

from tidemark.llm import align


def test_groups_of_a_batch():
    texts = [([1, 2, 3], [2, 4, 6], [7, 8], [4, 6]), ([], [], [], []), ([5], [3], [6, 0, 9], [1, 2, 3]), ([11, 12], [2, 3], [10, 9], [2, 3]), ([], [], [], [])]
    rows = align.Grouper(13, 11).rows([tuple(np.array(x, np.int32) for x in t) for t in texts])
    n_a, n_b, n, digests, pairs = (x.to_pylist() for x in rows)
    want = ["1,2|7;3|8", "", "5|6,0,9", "11|10;12|9", ""]
    assert (n_a, n_b, n) == ([3, 0, 1, 2, 0], [2, 0, 3, 2, 0], [2, 0, 1, 2, 0])
    assert digests == [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in want]
    assert pairs == [[2 << 16 | 7, 3 << 16 | 8], [], [5 << 16 | 9], [11 << 16 | 10, 12 << 16 | 9], []]
    assert [x.to_pylist() for x in align.Grouper(13, 11).rows([tuple(np.zeros(0, np.int32) for _ in range(4))])] == [[0], [0], [0], [""], [[]]]
