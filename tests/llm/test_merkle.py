"""The manifest against plain loops: nulls, ties, repeated rows, hot and many trees, extra columns, no rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, root string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(nodes):
    """(root, siblings of each node by level): plain lists, one level after the other."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            p.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = lambda t: sha("".join(map(part, (doc_id, source, lang, n_chars, t))))  # noqa: E731, B023
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees[lang].append((doc_id is not None, doc_id or 0, leaf(text), leaf(low) if chosen else leaf(text), doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: grow([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    if not langs:
        return []
    root, tops = grow([built[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (_, _, leaf, now, doc_id), path in zip(sorted(trees[lang], key=lambda x: x[:3]), built[lang][1]):
            fold = now
            for a, b in path + top:
                fold = sha(a + fold + b)
            out.append((doc_id, leaf, built[lang][0], root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def rows_of(n, langs, text=lambda i: f"Text {i}"):
    return [(i, text(i), langs[i % len(langs)], "s", 5, "x", "y") for i in range(n)]


CASES = {
    "empty": [],
    "one": rows_of(1, ["en"]),
    "nulls": [(None, None, None, None, None, None, None), (3, None, "en", None, 1, "", ""), (None, "Ä A", "en", "s", None, "", ""), (3, "", "", "", 0, "", ""), (9, "B" * 100_000, None, "s", 2, "", "")],
    "repeats": rows_of(3, ["en"]) * 7 + [(1, "other", "en", "s", 5, "", "")],
    "runs": [r for k, n in enumerate((1, 2, 7, 8, 9, 63, 64, 65)) for r in rows_of(n, [f"l{k}"])],
    "blocks": rows_of(1100, ["hot"]) + rows_of(512, ["whole"]) + rows_of(513, ["over"]),
    "langs": rows_of(1300, [f"l{k}" for k in range(650)]),
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_plain_loops(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=repr) == brute(rows)


def test_deep_tree(spark, monkeypatch):
    """Many rounds: blocks of two levels of two children."""
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = rows_of(700, ["a", "b"])
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_tampering_is_found(spark):
    rows = rows_of(40, ["en"])
    found = {r["doc_id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 3 != 0 for i in range(40)}
