"""Terms that disclose rare entities, wherever they stand."""

import math
import random
import re
from collections import Counter

import xxhash

from tidemark.llm import pii


def clean(spark, special):
    filler = [f"the word number {i} is here please ask for about room 5 and more of it" for i in range(300)]
    df = spark.createDataFrame(list(enumerate([*special, *filler])), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert [rows[len(special) + i] for i in range(300)] == filler
    digest = {r["doc_id"]: r for r in pii.pii_digest(df).collect()}
    for i, t in enumerate(special):
        spans = [x.split(":") for x in digest[i]["spans"].split(",") if x]
        assert len(re.findall(r"\[(?:NAME|WORD|ACRONYM)\]", rows[i])) == digest[i]["n_generalised"] == sum(k == "term" for k, _, _ in spans) - digest[i]["n_removed"]
        assert all(t[int(a) : int(b)].isalpha() for k, a, b in spans if k == "term")
    return [rows[i] for i in range(len(special))]


def test_one_document_is_no_evidence(spark):
    text = "please ask Zanzibar for ann@x.org about it"
    assert clean(spark, [text]) == ["please ask Zanzibar for [EMAIL] about it"]


def test_a_term_beside_an_entity_in_two_surroundings(spark):
    got = clean(spark, ["please ask Zanzibar for ann@x.org about it", "yesterday evening Zanzibar wrote ann@x.org some letter"])
    assert got == ["please ask  for [EMAIL] about it", "yesterday evening  wrote [EMAIL] some letter"]


def test_copies_are_one_context(spark):
    text = "please ask Zanzibar for ann@x.org about it"
    assert clean(spark, [text] * 5) == ["please ask Zanzibar for [EMAIL] about it"] * 5
    assert clean(spark, [text, text + " and so on, with 3 " + "more " * 40]) [0] == "please ask Zanzibar for [EMAIL] about it"


def test_addresses_of_one_domain_are_an_entity(spark):
    rest = ["please ask Zanzibar for {} about it", "yesterday evening Zanzibar wrote {} some letter", "never since had Zanzibar called upon {} at noon"]
    got = clean(spark, [t.format(f"p{i}@x.org") for i, t in enumerate(rest)])
    assert got == [t.format("[EMAIL]").replace("Zanzibar", "") for t in rest]


def test_the_term_goes_everywhere(spark):
    got = clean(spark, ["Zanzibar, ask ann@x.org about zanzibar", "yesterday evening Zanzibar wrote ann@x.org some letter", "never since had Zanzibar called upon ann@x.org at noon", "and " * 60 + "more of Zanzibar-based it"])
    assert got[0] == "[NAME], ask [EMAIL] about [WORD]" and got[1].startswith("yesterday evening [NAME] ") and got[3] == "and " * 60 + "more of [NAME]-based it"


def test_planted_names(spark):
    """Names beside their own address in four texts each are told, all; other words, rare ones beside addresses included, are not."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    word = lambda: rng.choice(words[:20]) if rng.random() < 0.3 else words[int(4000 * rng.random() ** 2)]
    prose = lambda k: [word() for _ in range(k)]
    names = ["Q" + "".join(rng.choice("bdfgkp") for _ in range(7)) for _ in range(25)]
    texts = [" ".join([*prose(rng.randint(5, 30)), name, f"{name[1:5].lower()}{i}@mail{i % 7}.org", *prose(20)]) for i, name in enumerate(names) for _ in range(4)]
    texts += [" ".join([*prose(rng.randint(5, 30)), f"u{i}@mail{i % 7}.org", *prose(20)]) for i in range(200)] + [" ".join(prose(40)) for _ in range(700)]
    got = [r["text"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert not any(n in t for n in names for t in got) and got[300:] == texts[300:]
    assert all(re.sub(r"Q[bdfgkp]{7}", "", re.sub(r"\S+@\S+", "[EMAIL]", t)) == g for t, g in zip(texts, got))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "card": r"[0-9](?:[\x20-]?[0-9])+"}


def brute_spans(texts):
    """Spans of texts with e-mail and card entities only, by plain loops."""
    def luhn(m):
        digits = re.sub("[^0-9]", "", m)
        return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0

    entities = [[(k, m.start(), m.end(), m[0].lower() if k == "email" else re.sub("[^0-9]", "", m[0])) for k, p in BASE.items() for m in re.finditer(p, t) if k == "email" or luhn(m[0])] for t in texts]
    df = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]+", t.lower())))
    near, hash_of = [], lambda w, i: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64(f"{w}{i}".encode(), seed=42).intdigest())
    for t, es in zip(texts, entities):
        for k, a, b, v in es:
            term = r"(?<!\S)[^\w\s@]{0,4}([^\W\d_]{2,})[^\w\s@]{0,4}(?!\S)"
            left = [m[1].lower() for m in re.finditer(term, t) if m.start() >= a - 160 and m.end() <= a][-6:]
            right = [m[1].lower() for m in re.finditer(term, t) if m.start() >= b and m.end() <= b + 160][:6]
            terms = left[::-1] + right
            grams = [f"{x} {y}" for x, y in zip(terms, terms[1:])] or terms
            mins = [min((hash_of(w, i) for w in grams), default=0) for i in range(2)]
            pools = [(k, v), (k, v[v.index("@") :])] if k == "email" else [(k, v)]
            near += [(e, w, t, *mins) for e in pools for w in {*left, *right, None}]
    contexts = lambda rows: min(len({r[i] for r in rows}) for i in (2, 3, 4))
    by_entity, by_pair = {}, {}
    for r in near:
        by_entity.setdefault(r[0], []).append(r)
        if r[1]:
            by_pair.setdefault(r[:2], []).append(r)
    told = set()
    n = len(texts)
    for (e, w), rows in by_pair.items():
        both, holders = contexts(rows), contexts(by_entity[e])
        if both >= 2:
            expected = holders * df[w] / n
            chance = both - expected + both * math.log(expected / both) + math.log(len(by_pair))
            if both > expected and chance < math.log(0.01) and math.log2(both / expected) / math.log2(n / holders) >= pii.GENERALISE_AT:
                told.add(w)
    out = []
    for t, es in zip(texts, entities):
        spans = [(["email", "card"].index(k), k, a, b) for k, a, b, _ in es]
        for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]+", t):
            if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, _, a, b in spans[: len(es)]):
                spans.append((9, "term", m.start(), m.end()))
        out.append(",".join(f"{k}:{a}:{b}" for _, k, a, b in sorted(spans)))
    return out


def test_spans_equal_plain_loops(spark):
    rng = random.Random(5)
    common, rare = ["order", "ship", "the", "bill", "to", "Room", "of"], [f"{a}{b}{'abcdefgh'[c]}x" for a in ("Qua", "zor", "Mil", "pen", "Vor") for b in ("ta", "ri", "lo", "ne") for c in range(8)]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112"]

    def text():
        words = [rng.choice(common) if rng.random() < 0.97 else rng.choice(rare) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            x = rng.choice([f"u{rng.randint(0, 40)}@d{rng.randint(0, 3)}.org", rng.choice(cards), str(rng.randint(1, 3000)), "(" + rng.choice(rare) + "),"])
            words.insert(rng.randint(0, len(words)), x)
        return " ".join(words)

    def member(i):
        words = [rng.choice(common) for _ in range(rng.randint(12, 40))]
        at = rng.randint(0, len(words))
        return " ".join(words[:at] + [rng.choice(rare), f"{'Mem' if i % 2 else 'KIN'}{'abcdefgh'[i % 8]}", f"m{i % 8}@d{i % 4}.org"] + [rng.choice(rare) for _ in range(4)] + words[at:])

    texts = ["Zanzibar order 2020 Quixote member: 4012 8888 8888 1881", "", *[text() for _ in range(300)], *[member(i) for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in pii.pii_digest(df).orderBy("doc_id").collect()]
    want = brute_spans(texts)
    assert got == want and sum(w.count("term") for w in want) > 10 and want[0].count("term") == 0
