"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Each code point becomes one of eight classes (with the
look-ahead that the pattern needs folded into the class), a class is a function from automaton states to
automaton states, and function composition is associative: equal blocks of the text are scanned side by
side for all start states at once, the block functions are composed, and a second pass gives every code
point its state. A table of (state, class) then tells where a piece begins. Pieces feed a cache of merges;
pieces that it does not hold are merged together, one pair a round for all of them at once, and very long ones
by a heap of pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Classes: letter, number, other, apostrophe that starts a contraction with one or with two letters, white
#: space inside or at the end of a run, a space before a visible character, other white space before one.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, PREFIX, SINGLE = range(8)
#: States: a piece has just ended; inside letters, numbers, others, white space; after a prefix space; one or two letters of a contraction left.
END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_PREFIX, ONE_LEFT, TWO_LEFT = range(8)
BLOCK, CHUNK_CHARS, CACHE_PIECES = 128, 1 << 20, 500_000
NO_PAIR = 1 << 40
#: Words with more ids than this are merged by a heap, in n log n steps.
LONG_WORD = 400


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, for class * 8 + state."""
    step, begins = np.zeros(64, np.uint8), np.zeros(64, bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    for c in range(8):
        for s in range(8):
            if c in runs:
                joins = s in (runs[c], AFTER_PREFIX)
                nxt = runs[c]
                if c == LETTER and s in (ONE_LEFT, TWO_LEFT):
                    joins, nxt = True, END if s == ONE_LEFT else ONE_LEFT
                elif c in (SHORT, LONG) and not joins:
                    nxt = ONE_LEFT if c == SHORT else TWO_LEFT
            elif c == SPACES:
                joins, nxt = s == IN_SPACES, IN_SPACES
            else:
                joins, nxt = False, AFTER_PREFIX if c == PREFIX else END
            step[c * 8 + s], begins[c * 8 + s] = nxt, not joins
    return step, begins


STEP, BEGINS = _automaton()
_CLASSES: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Letter, number, other or white space (as SPACES) for every code point, by the Unicode database."""
    if not _CLASSES:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        import regex

        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACES)):
            for m in regex.finditer(pattern, everything):
                a, b = ord(everything[m.start()]), ord(everything[m.end() - 1])
                table[a : b + 1] = c
        table[0xD800:0xE000] = OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def classify(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points of several texts in a row; ends: exclusive ends of the texts, none of them empty."""
    c = _class_table()[cp]
    last = np.zeros(len(cp), bool)
    last[ends - 1] = True
    ahead = np.empty_like(c)
    ahead[:-1], ahead[-1:] = c[1:], SPACES
    ahead[last] = SPACES
    before_visible = (c == SPACES) & (ahead != SPACES)
    spot = np.flatnonzero(cp == 39)
    if len(spot):
        text_end = ends[np.searchsorted(ends, spot, side="right")]
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one = np.where(spot + 1 < text_end, padded[spot + 1], 0)
        two = np.where(spot + 2 < text_end, padded[spot + 2], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        c[spot[short]], c[spot[long]] = SHORT, LONG
    c[before_visible] = np.where(cp[before_visible] == 32, PREFIX, SINGLE)
    return c


def states(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """State before each code point; a text that starts at one of starts begins in END."""
    n = len(c)
    width = -(-n // BLOCK)
    flat = np.zeros(width * BLOCK, np.uint8)
    flat[:n] = c
    fresh = np.zeros(width * BLOCK, bool)
    fresh[starts] = True
    by_step = np.ascontiguousarray(flat.reshape(width, BLOCK).T)
    fresh_step = np.ascontiguousarray(fresh.reshape(width, BLOCK).T)
    any_fresh = fresh_step.any(axis=1)
    function = np.broadcast_to(np.arange(8, dtype=np.uint8), (width, 8)).copy()
    for j in range(BLOCK):
        if any_fresh[j]:
            function[fresh_step[j]] = END
        function = STEP.take((by_step[j] * 8)[:, None] + function)
    # compose the block functions: an inclusive scan by doubling
    scanned, d = function, 1
    while d < width:
        nxt = scanned.copy()
        nxt[d:] = np.take_along_axis(scanned[d:], scanned[:-d], axis=1)
        scanned, d = nxt, 2 * d
    at = np.zeros(width, np.uint8)
    at[1:] = scanned[:-1, END]
    out = np.empty((BLOCK, width), np.uint8)
    for j in range(BLOCK):
        if any_fresh[j]:
            at[fresh_step[j]] = END
        out[j] = at
        at = STEP.take(by_step[j] * 8 + at)
    return out.T.reshape(-1)[:n]


def piece_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, positions where pieces begin, lengths of the texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return cp, np.zeros(0, np.int64), lengths
    ends = np.cumsum(lengths)
    full = lengths > 0
    c = classify(cp, ends[full])
    starts = (ends - lengths)[full]
    begins = BEGINS.take(c * 8 + states(c, starts))
    begins[starts] = True
    return cp, np.flatnonzero(begins), lengths


def pieces(texts: list[str]) -> tuple[list[str], list[int]]:
    """The pieces of all texts in a row, and how many each text has."""
    cp, begin, lengths = piece_starts(texts)
    if not len(cp):
        return [], [0] * len(texts)
    # a mark that no text holds is put before every piece but the first; split() then cuts all at once
    mark = next(m for m in (0x10FFFF, 0x10FFFE, 0xFFFFF, 0xFFFFE, *range(0xE000, 0xF8FF)) if not (cp == m).any())
    joined = np.insert(cp, begin[1:], np.uint32(mark)).tobytes().decode("utf-32-le", "surrogatepass").split(chr(mark))
    return joined, np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(lengths)]))).tolist()


class PairMerger:
    """Byte-pair merging for a table of pairs and the ids they become; a lower id merges first."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self._index_pairs(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _index_pairs(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """An open hash table of mergeable pairs in two arrays; a key lies at most self.probes places after its slot."""
        self.table_keys = np.full((1 << 21) + 64, -1, np.int64)
        self.table_ids = np.full((1 << 21) + 64, NO_PAIR, np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left]) + self.probes
            free = self.table_keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.table_keys[at[put]], self.table_ids[at[put]] = keys[left[put]], ids[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs; NO_PAIR where a pair does not merge."""
        key = left << 32 | right
        at = self._slot(key)
        out = np.where(self.table_keys[at] == key, self.table_ids[at], NO_PAIR)
        open_ = np.flatnonzero((out == NO_PAIR) & (self.table_keys[at] != -1))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at_k = at[open_] + k
            found = self.table_keys[at_k] == key[open_]
            out[open_[found]] = self.table_ids[at_k[found]]
            open_ = open_[~found & (self.table_keys[at_k] != -1)]
        return out

    def _merge_long(self, ids: np.ndarray) -> list[int]:
        """The merged ids of one word: a heap of (id, place) over a linked list, stale entries skipped."""
        n = len(ids)
        merged = self._merged(ids[:-1], ids[1:])
        at = np.flatnonzero(merged < NO_PAIR)
        heap = (merged[at] << 32 | at).tolist()
        heapq.heapify(heap)
        token, after, before = ids.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        known: dict[int, int] = {}

        def pair(i: int, j: int) -> int:
            key = token[i] << 32 | token[j]
            if key not in known:
                known[key] = int(self._merged(np.array([token[i]]), np.array([token[j]]))[0])
            return known[key]

        while heap:
            top = heapq.heappop(heap)
            new, i = top >> 32, top & 0xFFFFFFFF
            j = after[i] if token[i] >= 0 else -1
            if j < 0 or pair(i, j) != new:
                continue
            token[i], token[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                x = pair(i, after[i])
                if x < NO_PAIR:
                    heapq.heappush(heap, x << 32 | i)
            if before[i] >= 0:
                x = pair(before[i], i)
                if x < NO_PAIR:
                    heapq.heappush(heap, x << 32 | before[i])
        return [x for x in token if x >= 0]

    def merge_ids(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged ids of all words in a row, number of ids of each): the pair with the lowest id first, the leftmost of equals."""
        long = np.flatnonzero(lengths > LONG_WORD)
        if not len(long):
            return self._merge_rounds(ids, lengths)
        ends, counts, parts = np.cumsum(lengths), np.zeros(len(lengths), np.int64), []
        for a, b in zip([-1, *long.tolist()], [*long.tolist(), len(lengths)]):
            # the words between two long ones, then the long one
            first = ends[a] if a >= 0 else 0
            last = ends[b] - lengths[b] if b < len(lengths) else len(ids)
            if b > a + 1:
                short, counts[a + 1 : b] = self._merge_rounds(ids[first:last], lengths[a + 1 : b])
                parts.append(short)
            if b < len(lengths):
                parts.append(np.array(self._merge_long(ids[last : ends[b]]), np.int64))
                counts[b] = len(parts[-1])
        return np.concatenate(parts), counts

    def _merge_rounds(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge_ids for short words: one merge a round in each word, all words at once."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        pair = np.full(len(ids), NO_PAIR, np.int64)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        pair[same] = self._merged(ids[same], ids[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(pair, first)
            live = best < NO_PAIR
            counts = np.diff(np.concatenate([first, [len(ids)]]))
            over = np.repeat(~live, counts)
            done.append((owner[over], ids[over]))
            hit = np.flatnonzero(pair == np.repeat(np.where(live, best, -1), counts))
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            ids = ids.copy()
            ids[hit] = pair[hit]
            keep = np.repeat(live, counts)
            keep[hit + 1] = False
            at = np.cumsum(keep) - 1
            ids, owner, pair = ids[keep], owner[keep], pair[keep]
            # only the pairs on either side of a merged token have changed
            hit = at[hit]
            pair[hit] = NO_PAIR
            for i in (hit, hit[hit > 0] - 1):
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                pair[i] = self._merged(ids[i], ids[i + 1])
        if not done:
            return ids, np.zeros(len(lengths), np.int64)
        owners, merged = (np.concatenate(x) for x in zip(*done))
        return merged[owners.argsort(kind="stable")], np.bincount(owners, minlength=len(lengths))


def byte_slices(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers."""
    data = ids.astype("<u4").tobytes()
    ends = (np.cumsum(counts) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder for a rank file: base64 bytes and id a line."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * size
        for k, v in self.ranks.items():
            self.vocabulary[v] = k
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = PairMerger(pairs)
        self.lengths = np.array([len(x) for x in self.vocabulary], np.int64)
        self.flat = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.cache_pieces = cache_pieces
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece as bytes; a piece that is a token itself is that token."""
        out = [self.ranks.get(w) for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        ids = self.byte_id[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
        merged = byte_slices(*self.pairs.merge_ids(ids, np.array([len(words[i]) for i in todo], np.int64)))
        for i, x in zip(todo, merged):
            out[i] = x
        return [x.to_bytes(4, "little") if isinstance(x, int) else x for x in out]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32 arrays."""
        flat, counts = pieces(texts)
        if len(self.cache) > self.cache_pieces:
            # pieces that are still in use move on from the older half
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, flat))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            missing = {flat[i] for i in gaps}
            self.cache.update((p, self.older[p]) for p in missing if p in self.older)
            missing = [p for p in missing if p not in self.cache]
            self.cache.update(zip(missing, self.merge([p.encode("utf-8", "surrogatepass") for p in missing])))
            for i in gaps:
                found[i] = self.cache[flat[i]]
        out, at = [], 0
        for n in counts:
            out.append(np.frombuffer(b"".join(found[at : at + n]), "<u4"))
            at += n
        return out

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every token in the decoded text, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, gathered in one step."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - n), n)
        return self.flat[index].tobytes()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker for a rank file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def text_chunks(batches: Iterator[pa.RecordBatch], max_chars: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in groups of about max_chars; a longer text forms a group alone. Null text: empty."""
    for batch in batches:
        ids, texts, size = [], [], 0
        column = batch.column(1)
        for i, key in enumerate(batch.column(0).to_pylist()):
            t = column[i].as_py() or ""
            if texts and size + len(t) > max_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts


def encode_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (byte offset of each token, then the end) of every row of docs.

    Null and empty texts have no ids and the one offset 0; each match of the pattern is encoded alone,
    strings of special tokens are ordinary text. Every row gives one row, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for keys, texts in text_chunks(batches):
            ids = c.encode(texts)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.token_offsets(x) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def encode_digest(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        decimal = [str(i) for i in range(len(c.vocabulary))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for keys, texts in text_chunks(batches):
            ids = c.encode(texts)
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(decimal.__getitem__, x.tolist())).encode()) for x in ids]), pa.array([sha(c.decode(x)) for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
