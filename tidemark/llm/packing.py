"""Sum-of-squares packing of token sequences.

Texts become pieces where they lie; what moves is one short row for each piece. The rows are dealt evenly into
groups of bounded size, however many partitions the input has, and each group is packed longest first (Csirik et
al., J. ACM 2006): with N(g) open bins of residual gap g, a document of length s goes to the gap whose choice
leaves the sum of N(g)^2 smallest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.bpe import PairMerger, byte_slices, text_chunks
from tidemark.llm.common import checkpoint

CAPACITY, END_ID, CACHE_WORDS, GROUP_PIECES = 4096, 1, 500_000, 65_536
#: str.split() cuts at these, the tokenizer does not take them for white space.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: A control character between spaces is a token of its own, and no other character gives that token.
MARK, JOINED_WORDS = " \x01 ", 2000
#: Composed letters with one lower-case letter each, digits and plain punctuation.
LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9.,;:!?'\"()/%$#&*|+=_~<>@^-]+")
#: How the tokenizer splits such a word after lower-casing.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")



def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: the printable one itself, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordTokenizer:
    """A tokenizer whose tokens never cross white space, with a cache of what lies between white space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        # strings of added tokens in a text are these tokens, as the library has it; words that hold one are left to it
        self.added = tuple(t["content"] for t in whole.get("added_tokens") or ())
        self.spaced = tuple(t for t in self.added if t.split() != [t])
        vocab, suffix, pairs = model["vocab"], model["end_of_word_suffix"], {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault(vocab[a] << 32 | vocab[b], vocab[a + b])
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        # merging the lowest id first is merging by rank where ids rise with ranks; else the library does all
        ids = list(pairs.values())
        self.pairs = PairMerger(pairs) if ids == sorted(set(ids)) and len(ids) == len(model["merges"]) else None
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space by the library: many in a text, with a mark between them that none holds."""
        out: list[bytes] = []
        for a in range(0, len(words), JOINED_WORDS):
            part = words[a : a + JOINED_WORDS]
            text = MARK.join(part)
            if text.count(MARK[1]) != len(part) - 1:
                out += self._raw(part)
                continue
            ids = self._raw([text])[0]
            start = 0
            for end in np.append(np.flatnonzero(np.frombuffer(ids, "<u4") == self.mark) * 4, len(ids)).tolist():
                out.append(ids[start:end])
                start = end + 4
        return out

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by merging the vocabulary's own pairs for all of them at once."""
        flat = [p.encode() for p in pieces]
        lengths = np.array(list(map(len, flat)), np.int64)
        data = np.frombuffer(b"".join(flat), np.uint8)
        ids = self.inner[data]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[data[last]]
        return byte_slices(*self.pairs.merge_ids(ids, lengths))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space: plain Latin words piece by piece, others by the library."""
        # words of ASCII letters alone are one piece
        split = [w.lower() if w.isascii() and w.isalpha() else None for w in words] if self.pairs else [None] * len(words)
        mixed: dict[int, list[str]] = {}
        if self.pairs:
            plain, added, find = LATIN_WORD.fullmatch, self.added, PIECES.findall
            for i, p in enumerate(split):
                if p is None and plain(w := words[i]) and not ("<" in w and any(a in w for a in added)):
                    mixed[i] = find(w.lower())
        # a piece is a word whose only piece is itself, so the cache of words knows many
        pieces = {p for p in split if p is not None}.union(*mixed.values())
        new = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(new, self._merge(new) if new else ()))
        get = self.cache.get
        out = list(map(get, split))
        for i, ps in mixed.items():
            out[i] = b"".join(map(get, ps))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._joined([words[i] for i in rest])):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        apart = [any(c in t for c in (*NOT_SPACE, *self.spaced)) for t in texts]
        # Arrow cuts at the same characters as str.split(), and leaves empty words at white space on either end
        split = pc.utf8_split_whitespace(pa.array(["" if x else t for t, x in zip(texts, apart)], pa.string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > self.cache_words:
            # words that are still in use move on from the older half
            self.cache, self.older = {"": b""}, self.cache
        found = list(map(self.cache.get, distinct))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            missing = [distinct[i] for i in gaps]
            self.cache.update((w, self.older[w]) for w in missing if w in self.older)
            missing = [w for w in missing if w not in self.cache]
            self.cache.update(zip(missing, self._words(missing)))
            for i in gaps:
                found[i] = self.cache[distinct[i]]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(ids.buffers()[2] or b"")
        ends = at[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)].tolist()
        return [self._raw([t])[0] if x else bytes(data[a:b]) for t, x, a, b in zip(texts, apart, ends, ends[1:])]


class SumOfSquares:
    """Open bins of one group."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a document; length lies between 1 and the capacity."""
        n, c = self.counts, self.capacity
        # growth of the sum of squares, halved and less one, when the document goes into gap g: N(g - s) - N(g);
        # a gap that is filled exactly counts no more, a new bin counts as a gap that leaves none behind
        gain = n[: c - length + 1] - n[length:]
        gain[0] = -n[length]
        gain[n[length:] == 0] = 1 << 40
        at = int(gain.argmin())
        new = 2 * n[c - length] + 1 if length < c else 0
        best = (1 << 40) if n[at + length] == 0 else (2 * gain[at] + 2 if at else 1 - 2 * n[length])
        if best <= new:
            gap = at + length
            b = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, b = c, self.bins
            self.bins += 1
        left = gap - length
        if left:
            self.open[left].append(b)
            n[left] += 1
        return b, c - gap


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of the pieces of a document's ids."""
    step = 4 * capacity
    return [(piece, a // 4, len(ids[a : a + step]) // 4, zlib.crc32(ids[a : a + step])) for piece, a in enumerate(range(0, len(ids), step))]


def place_all(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, the longest placed first."""
    bins, out = SumOfSquares(capacity), np.zeros((2, len(lengths)), np.int64)
    for i in (-lengths).argsort(kind="stable").tolist():
        out[:, i] = bins.place(int(lengths[i]))
    return out[0], out[1]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
_TOKENIZERS: dict[str, WordTokenizer] = {}


def cut_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32; a document is its ids and then end_id."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _TOKENIZERS.get(tokenizer_file) or WordTokenizer(tokenizer_file)
        _TOKENIZERS[tokenizer_file] = t
        for keys, texts in text_chunks(batches):
            rows = [(key, *piece) for key, ids in zip(keys, t.encode(texts)) for piece in cut(ids + end, capacity)]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), _TYPES)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id; only documents longer than capacity are cut, into pieces of
    capacity ids, the last one shorter. Null and empty texts are the one id end_id. Repeated rows and null
    doc_ids are packed like any other; extra columns are dropped; an empty table gives an empty result.
    Pieces are dealt in turn to groups of about `group_pieces`, whatever they hold, so no key can be hot.
    sequence_id: the group's number in the upper bits.
    """
    pieces = checkpoint(cut_documents(docs, tokenizer_file, capacity, end_id))
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pieces_schema)
        if len(rows):
            b, offset = place_all(rows["length"].to_numpy(), capacity)
            base = TaskContext.get().partitionId() << 40
            for batch in rows.append_column("sequence_id", pa.array(base + b)).append_column("offset", pa.array(offset)).to_batches(10_000):
                yield batch

    pieces_schema = pa.schema(list(zip([c.split()[0] for c in PIECE.split(", ")], _TYPES)))
    return pieces.repartition(groups).mapInArrow(run, PIECE + ", sequence_id long, offset long")
