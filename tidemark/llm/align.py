"""Alignment of two tokenizers over the same text: groups of tokens that span the same bytes, and links between ids.

Tasks encode a batch of texts and mark the bytes at which tokens of either side end; bytes marked twice cut both token
rows into groups, for all texts of the batch in a few array steps. The last ids of a group's sides are a linked pair, and
what leaves a task is a digest and the linked pairs. Pairs are counted over the corpus with partial aggregation; documents get the counts back by a join in which
the pairs that fill the corpus are broadcast (at most 65,536 of them, by their share) and the others are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import text_chunks
from tidemark.llm.common import HEAVY, checkpoint, written
from tidemark.llm.packing import byte_symbols

#: Ids of B take the lower 16 bits of a pair.
B_BITS = 16
GROUPS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b", "n_groups")], T.StructField("groups_sha256", T.StringType(), False), T.StructField("pairs", T.ArrayType(T.LongType(), False), False)])
#: Words in a worker's cache, twice at most, the longest one that goes there, and characters encoded at a time.
CACHE_WORDS, CACHED_CHARS, CHUNK_CHARS = 120_000, 100, 400_000


MISSING = object()
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level_tokens(path: str) -> dict[int, bytes]:
    """The bytes of each token of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    value = {c: b for b, c in enumerate(byte_symbols())}
    return {i: bytes(map(value.__getitem__, t)) for t, i in vocab.items() if all(c in value for c in t)}


def byte_level_encoder(path: str, tokens: dict[int, bytes]) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by a byte-level BPE file, strings of special tokens as plain text.

    If the same vocabulary lies beside it as ranks, that file is used: several times as fast, with the same ids.
    """
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        if all(tokens.get(i) == t for t, i in merges.items()):
            encode = tiktoken.Encoding("pair", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
            return lambda texts: list(map(encode, texts))
    return library_encoder(path)


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def piece_tokens(path: str) -> tuple[object, dict[int, bytes]]:
    """The processor of a SentencePiece model, and the bytes of each of its pieces: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return model, {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}


class TokenPair:
    """Both tokenizers of a worker."""

    def __init__(self, a_file: str, b_file: str) -> None:
        a_bytes = byte_level_tokens(a_file)
        self.a = byte_level_encoder(a_file, a_bytes)
        self.b, b_bytes = piece_tokens(b_file)
        self.bytes = [[tokens.get(i, b"") for i in range(max(tokens) + 1)] for tokens in (a_bytes, b_bytes)]
        self.lengths = [np.array([len(t) for t in table], np.int32) for table in self.bytes]
        self.cut = not any(re.search(r"\S ", t.decode(errors="replace")) for table in self.bytes for t in table)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _direct(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of each text, little-endian; None where the bytes of one side are not those of the text."""
        spaced = [" " + t for t in texts]
        out = []
        for s, ids in zip(spaced, zip(self.a(spaced), self.b.encode(texts, num_threads=1))):
            whole = s.encode()
            same = all(b"".join(map(t.__getitem__, i)) == whole for t, i in zip(self.bytes, ids))
            out.append(tuple(np.array(i, "<i4").tobytes() for i in ids) if same else None)
        return out

    def _joined(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """_direct for words without white space at their ends, all in one text: their tokens end where they end."""
        if not words:
            return []
        text = " ".join(words)
        whole = (" " + text).encode()
        ends = np.array([len(w) if w.isascii() else len(w.encode()) for w in words], np.int64).cumsum() + np.arange(1, len(words) + 1)
        sides = []
        for ids, table, lengths in zip((self.a([" " + text])[0], self.b.encode(text)), self.bytes, self.lengths):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return self._direct(words)
            ids = np.array(ids, "<i4")
            at = lengths[ids].cumsum(dtype=np.int64)
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return self._direct(words)
            data, cuts = ids.tobytes(), ((last + 1) * 4).tolist()
            sides.append([data[x:y] for x, y in zip([0, *cuts], cuts)])
        return list(zip(*sides))

    def _chunked(self, texts: list[list[str]]) -> list[list[tuple[bytes, bytes] | None]]:
        """_direct for each chunk of each text, chunks in use kept in a cache of two halves."""
        flat = [c for t in texts for c in t]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, flat, itertools.repeat(MISSING)))
        gaps = [i for i, x in enumerate(found) if x is MISSING]
        missing = {flat[i] for i in gaps}
        new = {c: self.older[c] for c in missing if c in self.older}
        missing.difference_update(new)
        words = [c for c in missing if not c[0].isspace() and not c[-1].isspace()]
        rest = list(missing.difference(words))
        new.update(zip(words, self._joined(words) if self.cut else self._direct(words)))
        new.update(zip(rest, self._direct(rest)))
        for i in gaps:
            found[i] = new[flat[i]]
        self.cache.update((c, x) for c, x in new.items() if len(c) <= CACHED_CHARS)
        ends = list(itertools.accumulate(map(len, texts)))
        return [found[b - len(t) : b] for t, b in zip(texts, ends)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(a_ids, a_ends, b_ids, b_ends) of each text; all empty where the bytes of one side are not those of the text.

        Neither side joins a character and a space that follows it, so texts are cut at single spaces between words.
        """
        chunks = [(CUT.split(t) if self.cut else [t]) if t else [] for t in texts]
        for text, parts in zip(texts, self._chunked(chunks)):
            if None in parts:
                # the parts' bytes could still make up for each other
                parts = self._direct([text])
            sides = zip(*parts) if parts and None not in parts else ((), ())
            out = []
            for side, n in zip(sides, self.lengths):
                ids = np.frombuffer(b"".join(side), "<i4")
                out += [ids, n[ids].cumsum(dtype=np.int32)]
            yield tuple(out)


_PAIRS: dict[tuple[str, str], TokenPair] = {}


class Grouper:
    """Groups and links of the texts of a batch, all at once, from the ids of both sides and the bytes at which they end."""

    def __init__(self, n_a: int, n_b: int) -> None:
        decimal = [str(i).encode() for i in range(max(n_a, n_b))]
        #: Each id as text before a comma, the bar between a group's sides and the semicolon after it.
        self.text = pa.array([d + end for d in decimal for end in (b",", b"|", b";")], pa.large_binary())

    def rows(self, encoded: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        """n_a, n_b, n_groups, groups_sha256 and pairs (a_id * 65536 + b_id, one a link) of each text."""
        n_a, n_b = (np.array([len(x[i]) for x in encoded], np.int64) for i in (0, 2))
        a, a_ends, b, b_ends = (np.concatenate(x).astype(np.int64) for x in zip(*encoded))
        size = np.array([int(x[1][-1]) if len(x[1]) else 0 for x in encoded], np.int64)
        shift = np.cumsum(size) - size
        a_ends += np.repeat(shift, n_a)
        b_ends += np.repeat(shift, n_b)
        marks = np.zeros((2, int(size.sum()) + 1), bool)
        marks[0, a_ends] = marks[1, b_ends] = True
        # the last id of a group on either side, and the number of groups that are over before an id
        a_last, b_last = marks[1, a_ends], marks[0, b_ends]
        a_at, b_at = np.flatnonzero(a_last), np.flatnonzero(b_last)
        a_over, b_over = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_at + 1])[a_over]] = a * 3 + a_last
        order[np.arange(len(b)) + (a_at + 1)[b_over]] = b * 3 + 2 * b_last
        text = self.text.take(pa.array(order))
        data = memoryview(text.buffers()[2] or b"")
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1] if len(order) else np.zeros(1, np.int64)
        ends = at[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
        cuts = np.searchsorted(a_at, np.concatenate([[0], np.cumsum(n_a)]))
        pairs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(a[a_at] << B_BITS | b[b_at]), pa.list_(pa.field("element", pa.int64(), False)))
        return [pa.array(n_a), pa.array(n_b), pa.array(np.diff(cuts)), pa.array(digests, pa.string()), pairs]


_PAIRS: dict[tuple[str, str], tuple[TokenPair, Grouper]] = {}


def groups(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and pairs of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_file, b_file)
        if key not in _PAIRS:
            pair = TokenPair(*key)
            _PAIRS[key] = pair, Grouper(*map(len, pair.bytes))
        pair, grouper = _PAIRS[key]
        for keys, texts in text_chunks(batches, CHUNK_CHARS):
            yield pa.record_batch([pa.array(keys, pa.int64()), *grouper.rows(list(pair.encode(texts)))], GROUPS.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, GROUPS)


def pair_counts(links: DataFrame) -> DataFrame:
    """Rows (pair, n, best): links of each pair, and 1 if no other pair of its B id has more, else 0.

    Counted before the shuffle; a B id has at most one row for each A id.
    """
    counted = checkpoint(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1)))
    return checkpoint(counted.withColumn("best", (F.col("n") == most).cast("long")))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose tokens of one side do not give the text's own bytes back (a tokenizer that
    normalises), have no tokens: all zeros and an empty groups_sha256. Repeated rows and null doc_ids count like any
    other; extra columns are dropped; an empty table gives an empty result.
    """
    table = written(groups(docs, a_file, b_file).withColumn("n_links", F.col("n_groups")).withColumn("row", F.monotonically_increasing_id()))
    links = table.select("row", F.explode("pairs").alias("pair"))
    counts = pair_counts(links)
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy, light = counts.filter(F.col("n") > total / HEAVY), counts.filter(F.col("n") <= total / HEAVY)
    # a heavy pair is answered where its link lies; all those of a document share a key that no pair has
    key = F.when(F.col("n").isNull(), F.col("pair")).otherwise(-1 - F.col("row"))
    told = links.join(F.broadcast(heavy), "pair", "left").groupBy("row", key.alias("pair")).agg(F.sum("n").alias("sum"), F.sum("best").alias("best_sum"), F.count(F.lit(1)).alias("links"))
    each = told.join(light, "pair", "left").select("row", F.coalesce("sum", F.col("links") * F.col("n")).alias("sum"), F.coalesce("best_sum", F.col("links") * F.col("best")).alias("best"))
    sums = each.groupBy("row").agg(F.sum("sum").alias("count_sum"), F.sum("best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
