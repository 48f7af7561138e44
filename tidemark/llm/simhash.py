"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 21, 21 and 22 bits. Two fingerprints that differ in at most two
bits agree exactly in some segment i while the next segment (cyclically) differs in at most one bit: with
two bad segments each has one error, with one bad segment i is chosen so that the next one is the other
good one. The exact segment is paired with codeword indices of the next one: each 23-bit word (segments are
padded with zeros) lies within distance 3 of exactly one codeword of the perfect Golay code, and words at
distance 3 also get the five codewords at distance 4; two words at most two bits apart then share an index.
That gives three to eighteen keys for each fingerprint.

Copies are collapsed before any key is made. Fingerprints that share a key are not expanded into pairs, as a key may
have any number of them: the key is divided by a second one, the words at most one bit away (the exact segment kept).
Two fingerprints of a key share such a word exactly if they differ in at most two bits, so each (key, word) is a
group of at most 44 fingerprints; those are verified against its least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks
from tidemark.llm.common import checkpoint, row_key
from tidemark.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; see fingerprint_documents."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes set; none: zero."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        bits = np.unpackbits(h[a : a + 8192, None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit) and text_hash of every row of docs.

    A-Z is lower-cased, words are cut at ASCII white space, shingles of three words are hashed with XXH64
    (seed 42) and a bit is set if more than half the hashes have it. Fewer words: one shingle of them all;
    none, or a null text: zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # text_chunks gives texts in order, so ids and hashes can be cut alongside
            at = 0
            for keys, texts in text_chunks([batch]):
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(fps), batch.column(2).slice(at, len(keys))], ["doc_id", "fp", "text_hash"])
                at += len(keys)

    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", text_hash).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    w = np.array(word, np.int64)
    for bit in range(22, 10, -1):
        w ^= np.where(w >> bit & 1, GENERATOR << (bit - 11), 0)
    return w


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error of at most three bits for each syndrome, its weight, the words of weight 7 that contain it).

    The code is perfect, so the 2048 errors of weight up to three have the 2048 syndromes. The third table has
    five code words for each error of weight three, zeros elsewhere.
    """
    one = 1 << np.arange(23)
    errors = [0, *one.tolist(), *(int(one[i] | one[j]) for i in range(23) for j in range(i)), *(int(one[i] | one[j] | one[k]) for i in range(23) for j in range(i) for k in range(j))]
    table = np.zeros(2048, np.int64)
    table[_syndrome(np.array(errors))] = errors
    weight = np.bitwise_count(table.astype(np.uint64)).astype(np.int64)
    messages = np.arange(4096, dtype=np.int64) << 11
    code = messages ^ _syndrome(messages)
    sevens = code[np.bitwise_count(code.astype(np.uint64)) == 7]
    more = np.zeros((2048, 5), np.int64)
    for s in np.flatnonzero(weight == 3):
        more[s] = sevens[(sevens & table[s]) == table[s]]
    return table, weight, more


def golay_indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 codeword indices, n x 6 mask of those that count) of 23-bit words."""
    table, weight, more = golay_tables()
    s = _syndrome(word)
    nearest = word ^ table[s]
    near = np.concatenate([nearest[:, None], nearest[:, None] ^ more[s]], axis=1)
    mask = np.ones(near.shape, bool)
    mask[:, 1:] = (weight[s] == 3)[:, None]
    return near >> 11, mask


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) for all keys of unsigned 64-bit fingerprints."""
    parts = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    where, keys = [], []
    for i in range(3):
        index, mask = golay_indices(parts[(i + 1) % 3])
        key = (np.int64(i) << 34 | parts[i] << 12)[:, None] | index
        row = np.broadcast_to(np.arange(len(fp))[:, None], key.shape)
        where.append(row[mask])
        keys.append(key[mask])
    return np.concatenate(where), np.concatenate(keys)


def near_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints of fps (distinct, column fp) at most two bits apart.

    Every such pair is linked directly or through others at most two bits apart; no edge joins any other two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, key = fuzzy_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(fp[at])], ["key", "fp"])

    keys = checkpoint(fps.mapInArrow(run, "key long, fp long"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    live = keys.join(shared, "key")
    others = F.array(*[F.array(*[F.lit(b) for b in range(64) if not at <= b < at + n]) for at, n in SEGMENTS])
    free = live.select("key", "fp", F.element_at(others, F.shiftright("key", 34).cast("int") + 1).alias("bits"))
    words = free.select("key", "fp", F.explode(F.expr("concat(array(fp), transform(bits, b -> fp ^ shiftleft(1L, b)))")).alias("word"))
    met = words.groupBy("key", "word").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter(f"a != b AND bit_count(a ^ b) <= {MAX_BITS}").distinct()


def members(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, root (a fingerprint for each component) and component_id of every row of docs."""
    prints = checkpoint(fingerprint_documents(docs))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_edges(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = checkpoint(rooted.join(least, "root").select("fp", "root", "component_id"))
    return prints.join(of_class, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    component_id: the smallest doc_id reachable by links between fingerprints at most two bits apart.
    Equal fingerprints are one class, so copies meet no pair. Null doc_ids take no part in the smallest
    (a component of nulls alone has a null id); repeated rows are kept. An empty table gives an empty result.
    """
    return members(docs).select("doc_id", "fp", "component_id")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near_duplicates()."""
    return keep_one(docs, members(docs))


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null last), of its rows the one with the least text hash.

    grouped: doc_id, text_hash and root of every row of docs. The columns of docs stay, whatever their names; null texts
    count as empty ones, and an empty table gives an empty result.
    Texts are shuffled once to meet the short list of kept rows, and never sorted; only keys of repeated rows,
    if there are any, are numbered to keep one.
    """
    last = 2**63 - 1
    rows = grouped.groupBy("root", F.coalesce("doc_id", F.lit(last)).alias("k"), "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.groupBy("root").agg(F.min(F.struct("k", "text_hash", "n")).alias("r"))
    kept = checkpoint(kept.select(F.when(F.col("r.k") == last, F.lit(-(2**63))).otherwise(F.col("r.k")).alias("_k1"), F.col("r.text_hash").alias("_k2"), "r.n"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *row_key(docs))
    take = lambda n: whole.join(kept.filter(n).drop("n").hint("shuffle_hash"), ["_k1", "_k2"])
    out = take("n = 1").select("_doc.*")
    if not kept.filter("n > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.xxhash64(*[F.col("_doc")[c].cast("string") for c in docs.columns])))
        out = out.unionByName(take("n > 1").withColumn("_n", number).filter("_n = 1").select("_doc.*"))
    return out
