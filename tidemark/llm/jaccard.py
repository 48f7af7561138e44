"""Near duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The first candidates come from the SimHash operator: sets whose fingerprints its Golay keys find at most two bits
apart. Sets of similarity 0.8 differ in about ten bits, which no key of it can reach, so all others share a band of
MinHash values: 24 bands of 5 values miss a pair of similarity 0.8 with probability (1 - 0.8^5)^24 = 7e-5, more
similar ones less. Every candidate pair is then compared by its shingle sets.
Equal sets collapse before. Keys that many sets share are not expanded into pairs: chains through small groups of
each key are compared first, and the sets of keys that the links found so far leave apart then meet by their rarest
shingles (prefix_pairs), an exact join that finds every similar pair of them. Texts of one template, which share
bands by the hundred and are not similar, differ in those shingles and so never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks
from tidemark.llm.common import HEAVY, checkpoint, row_key
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import SEED, keep_one, majority, near_edges

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 5
#: Keys with more sets than PAIR_LIMIT are compared by ROUNDS of chains through groups of about CHAIN sets first.
PAIR_LIMIT, CHAIN, ROUNDS = 8, 32, 3
#: Ratio of the sizes of a class of sets, where sets meet by their rarest shingles.
SIZE_STEP = 1.05


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles; words as in simhash.fingerprint, none: empty."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


@cache
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
    return draw[0] | np.uint64(1), draw[1], draw[2] | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each band of a set's MinHash values; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    a, b, mix = _functions()
    least = np.full(len(a), (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        h = shingles[at : at + 512, None] * a + b
        h ^= h >> np.uint64(32)
        least = np.minimum(least, h.min(axis=0))
    return (least * mix).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _map_texts(docs: DataFrame, columns: list[Column], row: object, schema: str) -> DataFrame:
    """row(shingle set) of every text beside further columns; docs gives doc_id, text."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    types = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, texts in text_chunks([batch]):
                made = list(zip(*(row(shingle_set(t)) for t in texts)))
                given = [batch.column(i).slice(at, len(keys)) for i in range(2, batch.num_columns)]
                arrays = [pa.array(x, t) for x, t in zip(made, types[len(given) :])] if made else [pa.array([], t) for t in types[len(given) :]]
                yield pa.record_batch([*given, *arrays], names)
                at += len(keys)

    return docs.select(F.lit(0).cast("long").alias("_at"), "text", *columns).mapInArrow(run, schema)


def set_hash(shingles: np.ndarray) -> int:
    """64-bit hash of a whole set; zero for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def _marks(shingles: np.ndarray) -> tuple:
    return set_hash(shingles), len(shingles), int(np.uint64(majority(shingles)).view(np.int64)), band_keys(shingles)


def set_documents(docs: DataFrame) -> DataFrame:
    """_k1, doc_id, text_hash, fp (hash of the shingle set), size and SimHash of the set and band keys of every row of docs."""
    k1, k2 = row_key(docs)
    given = [k1, F.col("doc_id").cast("long").alias("doc_id"), k2.alias("text_hash")]
    return _map_texts(docs, given, _marks, "_k1 long, doc_id long, text_hash long, fp long, size long, sim long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, shingles of the rows of docs that wanted (fp, _k1, _k2) names."""
    whole = docs.select("text", *row_key(docs)).join(wanted.hint("shuffle_hash"), ["_k1", "_k2"])
    return _map_texts(whole.select("text", "fp"), [F.col("fp")], lambda s: (s.view(np.int64),), "fp long, shingles array<long>").dropDuplicates(["fp"])


def similar(pairs: DataFrame, sets: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("both") >= at_least * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b")


def _pairs(x: DataFrame, a: str, b: str, at_least: float) -> DataFrame:
    """Distinct (a, b), a < b, of struct columns with fp, size and root that are apart and of sizes that allow the similarity."""
    apart = F.col(f"{a}.root") != F.col(f"{b}.root")
    fits = F.least(f"{a}.size", f"{b}.size") >= at_least * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    return x.filter(apart & fits).select(F.least(f"{a}.fp", f"{b}.fp").alias("a"), F.greatest(f"{a}.fp", f"{b}.fp").alias("b")).distinct()


def shared_shingles(sets: DataFrame) -> DataFrame:
    """fp, alone (shingles that no other of the sets holds) and rest (the others, the rarest first) of sets (fp, shingles)."""
    tokens = sets.select("fp", F.explode("shingles").alias("s"))
    seen = checkpoint(tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # shingles of more than one in HEAVY of these tokens are at most HEAVY, so they are broadcast; of any other few rows meet
    hot = F.col("n") > total / HEAVY
    tagged = tokens.join(F.broadcast(seen.filter(hot).withColumnRenamed("n", "hot_n")), "s", "left")
    common = tagged.filter("hot_n IS NOT NULL").select("fp", "s", F.col("hot_n").alias("n"))
    rare = tagged.filter("hot_n IS NULL").select("fp", "s").join(seen.filter(~hot), "s").select("fp", "s", "n")
    held = common.unionByName(rare).groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("held"))
    return sets.select("fp", F.size("shingles").cast("long").alias("all")).join(held, "fp").select("fp", (F.col("all") - F.size("held")).alias("alone"), F.expr("transform(held, x -> x.s)").alias("rest"))


def prefix_pairs(left: DataFrame, sets: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """All pairs (a, b) of left (distinct fp, size, root) with different roots that can be similar by their rarest shingles.

    Shingles are ordered by the number of sets that hold them. Sets of x and y shingles whose similarity is t hold
    at least t / (1 + t) * (x + y) in common, so the first x + 1 less that many of the one meet the first of the other; the
    first shingle in common leaves at most the shorter remainder. Sizes are cut into classes, so that a set
    knows how large its partner is at least; no pair is lost.
    """
    mine = sets.join(left.select("fp"), "fp", "left_semi")
    rows = left.join(checkpoint(shared_shingles(mine)), "fp")
    least = F.expr(f"greatest(pow({SIZE_STEP}D, c) * (1 - 1e-9), size * {at_least}D - 1e-9)")
    level = lambda x: F.floor(F.log(x) / F.log(F.lit(SIZE_STEP)) + 1e-9)
    classes = F.sequence(level(F.col("size") * at_least * (1 - 1e-9)), level(F.col("size") / at_least * (1 + 1e-9)))
    rows = rows.withColumn("own", level(F.col("size"))).select("*", F.explode(classes).alias("c"))
    # shingles held alone come first and meet nobody
    length = F.col("size") - F.ceil(at_least / (1 + at_least) * (F.col("size") + least) - 1e-6) + 1 - F.col("alone")
    rows = rows.withColumn("take", F.least(F.size("rest"), length.cast("int"))).filter("take > 0")
    one = F.struct("fp", "size", "root", "own", (F.col("size") - F.col("alone") - F.col("i") - 1).alias("after"))
    met = rows.select("fp", "size", "root", "own", "c", "alone", F.posexplode(F.expr("slice(rest, 1, take)")).alias("i", "s"))
    met = checkpoint(met.select(F.least("own", "c").alias("c1"), F.greatest("own", "c").alias("c2"), "s", one.alias("x")))
    key = ["c1", "c2", "s"]
    split = met.groupBy(*key, "x.root").agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("m", "root")).alias("most"))
    live = checkpoint(met.join(split.filter("roots > 1").drop("roots"), key))
    # of two sets in different components at least one lies outside the key's largest
    p = live.filter("x.root != most").select(*key, F.col("x").alias("p"))
    both = p.join(live.select(*key, F.col("x").alias("q")), key)
    crossed = "(c1 = c2 OR p.own != q.own)"
    enough = f"1 + least(p.after, q.after) >= {at_least / (1 + at_least)}D * (p.size + q.size) - 1e-6"
    return _pairs(both.filter(f"{crossed} AND {enough}"), "p", "q", at_least)


def simhash_pairs(sets: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """Candidates (a, b) of the SimHash operator among sets (distinct fp, size, sim).

    The least set of a fingerprint stands for it: it meets the other sets of that fingerprint and the least
    sets of the fingerprints that near_edges() links to it.
    """
    one = F.struct("fp", "size", F.col("fp").alias("root"))
    heads = checkpoint(sets.groupBy("sim").agg(F.min(one).alias("p")))
    same = sets.join(heads, "sim").select("p", one.alias("q"))
    links = near_edges(heads.select(F.col("sim").alias("fp")))
    near = links.join(heads.withColumnRenamed("sim", "a"), "a").join(heads.select(F.col("sim").alias("b"), F.col("p").alias("q")), "b").select("p", "q")
    return _pairs(same.unionByName(near), "p", "q", at_least)


def similar_roots(live: DataFrame, sets: DataFrame, given: DataFrame, at_least: float = SIMILAR, pair_limit: int = PAIR_LIMIT, chain: int = CHAIN, rounds: int = ROUNDS) -> DataFrame:
    """(fp, root) of all sets but the roots, in the components of the similar sets that share a key or are a pair of given.

    live: key, fp, size and n, the number of sets that share the key. given: further candidates (a, b).
    """
    one = F.struct("fp", "size", "root")
    few = live.filter(F.col("n") <= pair_limit).withColumn("root", F.col("fp")).groupBy("key").agg(F.collect_list(one).alias("x"))
    few = few.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).filter("p.fp < q.fp")
    compared = checkpoint(_pairs(few, "p", "q", at_least).unionByName(given).distinct())
    roots = connected_components(similar(compared, sets, at_least)).withColumnRenamed("node", "fp")
    crowd = checkpoint(live.filter(F.col("n") > pair_limit))

    def apart() -> DataFrame:
        """Rows of keys whose sets still lie in several components; most: the root of the most of them."""
        rooted = checkpoint(crowd.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        split = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("m", "root")).alias("most"))
        return checkpoint(rooted.join(split.filter("roots > 1").drop("roots"), "key"))

    def compare(pairs: DataFrame) -> None:
        """Links among pairs not compared so far join the stars of the components known."""
        nonlocal compared, roots
        new = checkpoint(pairs.join(compared, ["a", "b"], "left_anti"))
        found = checkpoint(similar(new, sets, at_least))
        compared = compared.unionByName(new)
        if not found.isEmpty():
            roots = connected_components(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(found)).withColumnRenamed("node", "fp")

    for t in range(rounds + 1):
        left = apart()
        if left.isEmpty():
            break
        if t < rounds:
            # like places on one circle for all keys, so that keys of the same sets give the same chains
            place = F.pmod(F.xxhash64(F.lit(t), "fp"), F.lit(1 << 30))
            dealt = left.withColumn("place", place).withColumn("group", (F.col("place") * F.ceil(F.col("n") / chain) / (1 << 30)).cast("int"))
            rows = dealt.groupBy("key", "group").agg(F.array_sort(F.collect_list(F.struct("place", "fp", "size", "root"))).alias("x"))
            steps = rows.filter("size(x) > 1").select(F.explode(F.expr("arrays_zip(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1))")).alias("z"))
            compare(_pairs(steps.select(F.col("z")["0"].alias("p"), F.col("z")["1"].alias("q")), "p", "q", at_least))
        else:
            compare(prefix_pairs(checkpoint(left.select("fp", "size", "root").distinct()), sets, at_least))
    return roots


def members(docs: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """doc_id, fp, text_hash and root (a shingle set's hash for each component) of every row of docs.

    Null, empty and blank texts have the empty set, which is one class and similar to no other; texts of fewer than
    five words have one shingle. Repeated rows share a class and null doc_ids stay null; extra columns are
    dropped. An empty table gives an empty result.
    """
    prints = checkpoint(set_documents(docs))
    keys = checkpoint(prints.select(F.explode("keys").alias("key"), "fp", "size").distinct())
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = checkpoint(keys.join(shared, "key"))
    first = prints.groupBy("fp").agg(F.min(F.struct("_k1", F.col("text_hash").alias("_k2"))).alias("r")).select("fp", "r._k1", "r._k2")
    given = checkpoint(simhash_pairs(prints.select("fp", "size", "sim").distinct(), at_least))
    wanted = live.select("fp").unionByName(given.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    sets = checkpoint(shingle_sets(docs, first.join(wanted, "fp")))
    roots = similar_roots(live, sets, given, at_least)
    return prints.select("doc_id", "fp", "text_hash").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts, as simhash.keep_one chooses it.

    The columns are those of docs, whatever their names. Of all rows with a null, empty or blank text one stays, and of
    repeated rows one; an empty table gives an empty result.
    """
    return keep_one(docs, members(docs))
