"""Line deduplication: range-partitioned line hashes, answered with keep bitmaps (DataFrame functions only).

Lines travel as 128-bit hashes with document key and position. They are range-partitioned by hash and a salt of the
document, so a line that a third of all documents holds is shared out over many tasks, and sorted by hash, then by
document from the last one, then by position. One pass over each sorted range, which holds a row at a time, streams
the first occurrence in each document and counts the documents so far; the first of all is the document that keeps
the line. What goes back to a document is a compressed bitmap of the lines it keeps (64 lines to a word, words that
keep all their lines left out), not text, and documents that lose no line are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, ascii_lower, checkpoint, join_found, row_key, unused

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 64


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (_k1, _k2, pos, h1, h2, salt), one for each line whose key is long enough."""
    k1, k2 = row_key(docs)
    lines = docs.select(k1, k2, F.posexplode(split_lines(docs["text"])).alias("pos", "line"))
    lines = lines.select("_k1", "_k2", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return lines.select("_k1", "_k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("_k1"), F.lit(SALTS)).cast("int").alias("salt"))


def stream_firsts(seen: DataFrame) -> DataFrame:
    """Rows (h1, h2, salt, n, last): how many documents of a salt hold a line, and the last of them.

    The window looks back one row in a sorted group; Spark buffers the rows of a group of one (line, salt) and spills beyond its threshold.
    """
    ranged = seen.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("_k1"), "pos")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("_k1"), "pos")
    first_in_doc = F.coalesce(F.lag("_k1").over(order) != F.col("_k1"), F.lit(True))
    firsts = ranged.select("h1", "h2", "salt", "_k1", first_in_doc.alias("first")).filter("first")
    return firsts.groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("_k1").alias("last"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (_k1, _k2, keep_words) for documents that lose lines.

    keep_words: (word, bits) by rising word, for the words that lose a line; bits says which of the lines 64 * word
    to 64 * word + 63 stay, least bit first.
    """
    # read twice below; as hashes and positions it is a small part of the text, and range bounds are sampled from it
    seen = checkpoint(line_occurrences(docs, min_chars))
    key = Window.partitionBy("h1", "h2")  # a row for each salt
    decided = stream_firsts(seen).select("h1", "h2", "salt", F.sum("n").over(key).alias("n_docs"), F.max("last").over(key).alias("keeper")).filter(F.col("n_docs") >= min_docs)
    dropped = seen.join(decided.select("h1", "h2", "salt", "keeper"), ["h1", "h2", "salt"]).filter("_k1 < keeper")
    return (
        dropped.select("_k1", "_k2", F.expr("int(pos div 64)").alias("word"), F.expr("shiftleft(1L, int(pos % 64))").alias("bit"))
        .repartition("_k1", "_k2")
        .groupBy("_k1", "_k2", "word")
        .agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
        .groupBy("_k1", "_k2")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep_words"))
    )


def _without_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """_doc (a row of docs), _text (what stays of its text), n_lines, n_dropped and keep_words of every row of docs."""
    maps = checkpoint(keep_bitmaps(docs, min_chars, min_docs))
    joined = join_found(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *row_key(docs)), maps)
    whole = "transform(keep_words, (x, i) -> concat(array_repeat(-1L, x.word - 1 - CASE WHEN i = 0 THEN -1 ELSE keep_words[i - 1].word END), array(x.bits)))"
    lines = joined.select("_doc", "keep_words", F.expr(f"flatten({whole})").alias("_map"), split_lines(F.col("_doc")["text"]).alias("_lines"))
    stays = "(getbit(coalesce(try_element_at(_map, int(i div 64) + 1), -1L), i % 64) = 1)"
    kept = F.when(F.col("keep_words").isNull(), F.col("_doc")["text"]).otherwise(F.expr(f"array_join(filter(_lines, (x, i) -> {stays}), '\n')"))
    dropped = F.coalesce(F.expr("aggregate(keep_words, 0L, (a, w) -> a + bit_count(~w.bits))"), F.lit(0))
    return lines.select("_doc", kept.alias("_text"), F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), "keep_words")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("_text").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with repeated lines dropped, and the columns n_lines, n_dropped and keep_words.

    A key (see line_key) of at least min_chars code points that at least min_docs different documents hold
    loses all its lines, except in the largest doc_id that holds it. Null text: one empty line, and the
    text stays null; a null doc_id counts as the smallest. Rows with one doc_id count as one document;
    repeated rows all get the same result. Where docs has a column of one of the three names, the new one gets
    underscores before it. An empty table gives an empty result.
    """
    new = [F.col(c).alias(unused(c, docs.columns)) for c in ("n_lines", "n_dropped", "keep_words")]
    return _without_lines(docs, min_chars, min_docs).select(*_columns(docs), *new)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with repeated lines dropped as dedup_lines() does, with the columns of docs alone, whatever their names."""
    return _without_lines(docs, min_chars, min_docs).select(*_columns(docs))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

DIGEST_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
