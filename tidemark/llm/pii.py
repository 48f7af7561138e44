"""Personal data and information-theoretic sanitisation (DataFrame functions only).

Base entities (e-mail, IP, card and phone numbers) are found by patterns that are linear in the text.
Terms near an entity are then judged by how strongly the corpus says that they reveal it: PMI(entity; term) over
the documents, relative to the entity's own information content IC(entity), is the share of the entity's information
that the term discloses. A pair counts only where the corpus bears it out: in `MIN_CONTEXTS` texts of different
surroundings at least, and so often that chance would hardly bring any of all pairs tested together like that
(`ERROR_RATE`). Copies of a text, and texts whose words around the entity are nearly the same, are one context.
The domain of an e-mail address is an entity too, so that addresses that occur once have a common one.
Terms at or above `remove_at` are removed, terms from `generalise_at` on are generalised to the class of words written
like them (names, acronyms, other words), wherever they stand in any text. A class stands in nearly every document,
so it says next to nothing about any entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, join_found, row_key

KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns that match what the plain ones of the contract match, at the same places, without backtracking:
#: a match can only start at the start of its run of characters or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW, WINDOW_CHARS = 6, 160
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Least number of independent contexts of a pair, and the chance that any pair at all passes the test by accident.
MIN_CONTEXTS, ERROR_RATE = 2, 0.01
#: MinHash values of a context's pairs of neighbouring terms; contexts that agree in one are one, those with half of the pairs in common in three of four cases.
CONTEXT_HASHES = 2
#: Told terms up to this number meet the words of all texts by a broadcast instead of a shuffle of all words.
BROADCAST_TERMS = 200_000
#: A term: a run of letters between white space or ends, apart from punctuation.
TERM = r"(?<=(?:^|\s)[\p{Punct}&&[^@]]{0,4})\p{L}{2,}+(?=[\p{Punct}&&[^@]]{0,4}(?:\s|$))"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw_matches(text: str, kind: str) -> str:
    """SQL: array of (kind, i, gap, m, tail, head) for all matches in order.

    gap: code points between the last match and this one; tail and head: text just before and after it.
    split() and regexp_extract_all() see the same matches, so gaps and match lengths add up to positions.
    """
    p, k = _sql(PATTERNS[kind]), KINDS.index(kind)
    wide = WINDOW_CHARS + 1
    return f"""(CASE WHEN {text} RLIKE {p} THEN transform(arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p})),
      (x, i) -> named_struct('kind', {k}, 'i', i, 'gap', char_length(x.`1`), 'm', x.`0`, 'tail', right(x.`1`, {wide}), 'head', left(x.`1`, {wide}))) END)"""


def _valid() -> Column:
    """Whether the match m passes the check of its kind; _digits: its digits, for cards and phones."""
    double = "CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END"
    luhn = F.expr(f"aggregate(transform(filter(split(reverse(_digits), ''), c -> c != ''), (c, i) -> {double}), 0, (a, c) -> a + c) % 10 = 0")
    parts = F.expr("forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)")
    n = F.length("_digits")
    return F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, parts).when(F.col("kind") == 2, F.when(n.between(16, 19), luhn).otherwise(False)).otherwise(n.between(8, 15))


def find_entities(docs: DataFrame) -> DataFrame:
    """Rows (_k1, _k2, kind, start, end, entity, tail, head), one for each base entity of each distinct row of docs.

    Positions count code points, end is exclusive. Null text counts as empty. tail and head hold the text beside the
    entity, one code point more than WINDOW_CHARS of it.
    """
    k1, k2 = row_key(docs)
    text = docs.select(k1, k2, F.coalesce(docs["text"], F.lit("")).alias("t"))
    found = text.select("_k1", "_k2", F.expr("flatten(array_compact(array(" + ", ".join(raw_matches("t", k) for k in KINDS[:4]) + ")))").alias("found")).filter(F.size("found") > 0)
    # the last piece of split() has no match; it only gives the text after the last match
    rows = found.select("_k1", "_k2", F.explode("found").alias("f")).select("_k1", "_k2", "f.*").repartition("_k1", "_k2").dropDuplicates(["_k1", "_k2", "kind", "i"])
    order = Window.partitionBy("_k1", "_k2", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.char_length("m"), F.lit(0))).over(order))
    # a gap and a match have two code points at least, so this many of them fill a window; a longer gap fills it alone
    wide = WINDOW_CHARS + 1
    some = wide // 2 + 1
    m = lambda side: F.coalesce(side("m", F.lit(wide)), F.lit(""))
    rows = rows.withColumn("upto", F.concat(F.lag(m(F.right), 1, "").over(order), "tail")).withColumn("onward", F.concat("head", m(F.left)))
    near = lambda c, a, b: F.array_join(F.collect_list(c).over(order.rowsBetween(a, b)), "")
    rows = rows.withColumn("tail", F.right(near("upto", -some, 0), F.lit(wide))).withColumn("after", F.left(near("onward", 1, some), F.lit(wide)))
    rows = rows.filter("m IS NOT NULL").withColumn("_digits", F.when(F.col("kind") >= 2, F.regexp_replace("m", "[^0-9]", "")))
    rows = rows.filter(_valid())
    entity = F.when(F.col("kind") >= 2, F.col("_digits")).otherwise(F.lower("m"))
    return rows.select("_k1", "_k2", "kind", (F.col("end") - F.char_length("m")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.concat_ws(":", F.col("kind"), entity).alias("entity"), "tail", F.col("after").alias("head"))


def window_terms(entities: DataFrame) -> DataFrame:
    """Distinct rows (_k2, entity, term, m0, m1, ..): the WINDOW terms on either side of each entity.

    m0, m1, ..: MinHash values of the pairs of neighbouring terms around the entity (common single words don't make contexts alike). An e-mail address has rows for its domain as well.
    An entity without terms around it has one row with term null.
    """
    t, cut = _sql(TERM), WINDOW_CHARS
    # a side that is longer than the window starts or ends within a word, which is left out
    before = f"slice(reverse(regexp_extract_all(CASE WHEN char_length(tail) > {cut} THEN regexp_replace(tail, '^\\\\S+', '') ELSE tail END, {t}, 0)), 1, {WINDOW})"
    after = f"slice(regexp_extract_all(CASE WHEN char_length(head) > {cut} THEN regexp_replace(head, '\\\\S+$', '') ELSE head END, {t}, 0), 1, {WINDOW})"
    near = entities.select("_k2", "entity", F.expr(f"transform(concat({before}, {after}), x -> lower(x))").alias("terms"))
    near = near.withColumn("grams", F.expr("CASE WHEN size(terms) > 1 THEN transform(slice(terms, 1, size(terms) - 1), (x, i) -> concat(x, ' ', terms[i + 1])) ELSE terms END"))
    hashes = [F.coalesce(F.expr(f"array_min(transform(grams, x -> xxhash64(concat(x, '{i}'))))"), F.lit(0)).alias(f"m{i}") for i in range(CONTEXT_HASHES)]
    pools = F.expr("CASE WHEN entity LIKE '0:%' THEN array(entity, regexp_replace(entity, ':[^@]*@', ':@')) ELSE array(entity) END")
    rows = near.select("_k2", F.explode(pools).alias("entity"), "terms", *hashes)
    return rows.select("_k2", "entity", F.explode_outer("terms").alias("term"), *[f"m{i}" for i in range(CONTEXT_HASHES)]).distinct()


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (th, df): in how many rows of docs each of terms, given by the hash th, stands as a run of letters.

    Up to BROADCAST_TERMS terms meet the words where these lie, so only counts of them are shuffled.
    """
    words = docs.filter("text IS NOT NULL").select(F.explode(F.expr(r"array_distinct(transform(split(lower(text), '[^\\p{L}]+'), w -> xxhash64(w)))")).alias("th"))
    terms = checkpoint(terms)
    if terms.count() <= BROADCAST_TERMS:
        return words.join(F.broadcast(terms), "th").groupBy("th").agg(F.count(F.lit(1)).alias("df"))
    return words.groupBy("th").agg(F.count(F.lit(1)).alias("df")).join(terms, "th")


def _contexts() -> Column:
    """Number of contexts of a group: of texts, and of surroundings by each hash, whichever is least."""
    return F.least(F.count_distinct("_k2"), *[F.count_distinct(f"m{i}") for i in range(CONTEXT_HASHES)])


def disclosure(docs: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (entity, term, share): the share of the entity's information content that the term discloses.

    Only pairs of MIN_CONTEXTS contexts that pass the test against chance are rows. near: rows of window_terms(), a
    written table. Document frequencies count every row of docs, so copies of a term's text can only lower its share.
    """
    n = docs.count()
    pairs = near.filter("term IS NOT NULL").groupBy("entity", "term").agg(_contexts().alias("both"))
    tested = pairs.count()
    pairs = checkpoint(pairs.filter(F.col("both") >= MIN_CONTEXTS))
    per_entity = near.groupBy("entity").agg(_contexts().alias("n_entity"))
    terms = pairs.select(F.xxhash64("term").alias("th")).distinct()
    df = document_frequency(docs, terms)
    joined = pairs.join(per_entity, "entity").withColumn("th", F.xxhash64("term")).join(df, "th")
    both = F.col("both").cast("double")
    expected = F.col("n_entity") * F.col("df") / F.lit(float(max(n, 1)))
    # Chernoff's bound of the probability that a Poisson variable of this mean reaches both
    by_chance = both - expected + both * F.log(expected / both)
    real = (both > expected) & (by_chance + F.log(F.lit(float(max(tested, 1)))) < F.log(F.lit(ERROR_RATE)))
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("n_entity"))
    return joined.filter(real).select("entity", "term", F.when(ic > 0, F.log2(both / expected) / ic).otherwise(F.lit(0.0)).alias("share"))


def form_of(m: Column) -> Column:
    """The class of words written like m: ACRONYM (all upper case), NAME (first letter upper case) or WORD."""
    first = F.substring(m, 1, 1)
    return F.when((m == F.upper(m)) & (m != F.lower(m)), "ACRONYM").when(first != F.lower(first), "NAME").otherwise("WORD")


def term_places(docs: DataFrame, told: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (_k1, _k2, start, end, removed, form): where the words of told (term, removed) stand in any text, outside entities."""
    told = checkpoint(told.withColumn("th", F.xxhash64("term")))
    met = F.broadcast(told) if told.count() <= BROADCAST_TERMS else told
    k1, k2 = row_key(docs)
    words = docs.filter(docs["text"].isNotNull()).select(k1, k2, F.explode(F.expr(r"array_distinct(transform(split(lower(text), '[^\\p{L}]+'), w -> xxhash64(w)))")).alias("th"))
    hits = checkpoint(words.join(met, "th").select("_k1", "_k2", "term", "removed").distinct())
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.array_sort(F.collect_set("term")), "|"), F.lit(r")(?!\p{L})")).alias("pattern")
    patterns = checkpoint(hits.groupBy("_k1", "_k2").agg(pattern))
    text = join_found(docs.select(*row_key(docs), F.col("text").alias("t")), patterns).filter("pattern IS NOT NULL")
    found = text.select("_k1", "_k2", F.posexplode(F.expr("arrays_zip(regexp_extract_all(t, pattern, 0), split(t, pattern))")).alias("i", "x"))
    rows = found.select("_k1", "_k2", "i", F.char_length("x.1").alias("gap"), F.col("x.0").alias("m")).dropDuplicates(["_k1", "_k2", "i"])
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.char_length("m"), F.lit(0))).over(Window.partitionBy("_k1", "_k2").orderBy("i"))).filter("m IS NOT NULL")
    rows = rows.select("_k1", "_k2", F.lower("m").alias("term"), form_of(F.col("m")).alias("form"), (F.col("end") - F.char_length("m")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    base = entities.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    placed = rows.join(hits, ["_k1", "_k2", "term"]).join(base, ["_k1", "_k2"], "left")
    return placed.filter(~F.coalesce(F.expr("exists(s, x -> x.start < end AND start < x.end)"), F.lit(False))).select("_k1", "_k2", "start", "end", "removed", "form")


def find_spans(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """Rows (_k1, _k2, kind, start, end, removed, form): base entities and disclosing terms of each distinct row of docs.

    Null and empty texts have none, repeated rows are one; an empty table gives an empty result.

    removed: for terms, whether the term goes altogether; true for base entities. form: the class of a term, see form_of().
    """
    entities = checkpoint(find_entities(docs))
    told = disclosure(docs, checkpoint(window_terms(entities))).filter(F.col("share") >= generalise_at)
    told = told.groupBy("term").agg(F.max(F.col("share") >= remove_at).alias("removed"))
    terms = term_places(docs, told, entities)
    base = entities.select("_k1", "_k2", "kind", "start", "end", F.lit(True).alias("removed"), F.lit(None).cast("string").alias("form"))
    return base.unionByName(terms.withColumn("kind", F.lit(4)))


def _by_row(spans: DataFrame) -> DataFrame:
    return spans.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "removed"))).alias("s"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs; then n_generalised and n_removed terms.

    Null and empty texts have no spans; repeated rows get the same result, extra columns are dropped. An empty
    table gives an empty result.
    """
    joined = join_found(docs.select(docs["doc_id"], *row_key(docs)), checkpoint(_by_row(find_spans(docs))))
    named = "transform(filter(s, x -> {}), x -> concat_ws(':', element_at(array({}), x.kind + 1), x.start, x.end))".format("{}", ", ".join(f"'{k}'" for k in KINDS))
    count = lambda cond: F.coalesce(F.size(F.expr(f"filter(s, x -> {cond})")), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        *[F.when(F.col("s").isNull(), F.lit(0)).otherwise(count(f"x.kind = {i}")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(F.coalesce(F.array_join(F.expr(named.format("x.kind < 4")), ","), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.expr(named.format("true")), ","), F.lit("")).alias("spans"),
        *[F.when(F.col("s").isNull(), F.lit(0)).otherwise(count(f"x.kind = 4 AND {c}")).cast("long").alias(a) for c, a in (("NOT x.removed", "n_generalised"), ("x.removed", "n_removed"))],
    )


def sanitise(docs: DataFrame, **parameters: float) -> DataFrame:
    """docs with every base entity and disclosing term replaced in text.

    An entity becomes [EMAIL], [IP], [CARD] or [PHONE], a generalised term [NAME], [ACRONYM] or [WORD], a removed term nothing.
    Overlapping spans are replaced as one, by the kind that starts first. Rows without spans stay as they
    are, nulls included; repeated rows are treated alike.
    """
    spans = find_spans(docs, **parameters)
    order = Window.partitionBy("_k1", "_k2").orderBy("start", F.desc("end"), "kind")
    runs = spans.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), 1).otherwise(0)).over(order))
    label = "element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]', CASE WHEN removed THEN '' ELSE concat('[', form, ']') END), kind + 1)"
    merged = runs.groupBy("_k1", "_k2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr(f"min_by({label}, struct(start, kind))").alias("label"))
    cuts = checkpoint(merged.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("cuts")))
    joined = join_found(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *row_key(docs)), cuts)
    text = "_doc.text"
    piece = f"substring({text}, int(CASE WHEN i = 0 THEN 1 ELSE cuts[i - 1].end + 1 END), int(x.start - CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1].end END))"
    masked = F.expr(f"array_join(transform(cuts, (x, i) -> concat({piece}, x.label)), '') || substring({text}, int(element_at(cuts, -1).end + 1))")
    new = F.when(F.col("cuts").isNull(), F.col(text)).otherwise(masked)
    return joined.select(*[new.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
