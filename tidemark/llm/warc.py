"""WARC derivatives: metadata and conversion records for response records (DataFrame functions).

Each response gives a metadata record and a plain-text conversion record. Both refer to the response by
its record id, name its URI and date, and carry block digests of their own; the source's digests and HTTP
headers are kept as metadata fields. Records are strings, so Spark's text writer moves whole files of them in
parallel, with the record separator as line separator. Files are read by the lengths that their records state.

Patterns are linear in the page: an element, comment or tag that nothing closes ends with the page, as in browsers.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, SEPARATOR = "WARC/1.1", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements that end a line of text.
BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|tfoot|caption|section|article|header|footer|nav|aside|main|figure|figcaption|blockquote|pre|address|form|fieldset|option|title|body|html|head"
#: Elements whose content is no text of the page.
HIDDEN = ("script", "style", "title", "noscript", "template", "svg", "textarea")
HIDDEN_PATTERN = rf"(?is)<(?:!--.*?(?:-->|\z)|({'|'.join(HIDDEN)})\b.*?(?:</\1\s*+>|\z))"
BLOCK_PATTERN = rf"(?i)</?(?:{BLOCKS})\b[^>]*+(?:>|\z)"
TAG_PATTERN = r"<[A-Za-z/!?][^>]*+(?:>|\z)"
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: White space that is more than one plain space.
SPACES = r" [ \t\x0B\f\r]++|[\t\x0B\f\r][ \t\x0B\f\r]*+"


def sha1_base32(x: Column) -> Column:
    """sha1: and the 32 base-32 digits of a SHA-1 digest, as WARC digests are written."""
    h = F.sha1(x)
    digits = []
    for k in range(8):
        five = F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *digits)


def record_id(*parts: Column) -> Column:
    """A urn:uuid of version 8 made of the MD5 of parts: the same parts give the same id."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _named() -> Column:
    """An array of maps from the named references of HTML to their characters, by first letter from A on."""
    maps = []
    for letter in map(chr, range(ord("A"), ord("z") + 1)):
        own = {f"&{n}": c for n, c in html5.items() if n.endswith(";") and n[0] == letter} or {"&;": ""}
        own |= {"&nbsp;": " "} if letter == "n" else {}
        maps.append(F.map_from_arrays(F.split(F.lit(" ".join(own)), " "), F.split(F.lit("\x01".join(own.values())), "\x01")))
    return F.array(*maps)


def _character(code: Column) -> Column:
    """The character of a numeric reference: 128 to 159 as in Windows-1252, the replacement character outside Unicode."""
    old = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    old = F.create_map(*[F.lit(x) for i, c in old.items() if c for x in (i, c)])
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(old, code), char)


def references(t: Column) -> Column:
    """Character references decoded, numeric and all named ones of HTML, each once; unknown names stay."""
    named = _named()

    def decoded(m: Column) -> Column:
        digits = F.substring(m, 3, 9)
        code = F.when(F.lower(F.substring(m, 3, 1)) == "x", F.conv(F.regexp_replace(digits, "[^0-9A-Fa-f]", ""), 16, 10)).otherwise(F.rtrim(digits, F.lit(";"))).cast("int")
        name = F.coalesce(F.element_at(F.element_at(named, F.ascii(F.substring(m, 2, 1)) - 64), m), m)
        return F.when(F.substring(m, 2, 1) == "#", _character(code)).otherwise(name)

    def whole(x: Column) -> Column:
        pieces = F.arrays_zip(F.split(x, REFERENCE).alias("g"), F.regexp_extract_all(x, F.lit(REFERENCE), 0).alias("m"))
        joined = F.array_join(F.transform(pieces, lambda p: F.concat(p["g"], F.when(p["m"].isNull(), F.lit("")).otherwise(decoded(p["m"])))), "")
        return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)

    # an array of one, so that t is computed once
    return F.element_at(F.transform(F.array(t), whole), 1)


def plain_text(html: Column) -> Column:
    """Readable text of an HTML page: a line for each block, white space squeezed. Null gives an empty text."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_PATTERN, " ")
    t = F.regexp_replace(t, BLOCK_PATTERN, "\n")
    t = F.regexp_replace(t, TAG_PATTERN, "")
    t = references(t)
    t = F.regexp_replace(t, SPACES, " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    """The text of the first title element, or an empty string."""
    t = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*+(?:>|\z)(.*?)(?:</title\s*+>|\z)", 1)
    return F.btrim(F.regexp_replace(references(t), r"[ \t\r\n\x0B\f]+", " "), F.lit(" "))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records for rows (page_id, url, html): record_id, target_uri, date, http_headers, payload and both digests.

    Null ids, urls and pages count as empty, repeated rows give repeated records (with one id), extra columns are
    dropped. An empty table gives an empty result.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        pages["page_id"],
        record_id(F.lit("response"), F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.coalesce(pages["url"], F.lit(""))).alias("record_id"),
        F.coalesce(pages["url"], F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        sha1_base32(payload).alias("payload_digest"),
        sha1_base32(F.concat(headers, payload)).alias("block_digest"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line; line breaks in a value would end it and become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response record: warc_type, record_id, refers_to, target_uri, block, digests and record.

    source: as responses() or responses_of() gives it; page_id is kept if there is one. A metadata record lists the source's
    digests, its HTTP headers and the page's title as warc-fields; a conversion record holds the plain text.
    Both refer to the source by WARC-Refers-To. Null URIs and payloads count as empty, repeated responses
    give repeated records, extra columns are dropped. An empty table gives an empty result.
    """
    s = source.withColumn("_text", plain_text(F.col("payload")))
    fields = F.concat(
        _field("via", F.col("target_uri")),
        _field("source-record-id", F.col("record_id")),
        _field("source-block-digest", F.col("block_digest")),
        _field("source-payload-digest", F.col("payload_digest")),
        F.regexp_replace(F.regexp_replace(F.col("http_headers"), r"\r\n\r\n$", "\r\n"), r"(?m)^", "source-http: "),
        _field("title", title(F.col("payload"))),
    )
    fields = F.regexp_replace(fields, r"source-http: (?=title: )", "")
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    keys = [c for c in ("page_id",) if c in source.columns]
    rows = s.select(*keys, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(kinds).alias("k")).select(*keys, "refers_to", "target_uri", "date", "payload_digest", "k.*")
    rows = rows.withColumn("record_id", record_id(F.col("warc_type"), F.col("refers_to"))).withColumn("block_digest", sha1_base32(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        _field("WARC-Type", F.col("warc_type")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        _field("WARC-Refers-To-Date", F.col("date")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n"),
    )
    return rows.withColumn("record", F.concat(header, "block"))


def write_warc(records: DataFrame, path: str) -> None:
    """Files of records; the separator that ends a record is the writer's line separator."""
    records.select("record").write.option("lineSep", SEPARATOR).text(path)


RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, block string, http_headers string, payload string"


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of a file, compressed or not, as rows of RECORD; blocks end where Content-Length says.

    Bytes that are no UTF-8 become replacement characters. http_headers (with the empty line) and payload are those
    of responses, null for other records. What does not start like a record is passed over.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    text = lambda b: b.decode("utf-8", "replace")
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = text(data[at:end]).split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        block = data[end + 4 : end + 4 + size]
        head, blank, payload = block.partition(b"\r\n\r\n") if fields.get("warc-type") == "response" else (b"", b"", b"")
        named = [fields.get(f) for f in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest")]
        yield (*named, size, text(block), text(head + blank) if blank else None, text(payload) if blank else None)
        at = data.find(b"WARC/", end + 4 + size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD for files of records, one task for each file; a file has 2 GB at most, Spark's bound for whole files.

    An empty file gives no row; a field that a record lacks is null.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    kinds = [pa.int64() if f.name == "content_length" else pa.string() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for r in parse_records(content.as_py()):
                    rows.append(r)
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def responses_of(records: DataFrame) -> DataFrame:
    """The response records among rows of RECORD, as derivatives() takes them; digests that a record lacks are computed."""
    r = records.filter("warc_type = 'response' AND http_headers IS NOT NULL")
    return r.select(
        "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("")).alias("date"), "http_headers", "payload",
        F.coalesce("payload_digest", sha1_base32(F.col("payload"))).alias("payload_digest"), F.coalesce("block_digest", sha1_base32(F.col("block"))).alias("block_digest"),
    )


def response_records(source: DataFrame) -> DataFrame:
    """source, as responses() gives it, with record: each response as it stands in a file."""
    block = F.concat("http_headers", "payload")
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        *[_field(n, v) for n, v in (("WARC-Type", F.lit("response")), *[(n, F.col(c)) for n, c in (("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"))])],
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return source.withColumn("record", F.concat(header, block))


def derivative_digest(pages: DataFrame) -> DataFrame:
    """page_id, warc_type, record_id, refers_to, target_uri, content_length, block_digest, payload_digest of the source, record_sha256."""
    out = derivatives(responses(pages))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "payload_digest", F.sha2("record", 256).alias("record_sha256"))
