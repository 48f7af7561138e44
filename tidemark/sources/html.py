"""Shredding of HTML reports into a relation of table cells.

The only Python step of an import: a stdlib parser turns each page into table rows, from which come cells (report_id,
table_idx, table_id, table_class, summary, heading, wrapper_ids, row_idx, col_idx, is_header, text). It takes a page in
pieces and gives rows as they end, so a page of any length needs little memory. Which table is which section
is decided afterwards by Column expressions, in tidemark.sources.sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "report_id long, table_idx int, table_id string, table_class string, summary string, headings array<string>, wrapper_ids array<string>, row_idx int, col_idx int, is_header boolean, text string"
#: A row of a table in one row: the texts of its cells by column, and which are headers (null: none).
ROW_SCHEMA = SCHEMA.replace("col_idx int, is_header boolean, text string", "heads array<boolean>, texts array<string>")
ARROW_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.bool_()), pa.list_(pa.string())]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: How many earlier headings and ids a table is known by; rows of an Arrow batch; characters that wait for the rest of a row at most.
NEAR, BATCH_ROWS, TAIL = 4, 4000, 1 << 20
#: A row of cells without attributes or markup, as reports have most of; any other goes through the parser.
PLAIN_ROW = re.compile(r"\s*<tr>((?:<td>[^<]*</td>)+)</tr>")


class Shredder(HTMLParser):
    """Takes a page in pieces of any size; take() gives the table rows that are complete."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.tables: list[dict] = []  # open tables, innermost last
        self.n = 0
        self.heading: list[str] | None = None
        self.headings: list[str] = []
        self.ids: list[str] = []
        self.skip = 0
        self.tail = ""

    def feed(self, data: str) -> None:
        data = self.tail + data
        # the last row may be cut
        end = data.rfind("<tr>")
        end = len(data) if end < 0 or len(data) - end > TAIL else end
        self.tail = data[end:]
        self._read(data[:end])

    def _read(self, data: str) -> None:
        at = 0
        while at < len(data):
            if self.tables and not self.rawdata and self.cdata_elem is None and self.heading is None and not self.skip and not self.tables[-1]["cell"]:
                t = self.tables[-1]
                while m := PLAIN_ROW.match(data, at):
                    self._close_row(t)
                    t["row"] += 1
                    texts = m[1][4:-5].split("</td><td>")
                    t["texts"] = [unescape(x).strip() for x in texts] if "&" in m[1] else [x.strip() for x in texts]
                    at = m.end()
            held = bool(self.rawdata)
            to = data.find("<tr>", at + 1)
            super().feed(data[at:to] if to > 0 else data[at:])
            at = to if to > 0 else len(data)
            if held and self.rawdata:  # inside a long comment or the like
                super().feed(data[at:])
                return

    def close(self) -> None:
        self._read(self.tail)
        self.tail = ""
        super().close()
        while self.tables:
            t = self.tables.pop()
            self._close_cell(t)
            self._close_row(t)

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "table":
            self.tables.append({"idx": self.n, "id": a.get("id"), "class": a.get("class", ""), "summary": a.get("summary", ""), "headings": self.headings[-NEAR:], "ids": self.ids[-NEAR:], "row": -1, "texts": [], "heads": None, "cell": None})
            self.n += 1
        elif a.get("id") or (tag == "a" and a.get("name")):
            self.ids = [*self.ids[-NEAR + 1 :], a.get("id") or a["name"]]
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = []
        if self.tables:
            t = self.tables[-1]
            if tag == "tr":
                self._close_cell(t)
                self._close_row(t)
                t["row"] += 1
            elif tag in ("td", "th"):
                self._close_cell(t)
                t["row"] = max(t["row"], 0)
                t["cell"] = (tag == "th", [])
            elif tag == "br" and t["cell"]:
                t["cell"][1].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.heading is not None:
            self.headings = [*self.headings[-NEAR + 1 :], "".join(self.heading).strip()]
            self.heading = None
        if self.tables and tag in ("td", "th", "tr", "table"):
            self._close_cell(self.tables[-1])
            if tag == "table":
                self._close_row(self.tables.pop())

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.heading is not None:
            self.heading.append(data)
        if self.tables and self.tables[-1]["cell"]:
            self.tables[-1]["cell"][1].append(data)

    def _close_cell(self, t: dict) -> None:
        if t["cell"]:
            header, parts = t["cell"]
            t["cell"] = None
            if header and t["heads"] is None:
                t["heads"] = [False] * len(t["texts"])
            if t["heads"] is not None:
                t["heads"].append(header)
            t["texts"].append("".join(parts).strip())

    def _close_row(self, t: dict) -> None:
        if t["texts"]:
            self.rows.append((t["idx"], t["id"], t["class"], t["summary"], t["headings"], t["ids"], t["row"], t["heads"], t["texts"]))
            t["texts"], t["heads"] = [], None


def shred(html: str | None) -> list[tuple]:
    """Cells of all tables of a page, without the report's id; none for null and broken pages without tables."""
    p = Shredder()
    p.feed(html or "")
    p.close()
    return [(*r[:7], i, bool(r[7] and r[7][i]), text) for r in p.rows for i, text in enumerate(r[8])]


def row_batches(rows: list[tuple], kinds: list[pa.DataType], names: list[str], *first: object) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows with the same first values."""
    for at in range(0, len(rows), BATCH_ROWS):
        columns = zip(*((*first, *r) for r in rows[at : at + BATCH_ROWS]))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def table_rows(pages: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows (ROW_SCHEMA) of all tables of all pages; pages: report_id, html.

    With a column part, a page comes in pieces, of which only some are in memory: they are brought together in order, and joined give its html.
    ordered: the pieces are in order already.
    """
    names = [c.strip().split()[0] for c in ROW_SCHEMA.split(",")]
    pieces = ordered or "part" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page = None, None
        for b in batches:
            html = b.column(1)
            for i, k in enumerate(b.column(0).to_pylist()):
                if page is not None and not (pieces and k == key):
                    page.close()
                    yield from row_batches(page.take(), ARROW_KINDS, names, key)
                    page = None
                if page is None:
                    key, page = k, Shredder()
                page.feed(html[i].as_py() or "")
                if len(page.rows) >= BATCH_ROWS:
                    yield from row_batches(page.take(), ARROW_KINDS, names, key)
        if page is not None:
            page.close()
            yield from row_batches(page.take(), ARROW_KINDS, names, key)

    if pieces and not ordered:
        pages = in_order(pages)
    return pages.select("report_id", "html").mapInArrow(run, ROW_SCHEMA)


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces of pages (report_id, part), those of a page in one partition and in order."""
    n = 4 * pieces.sparkSession.sparkContext.defaultParallelism
    return pieces.repartition(n, "report_id").sortWithinPartitions("report_id", "part")


def cells_of(rows: DataFrame) -> DataFrame:
    """A row for each cell of table rows."""
    keys = [c for c in rows.columns if c not in ("heads", "texts")]
    cells = rows.select(*keys, "heads", F.posexplode("texts").alias("col_idx", "text"))
    return cells.select(*keys, "col_idx", F.coalesce(F.get("heads", F.col("col_idx")), F.lit(False)).alias("is_header"), "text")


def cells(pages: DataFrame) -> DataFrame:
    """Cells of all tables of all pages; pages as in table_rows()."""
    return cells_of(table_rows(pages))


def headings(pages: DataFrame) -> DataFrame:
    """report_id, level and text of each heading, by Column expressions alone."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h[1-6]>"), 0)
    h = pages.select("report_id", F.posexplode(found).alias("position", "h"))
    text = F.trim(F.regexp_replace(F.regexp_replace("h", r"<[^>]*>", ""), r"\s+", " "))
    return h.select("report_id", "position", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), text.alias("text"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report_id (hash of the path), file_path, file_size, html of HTML files, each read whole."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("report_id"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.decode("content", "UTF-8").alias("html"))


def basic_metadata(pages: DataFrame) -> DataFrame:
    """Instance and times of reports from class or id marked elements: the first selector with a text wins; default Unknown."""
    html = F.coalesce("html", F.lit(""))
    pick = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf'(?is)<[a-z0-9]+[^>]*\b(?:class|id)="{k}"[^>]*>(.*?)</', 1), r"<[^>]*>", "")), F.lit("")) for k in keys], F.lit("Unknown"))
    return pages.select("report_id", pick("instance-name", "instance_name", "instance").alias("instance_name"), pick("generation-time", "generation_time", "report-time").alias("generation_time"), pick("snapshot-start", "snapshot_start").alias("snapshot_start"), pick("snapshot-end", "snapshot_end").alias("snapshot_end"))


#: Keys of raw text reports.
RAW_KEYS = {"instance_name": "Instance Name", "generation_time": "Report Generation Time", "snapshot_start": "Snapshot Start", "snapshot_end": "Snapshot End"}


def raw_metadata(lines: DataFrame) -> DataFrame:
    """Header values of raw text reports, the last of each key; lines: report_id, line_no, line."""
    last = lambda key: F.coalesce(F.max_by(F.trim(F.regexp_extract("line", rf"{key}:\s*(.*)$", 1)), F.when(F.col("line").contains(f"{key}:"), F.col("line_no"))), F.lit("Unknown"))
    return lines.groupBy("report_id").agg(*[last(k).alias(c) for c, k in RAW_KEYS.items()])


def raw_statements(lines: DataFrame) -> DataFrame:
    """Lines of raw text reports that start with a statement in capitals, with their rank."""
    from pyspark.sql import Window

    found = lines.filter(F.trim("line").rlike("^(SELECT|UPDATE|INSERT)"))
    return found.select("report_id", F.row_number().over(Window.partitionBy("report_id").orderBy("line_no")).alias("rank_by_time"), F.trim("line").alias("sql_text"))
