"""Main text of web pages: site templates removed by counting element subtrees for each host.

A page becomes a list of text blocks, and a list of the element subtrees that may be taken out: a hash each, and the
first and last of its blocks, so that a page's lists grow with the page however deep it nests.
Spark counts for every host on how many different pages a subtree stands; subtrees that many pages of the host share
are its template, and the blocks inside them go. What a page says of itself is heeded first: elements that are menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments by name, role or class are left
out, and if the page marks its article, only that is taken, and its paragraphs, headings, lists and tables are no
template however often they recur (an article may be copied, or quote what others quote).

Python parses pages and hashes subtrees; counts, decisions and joining of texts are DataFrame work. Subtree hashes are
counted before they are shuffled. A host or a subtree that fills a part of the table is answered by broadcast rows,
whose number is bounded by their share; texts of pages that lose nothing are not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import HEAVY, checkpoint, join_found, written

#: A subtree is template if at least so many different pages of a host have it, and at least this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: A subtree with more than this share of the page's text is its content.
CONTENT_SHARE = 0.75
CHUNK_CHARS = 1_000_000

# Names of HTML elements, and words that sites use for parts around an article.
VOID = set("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr thead tbody tfoot caption figcaption article main html body".split())
LISTS = set("ul ol dl table".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = set("nav aside footer form menu button select option optgroup datalist label legend dialog template svg math object canvas audio video map head".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = set(
    """ad ads adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus
    footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion
    recommended related reply replies respond search share sharebar sharing sidebar signin signup skip social sponsor sponsored subscribe subscription survey toast toolbar widget widgets""".split()
)
HEADER_WORDS = {"header", "topbar"}
CONTENT_WORDS = set("article content entry headline main post section story text".split())
NEGATIONS = set("has hide no non not with without".split())
PLACE_WORDS = set("area bar block bottom box container content footer form header inner left links list main outer panel primary right secondary section top wrap wrapper".split())
#: An open element of the first name ends when one of the second opens, unless one of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    **{h: (HEADINGS, {"section", "div", "article"}) for h in HEADINGS},
}
KEEPS_P_OPEN = {"button", "object", "td", "th", "caption", "template", "html", "table"}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|/?[A-Za-z][^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def words_of(name: str) -> list[str]:
    """The words of a class or id, lower-cased: cut at punctuation and where capitals begin."""
    return [w.lower() for w in WORD.findall(name)]


class Element:
    """An open or closed element that starts a block, or an inline one that may be noise."""

    __slots__ = ("name", "parent", "attributes", "items", "chars", "closed", "holds_main", "holds_h1", "hash")

    def __init__(self, name: str, parent: Element | None, attributes: dict[str, str]) -> None:
        self.name, self.parent, self.attributes = name, parent, attributes
        self.items: list[str] = []
        self.chars = 0
        self.closed = self.holds_main = self.holds_h1 = False
        self.hash = 0

    def is_main(self) -> bool:
        """Whether the page marks it as its article."""
        if self.name == "article" or self.name == "main":
            return not self.by_class(False)
        return bool(self.attributes) and (self.attributes.get("role") == "main" or "articlebody" in self.attributes.get("itemprop", "").lower())

    def by_class(self, inside: bool) -> bool:
        """Noise by role, class or id."""
        a = self.attributes
        if not a:
            return False
        if a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or HIDING.search(a.get("style", "")):
            return True
        for name in a.get("class", "").split():
            words = words_of(name)
            if words and words[0] not in NEGATIONS:
                if not NOISE_WORDS.isdisjoint(words) or (not inside and not HEADER_WORDS.isdisjoint(words) and CONTENT_WORDS.isdisjoint(words)):
                    return True
        # ids of headings, paragraphs and an article's sections are often made of the text
        words = words_of(a["id"]) if a.get("id") and self.name not in PROSE else []
        if not words or words[0] in NEGATIONS:
            return False
        if inside:
            return words[0] in NOISE_WORDS and all(w in NOISE_WORDS or w in PLACE_WORDS or w.isdigit() for w in words)
        return not NOISE_WORDS.isdisjoint(words) or (not HEADER_WORDS.isdisjoint(words) and CONTENT_WORDS.isdisjoint(words))

    def is_noise(self, inside: bool) -> bool:
        """A part around the text. What holds the article is noise only if it says so by its own closed element."""
        if self.name in ("html", "body"):
            return False
        if self.name in NOISE_TAGS or (self.name == "header" and not inside):
            whole_page = self.holds_main and (not self.closed or self.name == "form")
            return not whole_page and not (self.name == "form" and self.holds_h1)
        return not self.holds_main and self.by_class(inside)


    def may_be_template(self, marked: bool, inside: bool) -> bool:
        """Nothing that holds the page's article, and in an article no prose."""
        if self.holds_main or self.is_main() or (marked and not inside):
            return False
        return not (marked and (self.name in PROSE or self.name in LISTS))


class Page:
    """Blocks of one page: (text, element) in page order."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, Element]] = []
        self.root = Element("html", None, {})
        self.stack: list[Element] = [self.root]
        self.buffer: list[str] = []
        #: open elements of each name, so that nothing is looked for in vain
        self.open: Counter[str] = Counter()
        self._read(html)
        self._flush()
        self._pop(0)

    def _flush(self) -> None:
        """The text so far is a block of the innermost element."""
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                at = self.stack[-1]
                self.blocks.append((text, at))
                at.items.append(text)
                at.chars += len(text)

    def _pop(self, depth: int) -> None:
        """Close the elements from depth on, and tell their parents."""
        for e in reversed(self.stack[depth:]):
            label = f"{e.name} {e.attributes.get('class', '')} {e.attributes.get('id', '')} {e.attributes.get('role', '')}" if e.attributes else e.name
            e.hash = xxhash.xxh64_intdigest("\x00".join([label, *e.items]), 7) - 2**63
            if e.parent:
                e.parent.items.append(f"\x01{e.hash}")
                e.parent.chars += e.chars
                e.parent.holds_main |= e.holds_main or e.is_main()
                e.parent.holds_h1 |= e.holds_h1 or e.name == "h1"
            e.items = []
            self.open[e.name] -= 1
        del self.stack[depth:]

    def _end(self, names: set[str], stop: set[str]) -> None:
        """Close the innermost open element of these names, unless one of stop lies inside it."""
        if not any(self.open[n] > 0 for n in names):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                return self._pop(i)
            if self.stack[i].name in stop:
                return None

    def _open(self, name: str, rest: str) -> None:
        attributes = {}
        if "=" in rest or "hidden" in rest:
            for m in ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        if name in INLINE:
            # an inline element counts only where it could be noise; its text belongs to the block around it
            e = Element(name, self.stack[-1], attributes)
            if attributes and e.by_class(True):
                self._flush()
                self._push(e)
            return
        self._flush()
        if name in ("html", "body"):
            self.root.attributes.update(attributes)
            return
        if name in ENDS:
            self._end(*ENDS[name])
        if name not in ("option", "optgroup", "label", "button"):
            self._end({"p"}, KEEPS_P_OPEN)
        self._push(Element(name, self.stack[-1], attributes))

    def _push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.name] += 1

    def _close(self, name: str) -> None:
        if name in INLINE:
            if self.stack[-1].name == name:
                self._flush()
                self.stack[-1].closed = True
                self._pop(len(self.stack) - 1)
            return
        self._flush()
        if self.open[name] <= 0:
            return
        stop = ENDS[name][1] if name in ENDS and name not in HEADINGS else set()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                self.stack[i].closed = True
                return self._pop(i)
            if self.stack[i].name in stop:
                return None

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            text = html[at : m.start() if m else n]
            if text:
                self.buffer.append(unescape(text))
            if not m:
                return
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            elif name in RAW:
                end = RAW_END[name].search(html, at)
                at = end.start() if end else n
                if end:
                    close = html.find(">", at)
                    at = close + 1 if close >= 0 else n
                if name != "noscript" and name != "script" and name != "style":
                    self._flush()
            elif name == "br":
                self.buffer.append(" ")
            elif name in VOID:
                if name == "hr":
                    self._flush()
                    self._end({"p"}, KEEPS_P_OPEN)
            else:
                self._open(name, m[3])

    def _places(self) -> dict[int, tuple[bool, bool, bool]]:
        """(inside main text, inside an article, inside noise) of every element with a block, and of those around it."""
        place: dict[int, tuple[bool, bool, bool]] = {}
        for _, e in self.blocks:
            path = []
            while e is not None and id(e) not in place:
                path.append(e)
                e = e.parent
            inside, article, noise = place[id(e)] if e is not None else (False, False, False)
            for x in reversed(path):
                noise = noise or x.is_noise(inside)
                main = not noise and x.is_main()
                inside, article = inside or main, article or (main and x.name == "article")
                place[id(x)] = inside, article, noise
        return place

    def main_blocks(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The blocks that may be main text, and (hash, first block, last block) of the subtrees that may be template."""
        place = self._places()
        clean = [(text, e, *place[id(e)]) for text, e in self.blocks if not place[id(e)][2]]
        marked = any(x[2] for x in clean)
        if marked:
            clean = [x for x in clean if x[3]] or [x for x in clean if x[2]]
        total = sum(len(x[0]) for x in clean)
        spans: dict[int, tuple[Element, int]] = {}
        lasts: dict[int, int] = {}
        for i, (_, e, *_) in enumerate(clean):
            while e.parent is not None and id(e) not in spans:
                spans[id(e)] = e, i
                e = e.parent
        for i in range(len(clean) - 1, -1, -1):
            e = clean[i][1]
            while e.parent is not None and id(e) not in lasts:
                lasts[id(e)] = i
                e = e.parent
        subtrees = [(e.hash, first, lasts[k]) for k, (e, first) in spans.items() if e.chars <= CONTENT_SHARE * total and e.may_be_template(marked, place[k][0])]
        return [x[0] for x in clean], subtrees


SUBTREE = T.StructType([T.StructField("h", T.LongType(), False), T.StructField("first", T.IntegerType(), False), T.StructField("last", T.IntegerType(), False)])
PARSED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType(), False), False), T.StructField("subtrees", T.ArrayType(SUBTREE, False), False), T.StructField("content", T.LongType(), False)])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks (texts), subtrees (hash, first and last block) and content (a hash of the page)."""
    subtree = pa.struct([pa.field("h", pa.int64(), False), pa.field("first", pa.int32(), False), pa.field("last", pa.int32(), False)])
    kinds = [pa.int64(), pa.string(), pa.list_(pa.field("element", pa.string(), False)), pa.list_(pa.field("element", subtree, False)), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], PARSED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            ids, urls, html = b.columns
            for i in range(len(b)):
                text = html[i].as_py() or ""
                blocks, subtrees = Page(text).main_blocks()
                content = xxhash.xxh64_intdigest(text, 3) - 2**63
                rows.append((ids[i].as_py(), urls[i].as_py(), blocks, [{"h": h, "first": a, "last": b} for h, a, b in subtrees], content))
                size += len(text)
                if size > CHUNK_CHARS:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(run, PARSED)


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(table: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows (host, h, n): subtrees that n different pages of a host have, enough of them to be its template."""
    pages = checkpoint(table.groupBy("host").agg(F.count_distinct("content").alias("pages")))
    shared = table.select("host", "content", F.explode(F.array_distinct("subtrees.h")).alias("h")).groupBy("host", "h").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= min_pages)
    total = pages.agg(F.sum("pages")).first()[0] or 0
    # hosts with more than a HEAVY-th of all pages are at most HEAVY
    large, small = pages.filter(F.col("pages") > total / HEAVY), pages.filter(F.col("pages") <= total / HEAVY)
    sized = shared.join(F.broadcast(large), "host", "left")
    rest = sized.filter(F.col("pages").isNull()).drop("pages").join(small, "host")
    return sized.filter(F.col("pages").isNotNull()).unionByName(rest).filter(F.col("n") >= F.col("pages") * min_share).select("host", "h", "n")


def template_hits(table: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows (row, bad): the template subtrees of each page that has some. templates is a written table."""
    seen = table.select("row", "host", F.explode(F.array_distinct("subtrees.h")).alias("h"))
    total = templates.agg(F.sum("n")).first()[0] or 0
    heavy, light = templates.filter(F.col("n") > total / HEAVY), templates.filter(F.col("n") <= total / HEAVY)
    hits = seen.join(F.broadcast(heavy.select("host", "h")), ["host", "h"], "left_semi")
    hits = hits.unionByName(seen.join(light.select("host", "h"), ["host", "h"], "left_semi"))
    return hits.groupBy("row").agg(F.collect_set("h").alias("bad"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points of text).

    Null html counts as empty and gives an empty text; pages without a host count as one host; repeated rows give
    repeated rows and count as one page. Extra columns are dropped; an empty table gives an empty result. Texts of any
    length are read whole. Elements that nothing closes end with the element around them.
    """
    table = written(parsed(pages.select("page_id", "url", "html")).withColumns({"host": host_of(F.col("url")), "row": F.monotonically_increasing_id()}))
    hits = checkpoint(template_hits(table, checkpoint(site_templates(table, min_pages, min_share))))
    keyed = table.select("page_id", "url", "blocks", "subtrees", F.col("row").alias("_k1"), F.lit(0).cast("long").alias("_k2"))
    found = join_found(keyed, hits.select(F.col("row").alias("_k1"), F.lit(0).cast("long").alias("_k2"), "bad"))
    found = found.withColumn("cut", F.expr("filter(subtrees, s -> array_contains(bad, s.h))"))
    stays = "CASE WHEN bad IS NULL THEN blocks ELSE filter(blocks, (b, i) -> NOT exists(cut, s -> i BETWEEN s.first AND s.last)) END"
    out = found.select("page_id", "url", F.expr(f"array_join({stays}, ' ')").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
