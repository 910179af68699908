"""Main text of web pages by removing site templates.

Every element's subtree is hashed from the leaves up, by its tags, attributes and text; lists of links outside an article are
hashed by their tags and classes alone as well, as a site's menus differ from page to page. For each host the hashes are
counted over its pages in Spark, pages with the same main text counting once, and subtrees that recur on many pages are its
template and are deleted. A page's own content is on that page alone; a subtree counts as recurring from ``MIN_PAGES`` pages on
and from the square root of the host's number of pages, so that a template with a dozen variants is found on a host of few pages
and a phrase that some writers share is none on a host of many. Paragraphs and headings inside an article stay even where they
recur, as articles of one site may share passages.

What templates leave, as on hosts of few pages, is searched for elements that their tag, class, id or role marks as menu,
header, footer, sidebar, notice, advert, form or comments; they go as well. Reading a page takes time in proportion to its size,
however deep, broken or unclosed its markup is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint, frugal
from .urls import parts

#: A subtree is template if it is on at least so many different pages of its host (and on the square root of all of them).
MIN_PAGES = 5
#: Templates up to which they are copied to every executor, at eight bytes each; parts that a host's counts are spread over.
LOCAL_TEMPLATES, SALTS = 4_000_000, 32
#: Share of a list's text that is in links, and links, from which on it is hashed by its structure.
LINKED, LINKS = 0.66, 2

_COMMENTS = r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
_TAG = re.compile(_COMMENTS + r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: The same without regard to quotes, for what follows a tag whose quotes don't close.
_LOOSE = re.compile(_COMMENTS + r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|(?!)()()()""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden|type)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HINT = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = (1 << 64) - 1

# Element names and marks, as HTML and common practice have them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_GONE = frozenset("head script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video button select input option datalist form nav footer aside dialog menu".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt tr td th caption hgroup".split())
_MARKS = frozenset("nav navbar navigation menu menubar masthead footer foot sidebar aside ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login comment comments commentlist discussion disqus respond reply replies share sharing social breadcrumb breadcrumbs related recommended recommendations search searchbox form pagination pager skip copyright toolbar widget contentinfo complementary".split())
_OUTSIDE = frozenset("header topbar top brand logo disclaimer legal".split())


_ARTICLE = ("article", "main")
#: Elements past which an end tag, and a start tag that ends an element of the same kind, doesn't reach.
_WALL = ("article", "main", "body")
_AROUND = ("article", "section", "div", "main", "body", "td", "th", "li", "blockquote", "table")
_IMPLIED = {
    "li": (("li", ("ul", "ol", "menu")),), "dt": (("dt", ("dl",)), ("dd", ("dl",))), "dd": (("dt", ("dl",)), ("dd", ("dl",))),
    "tr": (("td", ("table",)), ("th", ("table",)), ("tr", ("table",))), "td": (("td", ("table",)), ("th", ("table",))), "th": (("td", ("table",)), ("th", ("table",))),
}


def _mixed(state: int, item: int) -> int:
    state = (state ^ item) * 0x9E3779B97F4A7C15 & _WORD
    return state ^ state >> 29


class Page:
    """Elements of a page in order: tag, parent, whether inside an article, whether marked for removal, hashes, links."""

    def __init__(self, source: str):
        self.tag, self.parent = ["#"], [-1]
        self.inside, self.marked = [False], [False]
        self.hash, self.shape, self.latest = [0], [0], [0]  # of the subtree, of its structure, the structure last added
        self.chars, self.linked, self.links = [0], [0], [0]
        self.parts: list[tuple[int, int, str]] = []  # element, block number, raw text
        self.open = [0]
        self.where: dict[str, list[int]] = {}  # places in ``open`` of the open elements of each name
        self._read(source)

    def _read(self, source: str) -> None:
        tags, inside, marked, open_ = self.tag, self.inside, self.marked, self.open
        at = block = position = 0
        pattern, last = _TAG, source.rfind(">") + 1
        while True:
            m = pattern.search(source, position, last)
            stop = m.start() if m else len(source)
            if stop > at:
                self._text(block, source[at:stop])
            if not m:
                break
            at = position = m.end()
            name = m[2] or m[5]
            if not name:
                if source.startswith("<![CDATA[", stop):
                    closed = source.endswith("]]>", stop, at)
                    at = position = at if closed else len(source)
                    self._text(block, source[stop + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
                elif source.startswith("<!--", stop) and not source.endswith("-->", stop, at):
                    at = position = len(source)
                continue
            if m[5]:
                pattern = _LOOSE
            name = name.lower()
            if m[1] or m[4]:  # a closing tag
                if name in _BLOCK:
                    block += 1
                k = self._place(name)
                if k and (name in _WALL or name == "html" or k > self._nearest(_WALL)):
                    self._close(k)
                continue
            if name in _BLOCK:
                block += 1
            if name in _CLOSES_P:
                self._imply("p", _AROUND)
            for ended, limit in _IMPLIED.get(name, ()):
                self._imply(ended, limit)
            if name in ("td", "th", "br"):
                self._text(block, " ")
            above = open_[-1]
            attrs = m[3] or m[6] or ""
            gone = marked[above] or name in _GONE
            within = inside[above]
            if not gone and (attrs or name == "header"):
                gone = self._hinted(name, attrs, within)
            here = len(tags)
            tags.append(name)
            self.parent.append(above)
            marked.append(gone)
            inside.append(within or name in _ARTICLE or 'role="main"' in attrs)
            self._begin(name, attrs)
            if name in _VOID or attrs.endswith("/"):
                self._end(here)
            elif name in _RAW:
                close = re.compile(f"</{name}\\b[^>]*>", re.I).search(source, at, last)
                at = position = close.end() if close else len(source)
                self._end(here)
            else:
                self.where.setdefault(name, []).append(len(open_))
                open_.append(here)
        self._close(1)

    def _place(self, name: str) -> int:
        """The place in the stack of the innermost open element of a name; 0 if there is none."""
        at = self.where.get(name)
        return at[-1] if at else 0

    def _nearest(self, names: tuple[str, ...]) -> int:
        return max(map(self._place, names))

    def _imply(self, name: str, limit: tuple[str, ...]) -> None:
        """Close an open element whose end tag may be left out."""
        k = self._place(name)
        if k and k >= self._nearest(limit):
            self._close(k)

    def _close(self, k: int) -> None:
        """Close the open elements from place ``k`` on."""
        while len(self.open) > k:
            e = self.open.pop()
            self.where[self.tag[e]].pop()
            self._end(e)

    def _begin(self, name: str, attrs: str) -> None:
        kinds = sorted(w for m in _ATTR.finditer(attrs) if m[1].lower() == "class" for w in (m[2] or m[3] or m[4] or "").split()) if attrs else []
        self.hash.append(xxhash.xxh64_intdigest(f"{name} {' '.join(attrs.split())}"))
        self.shape.append(xxhash.xxh64_intdigest(f"{name} {' '.join(kinds)}"))
        self.latest.append(0)
        self.chars.append(0)
        self.linked.append(0)
        self.links.append(name == "a")

    def _end(self, e: int) -> None:
        """Add a complete element to the one above it."""
        p = self.parent[e]
        self.hash[p] = _mixed(self.hash[p], self.hash[e])
        if self.shape[e] != self.latest[p]:  # a list's length doesn't count
            self.shape[p], self.latest[p] = _mixed(self.shape[p], self.shape[e]), self.shape[e]
        self.chars[p] += self.chars[e]
        self.linked[p] += self.chars[e] if self.tag[e] == "a" else self.linked[e]
        self.links[p] += self.links[e]

    def _text(self, block: int, raw: str) -> None:
        e = self.open[-1]
        self.parts.append((e, block, raw))
        if words := raw.split():
            own = " ".join(words)
            self.hash[e] = _mixed(self.hash[e], xxhash.xxh64_intdigest(own))
            self.chars[e] += len(own)
            if self.latest[e] != 1:
                self.shape[e], self.latest[e] = _mixed(self.shape[e], 1), 1

    @staticmethod
    def _hinted(name: str, attrs: str, within: bool) -> bool:
        if name == "header" and not within:
            return True
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if key in ("class", "id", "role"):
                words = set(_HINT.findall(_CAMEL.sub(" ", value).lower()))
                if name not in ("html", "body", "main", "article") or words & {"comment", "comments", "reply", "ad", "advert", "sponsored"}:
                    if words & _MARKS or not within and words & _OUTSIDE:
                        return True
        return False

    def subtrees(self) -> dict[int, tuple[int, ...]]:
        """The hashes of each element that may be template: containers, and outside an article paragraphs as well."""
        out = {}
        for e in range(1, len(self.tag)):
            name, inside = self.tag[e], self.inside[e]
            if name not in _BLOCK or name in ("html", "body", "article", "main") or inside and name in _PARAGRAPH:
                continue
            out[e] = (self.hash[e],)
            if not inside and self.links[e] >= LINKS and self.linked[e] >= LINKED * self.chars[e]:
                out[e] = (self.hash[e], self.shape[e] ^ 1)
        return out

    def text(self, template: frozenset[int] | set[int]) -> str:
        return self.read(template)[0]

    def read(self, template: frozenset[int] | set[int]) -> tuple[str, int, int]:
        """The text left, and the characters that went with the template and with marked elements.

        Blocks are joined by an empty line; the text is that of articles if the page has any with text.
        """
        hashed = self.subtrees() if template else {}
        cut = [False]
        for e in range(1, len(self.tag)):
            cut.append(cut[self.parent[e]] or any(h in template for h in hashed.get(e, ())))
        size = [sum(len(raw) for e, _, raw in self.parts if cut[e]), sum(len(raw) for e, _, raw in self.parts if self.marked[e] and not cut[e])]
        left = [(e, b, raw) for e, b, raw in self.parts if not cut[e] and not self.marked[e]]
        kept = [x for x in left if self.inside[x[0]]]
        if not any(not raw.isspace() for _, _, raw in kept):
            kept = left
        blocks: dict[int, list[str]] = {}
        for _, b, raw in kept:
            blocks.setdefault(b, []).append(raw)
        texts = (" ".join(entities.unescape("".join(x)).split()) for x in blocks.values())
        return "\n\n".join(t for t in texts if t), *size


def host_of(url: Column) -> Column:
    """The host of a url, A-Z in lower case; empty without one."""
    return parts(url)[0]


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host, 7)


def _signed(h: int) -> int:
    return h - (1 << 63)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash): the subtrees that recur on many pages of each host; ``pages`` has (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, marks = [], [], []
            for host, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if not raw:
                    continue
                page = Page(raw.decode())
                mark = _signed(xxhash.xxh64_intdigest(page.text(frozenset())))
                own = {_signed(h) for hs in page.subtrees().values() for h in hs}
                hosts += [host] * (len(own) + 1)
                hashes += [None, *own]
                marks += [mark] * (len(own) + 1)
            yield pa.record_batch({"host": pa.array(hosts, pa.string()), "hash": pa.array(hashes, pa.int64()), "mark": pa.array(marks, pa.int64())})

    seen = pages.select("host", "html").mapInArrow(frugal(run), "host string, hash long, mark long").distinct()
    counts = checkpoint(seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("hash").isNull()))
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    whole = counts.where("hash is null").select("host", F.col("n").alias("pages"), salted)
    many = counts.where("hash is not null").withColumn("salt", F.pmod(F.col("hash"), F.lit(SALTS)).cast("int"))
    return many.join(whole, ["host", "salt"]).where(F.col("n") * F.col("n") >= F.col("pages")).select("host", "hash")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One number for host and hash of each template."""
    for batch in batches:
        keys = [_mixed(_host_hash(host), h + (1 << 63)) for host, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.record_batch({"key": np.array(keys, np.uint64).view(np.int64)})


def _with_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the template hashes that each page holds in ``hashes``, met by (host, hash) and not by host."""
    key = {"_a": F.xxhash64("page_id", "url"), "_b": F.xxhash64("html")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str, int]] = []
            for a, b, host, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if raw:
                    out += [(a, b, host, h) for h in {_signed(h) for hs in Page(raw).subtrees().values() for h in hs}]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_a", "_b", "host", "hash"])

    keyed = rows.withColumns(key)
    own = keyed.select("_a", "_b", "host", "html").mapInArrow(frugal(run), "_a long, _b long, host string, hash long").join(found, ["host", "hash"])
    lists = own.groupBy("_a", "_b").agg(F.collect_set("hash").alias("hashes"))  # a page's own elements bound it
    return keyed.join(lists, ["_a", "_b"], "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", local: int = LOCAL_TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_marked) of every page.

    n_template and n_marked are the characters that were deleted with the host's template, and of marked elements in what it
    left. A null or empty html has an empty text, and a page that is nothing but template has as well. Repeated rows are all
    returned. Above ``local`` templates, pages meet theirs by a join instead of a copied table; the results are the same.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    found = checkpoint(templates(rows))
    known = None
    if found.count() <= local:
        keys = found.mapInArrow(frugal(_keys), "key long").toArrow()["key"].to_numpy().view(np.uint64)
        known = rows.sparkSession.sparkContext.broadcast(np.sort(keys))
        rows = rows.withColumn("hashes", F.lit(None).cast("array<long>"))
    else:
        rows = _with_hashes(rows, found)

    def here(page: Page, host: str, hashes: list[int] | None) -> frozenset[int]:
        if known is None:
            return frozenset(h + (1 << 63) for h in hashes or ())
        own = list({h for hs in page.subtrees().values() for h in hs})
        if not own or not len(known.value):
            return frozenset()
        base = _host_hash(host)
        asked = np.array([_mixed(base, h) for h in own], np.uint64)
        at = np.minimum(np.searchsorted(known.value, asked), len(known.value) - 1)
        return frozenset(own[i] for i in np.flatnonzero(known.value[at] == asked).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, raw, hashes in zip(batch.column(2).to_pylist(), as_bytes(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                page = Page(raw.decode()) if raw else None
                out.append(page.read(here(page, host, hashes)) if page else ("", 0, 0))
            texts, template, marked = zip(*out, strict=True) if out else ((), (), ())
            columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "n_template": pa.array(template, pa.int64()), "n_marked": pa.array(marked, pa.int64())}
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), **columns})

    schema = "page_id long, url string, text string, n_chars long, n_template long, n_marked long"
    return rows.select("page_id", "url", "host", "html", "hashes").mapInArrow(frugal(run), schema)
