"""Main text of web pages by site template removal.

Every page is read into a tree of elements, and each element's subtree (tags and normalised text) gets a hash. Spark
counts on how many different pages of a host each subtree stands; copies of one page count once. A subtree that
stands on many pages of its host is template and is deleted, unless it holds most of the page's text. What a page's own
markup declares to be no content (navigation, headers, footers, asides, forms, scripts, and elements whose class, id or
role says advert, notice, comment and so on) goes as well. If most of the text that other pages do not repeat stands in
articles, the text is what is left of these, else what is left of a main element if it has such text, otherwise what is
left of the body. Paragraph-like blocks inside the elements so chosen are text even if other pages repeat them; others,
and whole articles, go like any template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import SLICE_BYTES, col, slices, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address ul ol dl table tbody thead tfoot tr figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body article main section div nav header footer aside form fieldset details dialog menu center hgroup head option select button".split())
OUTSIDE = frozenset("head nav header footer aside form button select dialog menu svg canvas object video audio datalist".split())
ROOTS = frozenset("html body article main".split())
#: What the first or last part of a class name, an id or a role says about elements that are no content.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification notifications "
    "alert popup modal overlay menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer contentinfo complementary sidebar widget widgets share sharing social related recommended "
    "newsletter subscribe subscription signup login search comment comments commentlist respond reply replies discussion disqus pagination pager toolbar".split()
)
NOT_LABELS = frozenset("has with no without is".split())
#: An open element of the first kind ends where a start tag of the second kind comes.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_attribute = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def labelled(attributes: str) -> bool:
    """Whether an element's attributes say that it is no content, or that it is not shown."""
    for name, *values in _attribute.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] not in NOT_LABELS and (parts[0] in LABELS or parts[-1] in LABELS):
                    return True
    return False


class Page:
    """Blocks and elements of one page, in page order."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool]] = []  # text, innermost element, kept by the markup
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self.sizes: list[int] = []  # text inside that the markup keeps
        self.roots: list[int] = []  # 2 inside an article, 1 inside main, else 0
        self.plain: list[bool] = []  # nothing that the markup excludes around it
        self.parts: list[list[bytes]] = []
        self.stack: list[int] = []
        self.text: list[str] = []
        self.read(html)

    def open(self, tag: str, excluded: bool) -> None:
        parent = self.stack[-1] if self.stack else -1
        self.stack.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(parent)
        self.hashes.append(0)
        self.sizes.append(0)
        self.parts.append([tag.encode()])
        around = self.roots[parent] if parent >= 0 else 0
        self.roots.append(2 if tag == "article" else max(around, 1 if tag == "main" else 0))
        self.plain.append(not excluded and (parent < 0 or self.plain[parent]))

    def close(self) -> None:
        self.flush()
        node = self.stack.pop()
        digest = blake2b(b"\0".join(self.parts[node]), digest_size=8).digest()
        self.hashes[node] = int.from_bytes(digest, "big", signed=True)
        self.parts[node] = []
        parent = self.parents[node]
        if parent >= 0:
            self.parts[parent].append(digest)
            self.sizes[parent] += self.sizes[node]

    def flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            self.text = []
            if block and self.stack:
                node = self.stack[-1]
                self.parts[node].append(block.encode(errors="replace"))
                self.blocks.append((block, node, self.plain[node]))
                if self.plain[node]:
                    self.sizes[node] += len(block)

    def read(self, html: str) -> None:
        self.open("html", False)
        at, raw = 0, ""
        while at < len(html):
            found = _token.search(html, at)
            piece = html[at : found.start() if found else len(html)]
            if piece:
                self.text.append(unescape(piece) if "&" in piece else piece)
            if not found:
                break
            at = found.end()
            ending, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            tag = name.lower()
            if tag == "br":
                self.text.append(" ")
            elif ending:
                self.end(tag)
            elif tag in RAW:
                raw = re.compile(rf"</{tag}(?![\w-])[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = raw.end() if raw else len(html)
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
            elif tag in BLOCKS or tag in OUTSIDE:
                self.start(tag, attributes)
            elif attributes and labelled(attributes):
                self.flush()
                self.open(tag, True)
        while self.stack:
            self.close()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and tag in (self.tags[i] for i in self.stack):
            return
        self.flush()
        if tag in BLOCKS:
            self.leave(lambda t: t == "p", BLOCKS - {"p"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option", "tbody", "tfoot"):
            self.leave(lambda t: tag in ENDS.get(t, ()), frozenset(("ul", "ol", "dl", "table", "select", "div", "section", "article", "nav", "body")))
        if tag in ("body", "header", "nav", "main", "article", "section", "div", "footer"):
            self.leave(lambda t: t == "head", frozenset(("body",)))
        excluded = tag in OUTSIDE or bool(attributes) and tag not in ("html", "body") and labelled(attributes)
        self.open(tag, excluded)

    def leave(self, ends, walls: frozenset) -> None:
        """Close the nearest open element that ends here, unless a wall stands before it."""
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.tags[self.stack[depth]]
            if ends(tag):
                while len(self.stack) > depth:
                    self.close()
                return
            if tag in walls:
                return

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS or tag in OUTSIDE or any(self.tags[i] == tag for i in self.stack[-8:]):
            for depth in range(len(self.stack) - 1, 0, -1):
                node = self.stack[depth]
                if self.tags[node] == tag:
                    while len(self.stack) > depth:
                        self.close()
                    return
                if self.tags[node] in ("article", "main") and tag in PARAGRAPHS:
                    break
            self.flush()

    def level(self, repeated: list[bool] | None = None) -> int:
        """2 if most of the text that is not repeated stands in articles, else 1 if there is some in main, else 0.

        With main elements, articles are weighed against all text of main and articles, otherwise against that of the
        page. If all text is repeated, it is weighed as if it were not.
        """
        sizes = [0, 0, 0]
        for text, node, kept in self.blocks:
            if kept and not (repeated and repeated[node]):
                sizes[self.roots[node]] += len(text)
        if repeated and not any(sizes):
            return self.level()
        around = sizes[1] or sizes[0]
        return 2 if sizes[2] and sizes[2] >= around else 1 if sizes[1] else 0

    def candidates(self) -> list[int]:
        """Elements that may be template: with text that the markup keeps (no other can change a result), not the page, its body or main."""
        held = [False] * len(self.tags)
        for _, node, kept in self.blocks:
            while kept and node >= 0 and not held[node]:
                held[node] = True
                node = self.parents[node]
        return [i for i, tag in enumerate(self.tags) if held[i] and (tag == "article" or tag not in ROOTS)]

    def inside(self, marked: list[bool]) -> list[bool]:
        """The marked elements and all inside them."""
        for i, parent in enumerate(self.parents):
            marked[i] = marked[i] or parent >= 0 and marked[parent]
        return marked

    def main_text(self, template: set[int]) -> str:
        gone = [False] * len(self.tags)
        level = self.level()
        if template:
            hit = [i for i in self.candidates() if self.hashes[i] in template]
            repeated = list(gone)
            for i in hit:
                repeated[i] = True
            level = self.level(self.inside(repeated))
            total = sum(len(text) for text, node, kept in self.blocks if kept and self.roots[node] >= level)
            for i in hit:
                own = self.tags[i] in PARAGRAPHS and level and self.roots[i] >= level and self.plain[i]
                gone[i] = not own and 2 * self.sizes[i] <= total
            gone = self.inside(gone)
        return " ".join(text for text, node, kept in self.blocks if kept and self.roots[node] >= level and not gone[node])


def host_of(url: str) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return found[1].lower() if found else ""


def site_templates(pages: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(key, template): the template subtrees of each page that has some. ``pages``: key, url, html.

    Pages are read once for their hashes, which are written to the shared folder; hosts travel as hashes.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                hashes, whole = [], []
                for html in part.column("html").to_pylist():
                    page = Page(html)
                    hashes.append(sorted({page.hashes[i] for i in page.candidates()}))
                    whole.append(page.hashes[0])
                hosts = [host_of(u) for u in part.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(hosts), pa.array(whole, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["key", "host", "page", "subtrees"])

    read = pages.mapInArrow(subtrees, "key bigint, host string, page bigint, subtrees array<bigint>")
    found = materialize(read.withColumn("host", F.xxhash64("host")), "subtrees")
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = found.select("key", "host", "page", F.explode("subtrees").alias("subtree"))
    counts = each.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    template = counts.join(sizes, "host").where(F.col("n") >= share * F.col("pages")).select("host", "subtree")
    return each.select("key", "host", "subtree").join(template, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("template"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.3) -> DataFrame:
    """The id column, the url column, text (blocks joined by a blank, character references decoded) and n_chars of every page.

    A subtree is template if at least ``least_pages`` different pages of its host and at least ``share`` of them have
    it. Null and empty html: empty text. Null urls share one empty host. Repeated rows count once and get equal texts. Broken
    markup is read as far as it goes: open elements end with the page, an unfinished tag at its end is dropped. Other
    columns are ignored.
    """
    html, url = text_of(pages, html_col), text_of(pages, url_col)
    rows = pages.select(col(pages, id_col).alias("id"), col(pages, url_col).alias("given"), url.alias("url"), html.alias("html"), F.xxhash64(col(pages, id_col), url, html).alias("key"))
    hits = site_templates(rows.select("key", "url", "html"), least_pages, share)
    joined = rows.select("key", "id", "given", "html").join(hits, "key", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                texts = [Page(h).main_text(set(t or ())) for h, t in zip(part.column("html").to_pylist(), part.column("template").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("given"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['given'].dataType.simpleString()}, text string, n_chars bigint"
    return joined.select("id", "given", "html", "template").mapInArrow(extract, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
