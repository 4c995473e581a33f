"""Main text of web pages by template deduction over equivalence classes.

All pages of a host are taken together. A token is a structural element, by the path of structural elements down to it, or a
text with the path it stands on. Its occurrence vector says how often each page has it; tokens with equal vectors form an
equivalence class. A class is valid if its tokens stand once on each of at least two different pages and an element is among
them that holds the others: it is a part of the host's template, and as paths nest, so do the classes: those of one layout
lie within elements that all layouts share. Texts of a valid class are the template's own. What varies fills its slots.

The main text of a page is what its slots hold: the innermost element around all slots that have text, without what lies in
menus, headers, footers, sidebars, notices, adverts, forms, comments and the like. Template texts outside of that element are
left out; inside it nothing is left out but those. A page alone on its host has only slots.

Vectors are compared by sums of hashes over pages, which partial aggregation adds up: no host is ever gathered.
"""

from __future__ import annotations

import html as html_
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch, runs

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "canvas"}
#: Elements beside the article.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "header"}
#: Elements within a line; all others end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that structure a page; only these are nested, as the rest is often left open.
FRAME = {"html", "head", "body", "nav", "header", "footer", "aside", "article", "main", "section", "div", "form", "ul", "ol", "dl", "table", "menu", "dialog", "select", "button", "center"}
#: Elements that say themselves that they hold the main text.
MAIN = ("article", "main")
#: Elements that end where the next of their name begins.
REPEATED = {"li", "dt", "dd", "tr", "td", "th", "option"}
#: Parts of class, id and role that name what is beside the article.
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|notification|popup|modal|newsletter|subscribe|sidebar|side|menu|nav|navigation|navbar|breadcrumbs?|comments?|replies|reply|respond|disqus|share|sharing|social|related|recommended|footer|header|masthead|login|signup|search|pagination|pager|widget|toolbar|skip)(?:$|[\s_-])", re.I)


def host_of(url: str | None) -> str:
    """The host in lower case, without scheme, user and port; '' if there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def parts(page: str | None):
    """('tag', name, closing, names) and ('text', text) in page order; content of RAW elements is skipped, that of xmp is text
    as it stands."""
    page, at, until = page or "", 0, None
    length = len(page)
    while at < length:
        if until:  # inside an element whose content has no tags
            end = re.compile(rf"</{re.escape(until)}\b", re.I).search(page, at)
            to = end.start() if end else length
            if until == "xmp" and to > at:
                yield "text", page[at:to].replace("&", "&amp;")
            at, until = to, None
            continue
        found = _TOKEN.search(page, at)
        if not found:
            yield "text", page[at:]
            return
        if found.start() > at:
            yield "text", page[at : found.start()]
        at = found.end()
        if found[2]:
            name, closing, rest = found[2].lower(), bool(found[1]), found[3]
            names = " ".join(next(filter(None, a.groups()[1:]), "") for a in _ATTRIBUTE.finditer(rest)) if not closing else ""
            yield "tag", name, closing, names
            if (name in RAW or name == "xmp") and not closing and not rest.endswith("/"):
                until = name


class Node:
    """A structural element of one page: its path, what it lies in, and whether that is beside the main text."""

    __slots__ = ("path", "up", "name", "beside", "depth")

    def __init__(self, up: Node | None, name: str, names: str):
        self.up, self.name = up, name
        self.path = f"{up.path}/{name}{'.' * bool(names)}{names}" if up else ""
        self.depth = up.depth + 1 if up else 0
        inside = up is not None and (up.beside or name in ASIDE and not (name == "header" and up.within(MAIN)))
        self.beside = inside or bool(names) and name not in ("html", "body", *MAIN) and bool(BESIDE.search(names))

    def within(self, names: tuple[str, ...]) -> bool:
        node = self
        while node:
            if node.name in names:
                return True
            node = node.up
        return False


def read(page: str | None) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The structural elements of a page and its texts, in page order: (element, text), None where a block begins or ends.

    Elements that are often left open (paragraphs, list items, headings) are blocks but no structure, unless their class names
    them as beside the main text. An end tag closes the nearest open element of its name with all that was left open in it; one
    that closes nothing is left alone.
    """
    root = at = Node(None, "", "")
    nodes, texts = [root], []
    for part in parts(page):
        if part[0] == "text":
            texts.append((at, part[1]))
            continue
        _, name, closing, names = part
        if name not in INLINE:
            texts.append((at, None))
            if not closing and (at.name == "p" and name not in VOID or at.name == name and name in REPEATED):
                at = at.up
        if closing:
            node = at
            while node.up and node.name != name:
                node = node.up
            if node.up:
                at = node.up
        elif name not in VOID and (name in FRAME or name in ASIDE or names and BESIDE.search(names)):
            at = Node(at, name, names)
            nodes.append(at)
    return nodes, texts


def _digest(*parts_: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts_).encode("utf-8", "surrogatepass")) >> 1


class Block(NamedTuple):
    node: Node
    digest: int  # of its path and what it reads
    text: str
    glued: bool  # no block ends between the one before and this


def blocks(texts: list[tuple[Node, str | None]]) -> list[Block]:
    """Texts up to where a block ends or another element begins, without those that read as nothing."""
    out, held, node, glued = [], [], None, False
    for at, text in [*texts, (None, None)]:
        if held and (text is None or at is not node):
            own = html_.unescape("".join(held))
            if reads := _SPACE.sub(" ", own).strip():
                out.append(Block(node, _digest(node.path, reads), own, glued))
                glued = True
            else:
                glued = False
            held = []
        if text is None:
            glued = False
        else:
            held.append(text)
            node = at
    return out


def templates(pages: DataFrame, *, share: float = 0.02) -> DataFrame:
    """host, classes: the valid equivalence classes of each host, each with the number of its pages, its elements (paths, in
    page order) and its texts (digests).

    A class needs two different pages and ``share`` of the host's pages; texts of rarer ones count as slots, so none is lost.
    What a host's row holds is then at most 1 / ``share`` times a page's tokens.
    """

    def count(batches):
        for batch in batches:
            sums: dict[tuple[str, int, str], list[int]] = {}
            for url, page in ((u.as_py(), h.as_py()) for u, h in zip(batch.column(0), batch.column(1), strict=True)):
                nodes, texts = read(page)
                seen: dict[tuple[int, str], list[int]] = {}
                for place, node in enumerate(nodes):
                    seen.setdefault((0, node.path), [0, place])[0] += 1
                for block in blocks(texts):
                    if not block.node.beside:
                        seen.setdefault((block.digest, ""), [0, 0])[0] += 1
                mark = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))
                h1, h2, host = mark & 0x3FFFFFFF, mark >> 33, host_of(url)
                for (digest, path), (n, place) in seen.items():
                    own = sums.setdefault((host, digest, path), [0, 0, 0, 0, 0, mark >> 1, mark >> 1])
                    for k, v in enumerate((1, n, h1 * n, h2 * n, place)):
                        own[k] += v
                    own[5], own[6] = min(own[5], mark >> 1), max(own[6], mark >> 1)
            if sums:
                hosts, digests, paths = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(digests, pa.int64()), pa.array(paths), *(pa.array(x, pa.int64()) for x in zip(*sums.values(), strict=True))], names=["host", "digest", "path", "pages", "n", "s1", "s2", "place", "low", "high"])

    sums = pages.select("url", "html").mapInArrow(count, "host string, digest long, path string, pages long, n long, s1 long, s2 long, place long, low long, high long")
    vectors = sums.groupBy("host", "digest", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "s1", "s2", "place")), F.min("low").alias("low"), F.max("high").alias("high"))
    # the page itself is the element with the empty path: it stands once on each page of the host
    vectors = vectors.filter("n = pages AND low < high")
    element = F.col("digest") == 0
    own = vectors.groupBy("host", "s1", "s2", "pages").agg(
        F.sort_array(F.collect_list(F.when(element, F.struct((F.col("place") / F.col("pages")).alias("place"), "path")))).alias("elements"),
        F.collect_list(F.when(~element, F.col("digest"))).alias("texts"),
        F.max(element & (F.col("path") == "")).alias("whole"),
    )
    valid = own.filter(F.size("elements") > 0)
    hosts = valid.filter("whole").select("host", F.col("pages").alias("all"))
    kept = valid.join(hosts, "host").filter(F.col("pages") >= F.col("all") * share)
    return kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.col("pages"), F.transform("elements", lambda x: x["path"]).alias("elements"), "texts")), asc=False).alias("classes"))


def main_text(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's main text. ``template``: digests of the texts that are the template's own."""
    nodes, texts = read(page)
    found = blocks(texts)
    own = [b for b in found if not b.node.beside]
    around = _around([b.node for b in own if b.digest not in template])
    if around:  # a slot is no page: at least half of what is not beside the main text lies within
        whole = _size(own, nodes[0])
        while around.up and 2 * _size(own, around) < whole:
            around = around.up
    around = _named(around or nodes[0], nodes, own)
    out = []
    for block in found:
        if not block.glued:
            out.append(" ")
        if not block.node.beside and _holds(around, block.node):
            out.append(block.text)
    return _SPACE.sub(" ", "".join(out)).strip()


def _holds(node: Node, inner: Node | None) -> bool:
    while inner and inner.depth > node.depth:
        inner = inner.up
    return inner is node


def _size(own: list[Block], node: Node) -> int:
    return sum(len(b.text) for b in own if _holds(node, b.node))


def _around(nodes: list[Node]) -> Node | None:
    """The innermost element that holds all of ``nodes``."""
    found = nodes[0] if nodes else None
    for node in nodes:
        while not _holds(found, node):
            found = found.up
    return found


def _named(around: Node, nodes: list[Node], own: list[Block]) -> Node:
    """Where a page names the element of its main text: the outermost such around ``around``, or the only one in it if that has
    at least half of the text; else ``around``."""
    for name in MAIN:
        node, found = around, None
        while node:
            if node.name == name:
                found = node
            node = node.up
        inside = [n for n in nodes if n.name == name and not n.beside and _holds(around, n)]
        if found or len(inside) == 1 and 2 * _size(own, inside[0]) >= _size(own, around):
            return found or inside[0]
    return around


def extract(pages: DataFrame, *, share: float = 0.02, broadcast_bytes: int = 8 << 20, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html): the main text, '' if there is none.

    Null html is empty, a null url belongs to the host '', repeated rows come back each, and equal pages of a host are one page
    for its template; an empty table gives no rows; other columns are not read. Templates go to all tasks if they are measured to
    have at most ``broadcast_bytes``; else they meet their pages by a shuffle on host and one of ``salts`` parts, so that a host
    with most of the pages is no hot key.
    """
    with Scratch(pages.sparkSession, "html") as scratch:
        own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
        texts = F.array_distinct(F.flatten(F.transform("classes", lambda c: c["texts"])))
        found = scratch.keep(templates(own, share=share).select(F.col("host").alias("own_host"), texts.alias("template")).filter(F.size("template") > 0))
    size = found.agg(F.sum(F.length("own_host") + F.size("template") * 8 + 32)).first()[0] or 0
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", 1), r"^.*@", ""), r":.*$", ""))
    rows = own.withColumn("host", host)
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(found), F.col("host") == F.col("own_host"), "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)))
        found = found.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(found, (F.col("host") == F.col("own_host")) & (F.col("salt") == F.col("own_salt")), "left")
    joined = joined.select("page_id", "url", "html", "template")

    def each(batches):
        for batch in batches:
            for a, b in runs(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = []
                for page, template in zip(part.column(2), part.column(3), strict=True):
                    texts.append(main_text(page.as_py(), frozenset(template.values.to_pylist()) if template.is_valid else frozenset()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(each, "page_id long, url string, text string, n_chars long")
