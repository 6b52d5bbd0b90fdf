"""Main text of web pages: site templates are found by counting element subtrees per host.

A page becomes a tree of elements.  Every subtree outside the article is
hashed (tags, class names, texts); Spark counts on how many pages of a host
each hash occurs, and subtrees that recur on many pages of their host are
deleted.  What is furniture by its own markup (menus, forms, scripts, ...)
goes on every page.

Inside an ``article`` or ``main`` element the boxes (``BOXES``) that hold less
than half of its text are counted too, but by the articles around them: an
article is known by the longest text outside the box.  So a box with an opaque
class goes when it stands in many different articles, while an article that a
site prints on several pages stays whole, and so do paragraphs, headings and
quotations, which are what an article says.

A page gets only those of its own hashes that are templates, so its list is
no longer than the page, however many templates its host has.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import free_names, stored

SHARE, LEAST_PAGES = 0.2, 3  # a template is on at least this share of a host's pages, and on so many
WHOLE = 0  # stands for the page itself among the hashes
MANY_PAGES = 100  # on so many pages of a host it is one whatever their share

# Element names of the HTML standard by role, and class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
FURNITURE = frozenset("nav header footer aside form script style noscript iframe template button select textarea "
                      "head title menu dialog svg canvas object embed".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("option legend summary caption td th tr tbody thead tfoot".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
            "td": ("tr",), "th": ("tr",), "option": ("select",)}
BOXES = frozenset("div section ul ol dl table details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent notice notices gdpr popup modal overlay newsletter "
    "subscribe signup comment comments reply replies disqus share social related recommended widget pagination "
    "copyright legal".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""",
                        re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Element:
    tag: str
    names: frozenset[str] = frozenset()
    role: str = ""
    hidden: bool = False
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)


def _attributes(text: str) -> tuple[frozenset[str], str, bool]:
    names, role, hidden = set(), "", False
    for m in _ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role":
            role = value.strip()
        else:
            hidden = hidden or key == "hidden" or value == "true"
    return frozenset(names), role, hidden


def parse(source: str) -> Element:
    """Tolerant tree of a page: unclosed and stray tags are mended as browsers do in the common cases."""
    root = node = Element("#root")
    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            node.children.append(source[at:])
            break
        if m.start() > at:
            node.children.append(source[at:m.start()])
        at = m.end()
        if m[2] is None:  # comment, declaration, instruction
            continue
        tag = m[2].lower()
        if m[1]:
            above = node
            while above is not root and above.tag != tag:
                above = above.parent
            if above is not root and above.parent is not None:
                node = above.parent
            continue
        if tag in CLOSES_P:
            node = _closed(node, ("p",), ("article", "main", "section", "div", "body", "li", "td", "blockquote"))
        if tag in SIBLINGS:
            node = _closed(node, ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,),
                           SIBLINGS[tag])
        names, role, hidden = _attributes(m[3]) if m[3] and m[3].strip() else (frozenset(), "", False)
        made = Element(tag, names, role, hidden, node)
        node.children.append(made)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|$)", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            node = made
    return root


def _closed(node: Element, tags: tuple[str, ...], stops: tuple[str, ...]) -> Element:
    """Close the nearest open element of ``tags`` unless one of ``stops`` lies nearer."""
    above = node
    while above.parent is not None and above.tag not in stops:
        if above.tag in tags:
            return above.parent
        above = above.parent
    return node


def _furniture(e: Element) -> bool:
    if e.tag in FURNITURE or e.hidden or e.role in FURNITURE_ROLES:
        return True
    if e.tag in HEADINGS or e.tag in ("html", "body", "article", "main"):
        return False
    return any(name in FURNITURE_WORDS or any(part in FURNITURE_WORDS for part in re.split(r"[-_]+", name)) for name in e.names)


def main_element(root: Element) -> Element:
    """The outermost ``article`` or ``main`` with the most text, else the body, else the whole page."""
    found, body, stack = [], None, [root]
    while stack:
        e = stack.pop()
        if e.tag in ("article", "main") or e.role in ("article", "main"):
            found.append(e)
            continue
        body = e if e.tag == "body" and body is None else body
        if not _furniture(e):
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return max(found, key=_length) if found else body or root


def _length(e: Element) -> int:
    total, stack = 0, [e]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += len(c)
            elif not _furniture(c):
                stack.append(c)
    return total


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of every element's subtree by object id, children first; equal subtrees have equal hashes."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if isinstance(c, Element)]
    hashes: dict[int, int] = {}
    for e in reversed(order):
        state = xxhash.xxh64(f"{e.tag}|{' '.join(sorted(e.names))}")
        for c in e.children:
            state.update(f"|{hashes[id(c)]}" if isinstance(c, Element) else "|" + _SPACE.sub(" ", c).strip())
        hashes[id(e)] = state.intdigest() - 2**63
    return hashes


def _outside(root: Element, article: Element) -> list[Element]:
    """Elements that may be templates: not the article, its parts, what holds it, or parts of furniture."""
    holders, e = set(), article
    while e is not None:
        holders.add(id(e))
        e = e.parent
    whole_page = article.tag in ("body", "#root")
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        if e is article and not whole_page:
            continue
        if id(e) not in holders:
            found.append(e)
        if id(e) in holders or not _furniture(e):
            stack += [c for c in e.children if isinstance(c, Element)]
    return found


def _inside(article: Element) -> list[tuple[Element, int]]:
    """Boxes of an ``article`` or ``main`` that may be templates, each with a hash of the longest text around it.

    Parts of furniture are none, as they go anyway, and neither is a box with half of the article's text or more,
    or one with no text around it.
    """
    if article.tag in ("body", "#root"):
        return []
    pieces: list[str] = []
    spans: list[tuple[Element, int, int]] = []  # box, its first piece, the piece after its last
    stack: list = [article]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if text := _SPACE.sub(" ", item).strip():
                pieces.append(text)
        elif isinstance(item, tuple):
            spans.append((*item, len(pieces)))
        elif item is article or not _furniture(item):
            if item is not article and item.tag in BOXES:
                stack.append((item, len(pieces)))  # comes up again after the children
            stack += reversed(item.children)
    if not spans:
        return []
    upto = [0]
    before: list[str] = [""]  # longest piece before each place, and from each place on
    for text in pieces:
        upto.append(upto[-1] + len(text))
        before.append(max(before[-1], text, key=len))
    after = [""]
    for text in reversed(pieces):
        after.append(max(after[-1], text, key=len))
    after.reverse()
    found = []
    for e, first, end in spans:
        around = max(before[first], after[end], key=len)
        if around and 2 * (upto[end] - upto[first]) < upto[-1]:
            found.append((e, xxhash.xxh64_intdigest(around) - 2**63))
    return found


def template_candidates(source: str | None, page: int = 0) -> list[tuple[int, int]]:
    """Distinct (subtree hash, what it is counted by) of a page, to be looked up in its host's counts.

    Outside the article a subtree is counted by ``page``, inside by the article around it.
    """
    if not source:
        return []
    root = parse(source)
    article = main_element(root)
    candidates = [(e, page) for e in _outside(root, article)] + _inside(article)
    if not candidates:
        return []
    hashes = subtree_hashes(root)
    return sorted({(hashes[id(e)], around) for e, around in candidates})


def main_text(source: str | None, templates: frozenset[int] = frozenset()) -> str:
    """Blocks of the main element in page order, one per line, without furniture and templates."""
    if not source:
        return ""
    root = parse(source)
    article = main_element(root)
    hashes = subtree_hashes(root) if templates else {}
    candidates = _outside(root, article) + [e for e, _ in _inside(article)] if templates else []
    dropped = {id(e) for e in candidates if hashes[id(e)] in templates}
    blocks: list[str] = []
    pieces: list[str] = []

    def close() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        if line:
            blocks.append(line)
        pieces.clear()

    in_order: list[Element | str | None] = list(reversed(article.children))  # None ends a block
    while in_order:
        item = in_order.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            pieces.append(item)
        elif id(item) in dropped:
            continue
        elif _furniture(item):
            if item.tag == "header":  # the heading of an article may stand in its header
                in_order += [part for c in reversed(item.children) if isinstance(c, Element) and c.tag in HEADINGS
                             for part in (None, *reversed(c.children), None)]
        elif item.tag == "br":
            pieces.append(" ")
        elif item.tag in BLOCKS:
            close()
            in_order.append(None)
            in_order += reversed(item.children)
        else:
            in_order += reversed(item.children)
    close()
    return "\n".join(blocks)


def page_hashes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, hash, page, around): the template candidates of every page with what they are counted by, and ``WHOLE`` for the page itself."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("hash", T.LongType()),
                           T.StructField("page", T.LongType()), T.StructField("around", T.LongType())])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, h, page, around) for host, source, page in zip(batch["host"], batch["html"], batch["page"])
                    for h, around in ((WHOLE, page), *template_candidates(source, page))]
            yield pd.DataFrame(rows, columns=["host", "hash", "page", "around"])

    return pages.select(_host(url).alias("host"), F.col(html).alias("html"), F.xxhash64(html).alias("page")).mapInPandas(hashed, schema)


def site_templates(hashes: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES,
                   many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur on many pages of the host, from the hashes of its pages.

    Equal pages of a host count once, and so do equal articles around a box.  A page whose url has no host belongs to
    the host ''.
    """
    counts = hashes.groupBy("host", "hash").agg(F.countDistinct("around").alias("n"))
    totals = counts.where(F.col("hash") == WHOLE).select("host", F.col("n").alias("pages"))
    return counts.where((F.col("hash") != WHOLE) & (F.col("n") >= least_pages)).join(totals, "host") \
        .where((F.col("n") >= many_pages) | (F.col("n") >= share * F.col("pages"))).select("host", "hash")


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url", name: str = "text",
                      share: float = SHARE, least_pages: int = LEAST_PAGES, many_pages: int = MANY_PAGES) -> DataFrame:
    """Add ``name``: the main text of each page; a null or empty page gives ''.

    Rows, also repeated ones, and the other columns stay as they are; a column
    called ``name`` is replaced.  The hashes and the templates are written once,
    so a small table of templates is broadcast and a large one joined by hash.
    """
    hashes = stored(page_hashes(pages, html, url), "hashes")
    templates = stored(site_templates(hashes, share, least_pages, many_pages), "templates")
    own = stored(hashes.join(templates, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("templates")), "own")

    @F.pandas_udf(T.StringType())
    def extract(sources: pd.Series, lists: pd.Series) -> pd.Series:
        sets = ((frozenset(x) if x is not None else frozenset()) for x in lists)
        return pd.Series([main_text(source, found) for source, found in zip(sources, sets)], dtype=object)

    host, page, found = free_names(pages, "_host", "_page", "_templates")
    keyed = pages.withColumns({host: _host(url), page: F.xxhash64(html)}).join(own.select(
        F.col("host").alias(host), F.col("page").alias(page), F.col("templates").alias(found)), [host, page], "left")
    kept = [c for c in pages.columns if c.lower() != name.lower()]
    return keyed.select(*kept, extract(F.col(html), F.col(found)).alias(name)).select(
        *(name if c.lower() == name.lower() else c for c in pages.columns), *([] if len(kept) < len(pages.columns) else [name]))
