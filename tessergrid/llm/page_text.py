"""Main text of web pages, with removal of what recurs on the pages of a site.

A page becomes a tree of its block elements (inline markup only separates or joins
text). Spark counts, per host, with how many different main contents each subtree
occurs, by the hash of its tags and text; subtrees that recur on many pages of the
host are template and go, besides elements that say what they are: menus, headers, footers, sidebars,
notices, adverts, forms and reader comments by tag, role, class or id. Paragraphs
and headings of the article itself are never taken for template, however many
pages carry the same article, nor is a subtree that holds half of the page's text;
pages with one and the same main content count once, whatever element holds it.

Form controls, media and what shows only without scripts (``noscript``) are not read; formulas (``math``) and what
stands in for an object are.

Defined cases: null or empty html gives an empty text; a page without an article
is read from <main>, else from the body; unclosed and stray tags are tolerated as
browsers do; a page whose url has no host is counted under the empty host; repeated
rows count once and are answered row by row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import SharedTables, append_columns

#: A subtree is template if it occurs on so many pages of its host, and on such a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: On so many pages it is template whatever their share: on a host of more than 125 pages the share would ask for more.
MANY_PAGES = 25
#: Template subtrees up to this number are broadcast; beyond it, pages are joined with theirs.
BROADCAST_ROWS = 100_000

_NAME_END = re.compile(r"[\s/>]|\Z")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[^a-z0-9]+")

# What elements are.
_BLOCKS = frozenset("html body div section article main nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog fieldset center hr menu search".split())
_UNREAD = frozenset("script style title textarea noscript template iframe svg select button canvas audio video head option".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd tr figcaption caption".split())
_VOID = frozenset("hr br img input meta link wbr col source track embed area base param".split())
_SPACED = frozenset("br td th img".split())
_LISTS = frozenset("li ul ol menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROPPED_TAGS = frozenset("nav footer aside form dialog menu search".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus replies share sharing social related recommended widget".split()
)
_OUTSIDE_ARTICLE = frozenset("header masthead topbar".split())
#: Words that say nothing of themselves: with one of the names above, a class still names such an element.
_NEUTRAL = frozenset("box boxes wrap wrapper container content bar list section area block panel item items link links button buttons icons inner outer top bottom left right site page global main slot unit form text message banner group row col footer header js sm md lg".split())


class Node:
    __slots__ = ("digest", "dropped", "inside", "kids", "list", "main", "parent", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, inside: bool):
        self.tag, self.parent, self.dropped, self.inside = tag, parent, dropped, inside
        self.kids: list[Node | str] = []
        self.digest, self.size = "", 0
        #: The nearest list or list item that it is or lies in; whether it is or lies in a main part.
        self.list: Node | None = self if tag in _LISTS else parent.list if parent else None
        self.main: bool = parent.main if parent else False


class Markup:
    """The tags of a page, from a place on, in time that grows with the page only, whatever it holds.

    A tag ends at the first > outside quotes. Where that is for a tag that begins anywhere is worked out once, from the end
    of the page; what has no such end is text.
    """

    def __init__(self, html: str):
        self.html = html
        self.special = [m.start() for m in _SPECIAL.finditer(html)]
        n = len(self.special)
        self.end = [-1] * (n + 1)
        later = {'"': n, "'": n}
        for k in range(n - 1, -1, -1):
            c = html[self.special[k]]
            if c == ">":
                self.end[k] = self.special[k] + 1
            else:
                self.end[k] = self.end[later[c] + 1] if later[c] < n else -1
                later[c] = k
        self.absent: set[str] = set()
        self.stop = -1

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether an end tag, name (None if not an element) and attributes of the next tag."""
        html = self.html
        while (a := html.find("<", at)) >= 0:
            at = a + 1
            if html.startswith("<!--", a):
                b = html.find("-->", a + 4)
                return a, b + 3 if b >= 0 else len(html), False, None, ""
            if html.startswith(("<!", "<?"), a):
                b = self._find(">", a + 2)
                if b >= 0:
                    return a, b + 1, False, None, ""
            else:
                name = at + html.startswith("/", at)
                if html[name : name + 1].isalpha() and html[name].isascii():
                    stop = self._name_end(name)
                    b = self.end[bisect_left(self.special, stop)]
                    if b >= 0:
                        return a, b, name > at, html[name:stop].lower(), html[stop : b - 1]
        return None

    def _name_end(self, at: int) -> int:
        """Where a name that begins here ends; names that begin within it end there as well."""
        if at > self.stop:
            self.stop = _NAME_END.search(self.html, at).start()
        return self.stop

    def _find(self, what: str, at: int) -> int:
        """What is not found from one place on is not looked for again."""
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def search(self, pattern: str, at: int) -> re.Match | None:
        if pattern in self.absent:
            return None
        found = re.compile(pattern, re.I).search(self.html, at)
        if found is None:
            self.absent.add(pattern)
        return found


def _named(names: list[str], inside: bool) -> bool:
    """Whether a class or an id says that an element is none of the main text.

    Outside the article a part of a name is enough; inside it the whole must say so, so that ``related-work`` or
    ``notice-board-history`` stays while ``share-buttons`` goes.
    """
    for name in names:
        parts = {x for x in _PART.split(name) if x}
        if parts & _DROPPED_NAMES and (not inside or parts <= _DROPPED_NAMES | _NEUTRAL):
            return True
    return False


def _boilerplate(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is none of the main text, and whether it says it is the main part."""
    main = False
    if "=" in attributes:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "")
        main = role == "main"
        names = [x for k in ("class", "id") if k in found for x in found[k].split()]
        top = not inside and any(x in _OUTSIDE_ARTICLE for n in names for x in _PART.split(n))
        if role in _DROPPED_ROLES or top or (tag not in ("html", "body") and _named(names, inside)):
            return True, main
    return tag in _DROPPED_TAGS or (tag == "header" and not inside), main


def parse(html: str) -> tuple[Node, list[Node], list[Node]]:
    """The tree of block elements, its articles and its main parts."""
    root = now = Node("", None, False, False)
    articles: list[Node] = []
    mains: list[Node] = []
    text: list[str] = []

    def end_text() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            joined = " ".join((unescape(joined) if "&" in joined else joined).split())
            if joined:
                now.kids.append(joined)

    def leave(node: Node) -> None:
        """Close what is open down to ``node``, and that as well."""
        nonlocal now
        while now is not node.parent:
            opened[now.tag] -= 1
            now = now.parent

    opened: Counter[str] = Counter()
    markup = Markup(html)
    at = 0
    while found := markup.next(at):
        a, b, ends, tag, attributes = found
        if a > at:
            text.append(html[at:a])
        at = b
        if tag is None:
            continue
        if ends:
            if opened[tag]:
                node = now
                while node.tag != tag:
                    node = node.parent
                end_text()
                leave(node)
            continue
        if tag in _UNREAD:
            if not attributes.endswith("/"):
                close = markup.search(rf"</{re.escape(tag)}\s*>", b)
                if tag == "head":
                    body = None if close else markup.search(r"<body\b", b)
                    at = close.end() if close else body.start() if body else b
                else:
                    at = close.end() if close else len(html)
            continue
        if tag in _BLOCKS:
            end_text()
            if now.tag == "p" or (now.tag in _HEADINGS and tag in _HEADINGS):
                leave(now)
            if tag == "li" and now.list and now.list.tag == "li":
                leave(now.list)
            if tag in ("tr", "dt", "dd") and now.tag in ("tr", "dt", "dd"):
                leave(now)
            drop, main = _boilerplate(tag, attributes, now.inside)
            node = Node(tag, now, now.dropped or drop, now.inside or tag == "article")
            now.kids.append(node)
            if not node.dropped:
                if tag == "article" and not now.inside:
                    articles.append(node)
                elif tag == "main" or main:
                    mains.append(node)
                    node.main = True
            if tag not in _VOID:
                now = node
                opened[tag] += 1
        elif tag in _SPACED:
            text.append(" ")
    if at < len(html):
        text.append(html[at:])
    end_text()
    return root, articles, mains


def _seal(node: Node) -> None:
    """Hashes and text sizes of a subtree, from the leaves up, without recursion."""
    stack = [(node, False)]
    while stack:
        x, ready = stack.pop()
        if not ready:
            stack.append((x, True))
            stack += [(k, False) for k in x.kids if isinstance(k, Node)]
            continue
        x.size = sum(k.size if isinstance(k, Node) else len(k) for k in x.kids)
        said = "\x1f".join([x.tag, *(k.digest if isinstance(k, Node) else f"\x1e{k}" for k in x.kids)])
        x.digest = hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _roots(tree: Node, articles: list[Node], mains: list[Node]) -> list[Node]:
    if articles:
        return articles
    outer = [m for m in mains if not m.parent.main]
    return outer or [tree]


def _deletable(tree: Node, roots: list[Node]) -> Iterator[Node]:
    """Subtrees that may be template: not a paragraph of the article, and not half of the text or more."""
    main = {id(r) for r in roots}
    total = sum(r.size for r in roots)
    stack = [(k, tree in roots) for k in tree.kids if isinstance(k, Node)]
    while stack:
        x, own = stack.pop()
        own = own or id(x) in main
        if x.size and id(x) not in main and not (own and (x.tag in _PLAIN and x.inside or 2 * x.size >= total)):
            yield x
        stack += [(k, own) for k in x.kids if isinstance(k, Node)]


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def subtree_hashes(html: str | None) -> list[int]:
    """Distinct hashes of the subtrees of a page that could be template."""
    return _page_hashes(html)[1]


def _page_hashes(html: str | None) -> tuple[int, list[int]]:
    """The hash of a page's main content, before any template goes, and those of subtree_hashes."""
    tree, articles, mains = parse(html or "")
    _seal(tree)
    roots = _roots(tree, articles, mains)
    content = hashlib.blake2b("\n\n".join(_blocks(roots, set())).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return int(content, 16) - (1 << 63), sorted({int(n.digest, 16) - (1 << 63) for n in _deletable(tree, roots)})


def main_text(html: str | None, template: Callable[[int], bool] | None = None) -> str:
    """Blocks of the main text in page order, joined by blank lines."""
    tree, articles, mains = parse(html or "")
    roots = _roots(tree, articles, mains)
    gone: set[int] = set()
    if template is not None:
        _seal(tree)
        gone = {id(n) for n in _deletable(tree, roots) if template(int(n.digest, 16) - (1 << 63))}
    return "\n\n".join(_blocks(roots, gone))


def _blocks(roots: list[Node], gone: set[int]) -> list[str]:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped and id(x) not in gone:
            stack += reversed(x.kids)
    return out


def template_subtrees(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, subtree): subtrees on at least ``min_pages`` pages and ``min_share`` of the pages of their host,
    or on ``many_pages`` of them; pages with the same main content are one."""
    found = _occurrences(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))
    # the number of pages of a host is the count of the marker null, so the same shuffles count both;
    # the counts are stored, since both filters on them would otherwise parse all pages
    marked = found.select("host", "content", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "subtrees")).alias("subtree")).distinct()
    counts = SharedTables(pages.sparkSession).store(marked.groupBy("host", "subtree").agg(F.count("*").alias("n")))
    often = counts.where(F.col("subtree").isNotNull() & (F.col("n") >= min_pages))
    hosts = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    return often.join(hosts, "host").where(F.col("n") >= F.least(F.col("pages") * min_share, F.lit(many_pages))).select("host", "subtree")


def _occurrences(pages: DataFrame) -> DataFrame:
    def run(column: pa.Array) -> list[pa.Array]:
        rows = [(host_of(u), *_page_hashes(h)) for u, h in zip(column.field("url").to_pylist(), column.field("html").to_pylist(), strict=True)]
        return [pa.array([h for h, _, _ in rows], pa.string()), pa.array([c for _, c, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.list_(pa.int64()))]

    others = [c for c in pages.columns if c not in ("url", "html")]
    return append_columns(pages.select(*others, F.struct("url", "html").alias("page")), "page", run, "host string, content bigint, subtrees array<bigint>").drop("page")


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    kept = SharedTables(pages.sparkSession)
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    template = kept.store(template_subtrees(base, min_pages=min_pages, min_share=min_share, many_pages=many_pages))
    if template.count() <= broadcast_rows:
        known = pages.sparkSession.sparkContext.broadcast({(h, s) for h, s in template.collect()})

        def run(column: pa.Array) -> list[pa.Array]:
            at = known.value
            rows = zip(column.field("url").to_pylist(), column.field("html").to_pylist(), strict=True)
            texts = [main_text(h, lambda s, k=host_of(u): (k, s) in at) for u, h in rows]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        made = base.select("page_id", "url", F.struct("url", "html").alias("page"))
    else:
        # rows are told apart by a hash of all they hold; equal rows have equal subtrees
        named = base.withColumn("row", F.xxhash64("page_id", "url", "html"))
        each = kept.store(_occurrences(named.select("row", "url", "html")).select("row", "host", F.explode("subtrees").alias("subtree")).distinct())
        gone = each.join(template, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("gone"))
        made = named.join(gone, "row", "left").select("page_id", "url", F.struct("url", "html", "gone").alias("page"))

        def run(column: pa.Array) -> list[pa.Array]:
            rows = zip(column.field("html").to_pylist(), column.field("gone").to_pylist(), strict=True)
            texts = [main_text(h, set(g or ()).__contains__) for h, g in rows]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(made, "page", run, "text string, n_chars bigint").drop("page")


__all__ = ["extract_pages", "host_of", "main_text", "parse", "subtree_hashes", "template_subtrees"]
