"""Main text of web pages, with template subtrees of a site removed.

Pages are read by one pass over their tags. Elements that a page itself declares to be
something else than the article (menus, forms, adverts, comments, ...) are left out first. A
class or an id alone does not take the article away: an element around the page's main, or
around its only articles, stays. Every element that is left has a hash of its tag and content.
The hashes of blocks are counted per host in Spark, once per distinct page, and blocks that
recur on many pages of the host are deleted as templates; inline elements and table cells
stay or go with the block around them. A second pass over the pages writes the text of the rest.

Defined results: a null or empty page, or one without an article's text, gives an empty text;
unclosed and misnested tags are closed as browsers do; a page without a host belongs to the
host ''; copies of one page count once, so an article that a site repeats whole is no template;
repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, map_batches
from corpusmill.session import materialize

# A subtree is a template if it stands on this many distinct pages of a host and on this share of them.
TEMPLATE_PAGES = 10
TEMPLATE_SHARE = 0.1

# Fixed values of HTML: elements whose content is no markup, that have no content, that start a block.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
# Opening one of these ends an open element of the named kinds, up to the nearest of the last set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
P_ENDERS = BLOCK - frozenset("body html td th tr tbody thead tfoot dt dd br li option title".split()) | {"table"}
P_SCOPE = frozenset("html table td th button object template".split())

# What is not the article: by element, by role, by a word of the class or id.
OTHER_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe button select svg canvas head dialog menu object "
    "textarea title xmp noembed noframes video audio datalist fieldset input".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars menu nav "
    "navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies cookie cookies consent notice notices "
    "banner popup modal newsletter subscribe subscription share sharing social related widget login signup masthead".split()
)
OUTER_WORDS = frozenset(["header", "topbar"])
# Of these words, those of elements that hold comments, each of which may be an article of its own.
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
# Blocks that are no template on their own.
CELLS = frozenset(["td", "th"])

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?/][^>]*+>", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/>]|\Z)", re.I)
_WORD = re.compile(r"[a-z]+")


# How an element says that it is not the article: not at all, by its class or id as other parts or as comments, for certain.
ARTICLE, NAMED, COMMENTS, OTHER = range(4)


def _is_other(tag: str, attributes: str, in_article: bool) -> int:
    if tag in OTHER_TAGS or (tag == "header" and not in_article):
        return OTHER
    if len(attributes) < 4 or tag in ("html", "body", "main") or (tag == "article" and "comment" not in attributes.lower()):
        return ARTICLE
    other = COMMENT_WORDS if tag == "article" else OTHER_WORDS if in_article else OTHER_WORDS | OUTER_WORDS
    found = ARTICLE
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return OTHER
        if name == "role" and OTHER_ROLES.intersection(_WORD.findall(value)):
            return OTHER
        if name in ("class", "id"):
            # A name of several words, such as nav-menu, counts if all of them do.
            for words in map(_WORD.findall, value.split()):
                if words and other.issuperset(words):
                    found = max(found, NAMED if COMMENT_WORDS.isdisjoint(words) else COMMENTS)
    return found


class Page:
    """The parts of a page that may be its article, and the subtrees they form."""

    def __init__(self, source: str | None):
        self._kept: frozenset[int] = frozenset()
        self._parse(source)
        # Elements that only their names make something else stay if they hold the main, or all articles there are.
        if self._around_main:
            self._parse(source, self._around_main)
        if self._around_articles and not (self.articles or self.mains):
            self._parse(source, self._around_articles)
        if self._around_comments and not self.text():
            self._parse(source, self._around_comments)

    def _parse(self, source: str | None, kept: set[int] = frozenset()) -> None:
        self._kept |= kept
        # Numbers of the named elements around a main, around an article, around an article among comments.
        self._around_main: set[int] = set()
        self._around_articles: set[int] = set()
        self._around_comments: set[int] = set()
        self._named: list[tuple[int, int]] = []  # number and kind of the open elements left out by name
        self._number = self._certain = 0
        self.parts: list[str] = []
        self.subtrees: list[tuple[int, int, int]] = []  # first part, end, hash
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self._open: list[tuple[str, int, int, list[str]]] = []  # tag, first part, how left out, content for the hash
        self._out = self._in_article = 0
        if source:
            self._read(source)
        while self._open:
            self._close()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(source[at:])
                return
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                self._end(name)
            else:
                self._start(name, tag[3])
                if name in RAW:
                    closing = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                    at = closing.end() if closing else end
                    self._close()

    def _text(self, raw: str) -> None:
        if not self._out:
            text = html.unescape(raw)
            self.parts.append(text)
            if self._open:
                self._open[-1][3].append(text)

    def _start(self, name: str, attributes: str) -> None:
        if name in P_ENDERS:
            self._end_open(("p",), P_SCOPE)
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name in BLOCK and not self._out:
            self.parts.append(" ")
        if name in VOID:
            return
        other = _is_other(name, attributes, self._in_article > 0)
        self._number += 1
        if other in (NAMED, COMMENTS):
            if self._number in self._kept:
                other = ARTICLE
            else:
                self._named.append((self._number, other))
        self._out += other > 0
        self._certain += other == OTHER
        if name in ("article", "main") and self._named and not self._certain:
            numbers = {number for number, _ in self._named}
            if name == "main":
                self._around_main |= numbers
            elif any(kind == COMMENTS for _, kind in self._named):
                self._around_comments |= numbers
            else:
                self._around_articles |= numbers
        self._in_article += name == "article"
        self._open.append((name, len(self.parts), other, []))

    def _end_open(self, names: tuple[str, ...], scope) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in names:
                while len(self._open) > i:
                    self._close()
                return
            if self._open[i][0] in scope:
                return

    def _end(self, name: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            tag = self._open[i][0]
            if tag == name:
                while len(self._open) > i:
                    self._close()
                return
            # An inline end tag never ends a block around it.
            if tag in BLOCK and name not in BLOCK:
                return

    def _close(self) -> None:
        tag, first, other, content = self._open.pop()
        self._in_article -= tag == "article"
        if not self._out:
            mark = xxhash.xxh3_64_intdigest("\x1f".join([tag, *content]))
            if any(map(str.strip, content)):
                if tag in BLOCK and tag not in CELLS:
                    self.subtrees.append((first, len(self.parts), mark - (1 << 63)))
                if tag in ("article", "main"):
                    (self.articles if tag == "article" else self.mains).append((first, len(self.parts)))
                if self._open:
                    self._open[-1][3].append(f"\x1e{mark:x}")
            if tag in BLOCK:
                self.parts.append(" ")
        self._out -= other > 0
        self._certain -= other == OTHER
        if other in (NAMED, COMMENTS):
            self._named.pop()

    def _roots(self) -> list[tuple[int, int]]:
        outermost: list[tuple[int, int]] = []
        for first, end in sorted(self.articles or self.mains or [(0, len(self.parts))], key=lambda r: (r[0], -r[1])):
            if not outermost or first >= outermost[-1][1]:
                outermost.append((first, end))
        return outermost

    def marks(self) -> list[int]:
        """Distinct hashes of the subtrees inside the article."""
        roots = self._roots()
        return list({m for first, end, m in self.subtrees if any(a <= first and end <= b and (first, end) != (a, b) for a, b in roots)})

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        parts = self.parts
        if templates:
            parts = parts.copy()
            for first, end, mark in self.subtrees:
                if mark in templates:
                    parts[first:end] = [" "] * (end - first)
        return " ".join(" ".join("".join(parts[a:b]) for a, b in self._roots()).split())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def template_subtrees(
    pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE
) -> DataFrame:
    """``(page_key, marks)``: for each distinct page that has any, the hashes of its template subtrees."""
    def start():
        def read(batch):
            found = [Page(t) for t in batch.column(2).to_pylist()]
            texts = [xxhash.xxh3_64_intdigest(p.text()) - (1 << 63) for p in found]
            return batch.column(0), [host_of(u) for u in batch.column(1).to_pylist()], texts, [p.marks() for p in found]

        return read

    keyed = pages.select("page_key", "url", "html")
    marked = materialize(map_batches(keyed, "page_key bigint, host string, content bigint, marks array<bigint>", start), "marks")
    # One page for each text a host shows, so that copies of an article are no template.
    shown = marked.groupBy("host", "content").agg(F.min("page_key").alias("page_key"))
    sizes = shown.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    once = marked.join(shown, ["host", "content", "page_key"]).dropDuplicates(["host", "content"])
    counts = once.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("_n"))
    often = materialize(counts.where(F.col("_n") >= least_pages), "recurring")
    enough = F.greatest(F.lit(float(least_pages)), F.col("_pages") * least_share)
    templates = materialize(often.join(sizes, "host").where(F.col("_n") >= enough).select("host", "mark"), "templates")
    hits = marked.select("page_key", "host", F.explode("marks").alias("mark")).join(checked_broadcast(templates), ["host", "mark"])
    return materialize(hits.groupBy("page_key").agg(F.collect_set("mark").alias("marks")), "hits")


def main_text(
    pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE
) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages (page_id, url, html)``."""
    chosen = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = chosen.withColumn("page_key", F.xxhash64("url", "html"))
    hits = template_subtrees(keyed, least_pages, least_share)
    if hits.isEmpty():
        joined = keyed.withColumn("marks", F.lit(None).cast("array<bigint>"))
    else:
        joined = keyed.join(checked_broadcast(hits), "page_key", "left")

    def start():
        def read(batch):
            marks = batch.column(3).to_pylist()
            texts = [Page(t).text(frozenset(m or ())) for t, m in zip(batch.column(2).to_pylist(), marks)]
            return batch.column(0), batch.column(1), texts, [len(t) for t in texts]

        return read

    rows = joined.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "marks")
    return map_batches(rows, "page_id bigint, url string, text string, n_chars bigint", start)
