"""Main text of web pages by equivalence-class template deduction.

A token is an element's path of container tags with their classes and ids (digits masked). For every host, one aggregation
yields each token's occurrence vector over the pages as a fingerprint: how many
pages hold it, how often, and two sums of page hashes times counts. Tokens of a host with equal vectors form an
equivalence class; a class is valid if its tokens stand once on each of their pages, and on at least SUPPORT of the
host's pages and MIN_PAGES. Valid classes, ordered by support and position, nest into the template: a class lies in the
class of the nearest token that holds its first one, so the class of all pages is the frame and smaller ones are optional
parts within it. The template's slots are its tokens' own texts. A slot whose text never changes, in a class that has or
lies in one with a changing slot, is template text, inside articles too; if nothing around it changes, the pages are
copies and it stays. All else is data: changing slots, and repeated or rare elements between template tokens, whatever
their share. Of a page's data, tags, roles, attributes and names only tell chrome (navigation, notices, adverts, forms,
comments, hidden parts) from the rest. Outside of article and main elements any chrome word in a class name or id counts;
inside, only names that say nothing else do (`comments-area`, not `related-work`), and paragraphs, headings and list items
are told by these too. Where article or main elements hold half of what is left or more, what is around them goes.

Vectors are aggregated as sums, so a host with any share of all pages is never gathered in one task; what is kept per
host is bounded by the tokens of a few pages (1/SUPPORT times a page's). A host of fewer than MIN_PAGES pages shows no template.

Defined results: a null or empty html, or a page of chrome alone, gives an empty text; a page that has nothing but
template text keeps it; a null or odd url counts as host ''; repeated rows are extracted each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import chunks, stored

SUPPORT = 0.2
MIN_PAGES = 3
#: Up to so many hosts' templates are broadcast; beyond it they are joined by a shuffle, whose skew Spark splits.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
CONTAINERS = {"html", "head", "body", "header", "footer", "nav", "aside", "main", "article", "section", "div", "form", "table", "ul", "ol", "dl", "menu", "dialog", "fieldset", "details", "figure", "button", "select"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "nobr", "center", "link", "meta", "base"}
CHROME_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
CHROME_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "toast", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "aside", "related", "recommended", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "widget", "copyright", "search", "form",
}
MAIN_TAGS = {"article", "main"}
#: Words that say where or what kind of box an element is; beside these, a chrome word is all that a name says.
BOX_WORDS = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "entry", "group", "heading", "holder", "icon", "icons", "inner", "item", "items",
    "left", "link", "links", "list", "main", "module", "outer", "page", "panel", "post", "posts", "reader", "readers", "region", "right", "row", "section", "side", "site", "slot", "story", "strip", "thread",
    "threads", "title", "top", "unit", "user", "users", "wrap", "wrapper",
}
#: Chrome words that are also names of an article's own sections.
OWN_SECTIONS = {"discussion"}
#: Inline elements of these names are adverts.
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored"}
#: What ends an element whose end tag may be left out: the start of one of these, or of any block.
ENDED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def attributes_of(text: str) -> dict[str, str]:
    """A tag's attributes; the first of a name counts, and nothing within a value is one."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def named_chrome(names: list[str]) -> bool:
    """Whether a class name or id says chrome and nothing else: `comments-area`, but not `related-work` or `no-sidebar`."""
    for name in names:
        words = [w.lower() for w in _PART.findall(name)]
        if any(w in CHROME_WORDS and w not in OWN_SECTIONS for w in words) and all(w in CHROME_WORDS or w in BOX_WORDS for w in words):
            return True
    return False


class Node:
    """An element. What a tag or role says of it holds for all below; what a class word says may be withdrawn by the page."""

    __slots__ = ("tag", "path", "parent", "own_main", "main", "strong", "weak", "loose")

    def __init__(self, tag: str, attrs: str, parent: Node | None, loose: bool = False):
        found = attributes_of(attrs) if attrs else {}
        named = f"{found.get('class', '')} {found.get('id', '')}".split()
        role = found.get("role", "").lower()
        inside = bool(parent and parent.main)
        self.tag, self.parent, self.loose = tag, parent, loose
        own = tag + "".join("." + re.sub(r"\d+", "9", n) for n in sorted(named))
        self.path = f"{parent.path}>{own}" if parent else own
        self.own_main = tag in MAIN_TAGS or role in ("main", "article")
        self.main = inside or self.own_main
        self.strong = bool((parent and parent.strong) or tag in CHROME_TAGS or role in CHROME_ROLES or (tag == "header" and not inside) or hidden(found))
        if inside or self.own_main or loose:
            self.weak = named_chrome(named)
        else:
            words = {w.lower() for n in named for w in _PART.findall(n)}
            self.weak = bool(words & CHROME_WORDS or "header" in words) and tag not in ("html", "body")

    def above(self) -> Iterator[Node]:
        """The element and those that hold it, innermost first."""
        node: Node | None = self
        while node:
            yield node
            node = node.parent

    @property
    def chrome(self) -> bool:
        return self.strong or any(n.weak for n in self.above())


def _withdraw(blocks: list[tuple[Node, str]]) -> None:
    """Take class words back from elements that hold the page's main text.

    A page with text in an article or main element outside chrome keeps its marks. Else marks go from what holds such an
    element, or, if that leaves none either, from what holds half of the text or more.
    """
    said = [(node, len(block)) for node, block in blocks if block and not node.strong]
    if not any(n.weak for node, _ in said for n in node.above()):
        return

    def left() -> bool:
        return any(node.main and not node.chrome for node, _ in said)

    if left():
        return
    for node, _ in said:
        if node.main:
            for n in node.above():
                if not n.main:
                    n.weak = False
    inside = [(node, size) for node, size in said if node.main]
    if inside and left():
        return
    held: dict[int, int] = {}
    for node, size in inside or said:
        for n in node.above():
            held[id(n)] = held.get(id(n), 0) + size
    half = sum(size for _, size in inside or said) / 2
    for node, _ in inside or said:
        for n in node.above():
            if held[id(n)] >= half:
                n.weak = False


def _past(html: str, at: int, tag: str) -> int:
    """Where the end tag of an element that began before starts, elements of its kind within it passed over."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start()
    return len(html)


def parse(html: str) -> list[tuple[Node, str]]:
    """The page's blocks in order: the innermost container and the block's text."""
    root = Node("", "", None)
    stack, blocks, text = [root], [], []

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            blocks.append((stack[-1], block))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            text.append(unescape(m["text"]))
            continue
        if m["cdata"] is not None:
            text.append(m["cdata"])
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), (m["attrs"] or "").strip()
        if tag in RAW:
            if tag != "noscript":
                flush()
            if tag == "svg" and attrs.endswith("/"):
                continue
            if not m["end"]:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if not close and tag == "svg":
                    continue
                if not close:
                    break
                at = html.find(">", close.start())
                at = n if at < 0 else at + 1
            continue
        if tag in INLINE:
            if attrs and not m["end"] and tag not in VOID and not attrs.endswith("/"):
                found = attributes_of(attrs)
                if hidden(found) or any(x.lower() in ADVERTS for x in f"{found.get('class', '')} {found.get('id', '')}".split()):
                    at = _past(html, at, tag)
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in CONTAINERS and not stack[k].loose:
                    break
            continue
        while stack[-1].loose and stack[-1].tag in ENDED_BY and tag in (ENDED_BY[stack[-1].tag] or {tag}):
            stack.pop()
        if stack[-1].loose and stack[-1].tag == "p":
            stack.pop()  # any block ends a paragraph
        if attrs.endswith("/"):
            continue
        if tag in CONTAINERS:
            stack.append(Node(tag, attrs, stack[-1]))
            blocks.append((stack[-1], ""))  # an element counts even without text
        elif attrs:
            node = Node(tag, attrs, stack[-1], loose=True)
            if node.weak or node.strong and not stack[-1].strong:
                stack.append(node)
    flush()
    _withdraw(blocks)
    return blocks


STATS = "host string, token string, kind int, pages long, times long, f1 long, f2 long, chars long, least long, most long"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            found: dict[tuple[str, str], list[int]] = {}
            for url, html, page in zip(*(part.column(c).to_pylist() for c in ("url", "html", "page_id")), strict=True):
                own: dict[str, list] = {"": [1, 0, []]}
                kinds = {"": 0}
                for node, block in parse(html or ""):
                    row = own.setdefault(node.path, [0, 0, []])
                    kinds[node.path] = 0 if node.chrome else 2 if node.own_main else 1
                    if block:
                        row[1] += len(block)
                        row[2].append(block)
                    else:
                        row[0] += 1
                key = f"{page} {url}".encode()
                h1, h2 = zlib.crc32(key), zlib.adler32(key[::-1]) ^ zlib.crc32(key, 7)
                host = host_of(url)
                for token, (times, chars, said) in own.items():
                    text = zlib.crc32("\n".join(said).encode())
                    row = found.setdefault((host, token), [kinds[token], 0, 0, 0, 0, 0, text, text])
                    row[1] += 1
                    row[2] += times
                    row[3] += h1 * times
                    row[4] += h2 * times
                    row[5] += chars
                    row[6] = min(row[6], text)
                    row[7] = max(row[7], text)
            cols = [[k for k, _ in found], [t for _, t in found], *map(list, zip(*found.values(), strict=True))] if found else [[] for _ in range(10)]
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in STATS.split(", ")])


def _template_text(classes: list[dict]) -> list[str]:
    """From a host's valid classes (pages, and tokens with kind, chars, and whether the text varies): the tokens of template text."""
    ordered = sorted(classes, key=lambda c: (-c["pages"], min((t["token"].count(">"), t["token"]) for t in c["tokens"])))
    home = {t["token"]: k for k, c in enumerate(ordered) for t in c["tokens"]}
    changing: list[bool] = []
    out = []
    for k, c in enumerate(ordered):
        path = min((t["token"] for t in c["tokens"]), key=lambda x: (x.count(">"), x))
        while path and home.get(path, k) >= k:  # the class that this one lies in has more support or comes before
            path = path.rpartition(">")[0]
        changing.append(any(t["varies"] and t["kind"] for t in c["tokens"]) or bool(path) and changing[home[path]])
        if changing[k]:
            out += [t["token"] for t in c["tokens"] if t["chars"] and not t["varies"] and t["kind"] != 2]
    return sorted(out)


def _template_texts(classes: pd.Series) -> pd.Series:
    return classes.map(_template_text)


def templates(pages: DataFrame) -> DataFrame:
    """host and the tokens of its template text."""
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "f1", "f2", "chars")]
    stats = pages.select("page_id", "url", "html").mapInArrow(_statistics, STATS)
    tokens = stored(stats.groupBy("host", "token").agg(F.max("kind").alias("kind"), *sums, F.min("least").alias("least"), F.max("most").alias("most")), "html-tokens")
    total = tokens.where("token = ''").select("host", F.col("pages").alias("all_pages"))
    own = tokens.where("token <> ''").join(total, "host")
    # A class: tokens of equal occurrence vectors. Valid: once on each of its pages, on SUPPORT of the host's pages and MIN_PAGES.
    vector = ["host", "pages", "times", "f1", "f2"]
    valid = own.where((F.col("pages") >= F.greatest(F.lit(MIN_PAGES), SUPPORT * F.col("all_pages"))) & (F.col("times") == F.col("pages")))
    token = F.struct("token", "kind", "chars", (F.col("least") != F.col("most")).alias("varies"))
    classes = valid.groupBy(*vector).agg(F.collect_list(token).alias("tokens"))
    template = classes.groupBy("host").agg(F.collect_list(F.struct("pages", "tokens")).alias("classes"))
    return template.select("host", F.pandas_udf(_template_texts, "array<string>")("classes").alias("template"))


def extract(html: str | None, template: set[str]) -> str:
    """The page's blocks but chrome and template text: those of its article or main elements if most of it stands there, or else all."""
    blocks = [(node, block) for node, block in parse(html or "") if block and not node.chrome]
    scope = [(node, block) for node, block in blocks if node.main]
    if 2 * sum(len(block) for _, block in scope) < sum(len(block) for _, block in blocks):
        scope = blocks
    return "\n".join([block for node, block in scope if node.path not in template] or [block for _, block in scope])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = stored(templates(pages), "html-templates").withColumnRenamed("host", "_host")
    own = F.broadcast(own) if own.count() <= BROADCAST_HOSTS else own
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = pages.join(own, host == F.col("_host"), "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                slots = part.column("template").to_pylist()
                out = [extract(h, set(m or ())) for h, m in zip(part.column("html").to_pylist(), slots, strict=True)]
                cols = [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
