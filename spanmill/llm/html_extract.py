"""Main text of web pages, with removal of each site's template.

A page is read once from left to right. What the page says of itself goes
first: elements that are never article text (menus, footers, forms, scripts)
and elements whose class, id or role names such a part. Then the site speaks:
every element's subtree is hashed, the hashes are counted for each host in
Spark, and subtrees that recur on many pages of a host are deleted as its
template. Pages count once for each content, and where what recurs is half of
a page's text or more, the page is a near copy of others and keeps it. What is
left inside the article, the main part or the body is text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import durable, small_batches

#: A subtree is template if at least this share of the host's distinct pages has it, and at least so many pages.
SHARE = 0.5
PAGES = 5
#: Up to so many template hashes are broadcast; more are joined by host.
BROADCAST_HASHES = 1_000_000

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "template", "svg", "object", "canvas", "audio", "video", "map", "fieldset", "input", *_RAW}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Parts of a class or id that name something other than the article.
_NAMES = {
    "nav", "navbar", "navigation", "menu", "submenu", "masthead", "topbar", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement",
    "advertisements", "advertising", "adsense", "adbox", "adslot", "adunit", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "pagination",
    "pager", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion", "widget", "toolbar",
    "search", "searchform", "copyright", "skip", "hidden", "teaser",
}
#: Words that stand beside such a name without telling what a part is about.
_PLAIN_NAMES = {
    "box", "boxes", "block", "list", "bar", "wrap", "wrapper", "container", "content", "section", "area", "panel", "row", "col", "item", "items", "card", "cards", "button", "buttons", "btn", "icon", "icons",
    "link", "links", "post", "posts", "article", "articles", "story", "stories", "page", "site", "main", "top", "bottom", "left", "right", "inline", "inner", "outer", "unit", "slot", "zone", "module", "form", "tools",
    "media", "network", "networks", "user", "users", "reader", "readers", "thread", "count", "meta", "info", "text", "title", "heading", "body", "group", "grid", "holder", "region", "primary", "secondary", "global",
    "google", "facebook", "twitter", "email", "mail", "js", "wp", "entry", "more", "also", "you", "may", "like", "the", "by", "up", "to", "for", "and", "us", "on", "in", "out", "id", "div", "ul", "li", "nav", "feed", "stream", "call", "cta", "offer",
}
#: Names that are as likely headings of an article's own parts.
_AMBIGUOUS = {"discussion", "header"}
_COMPOUND = re.compile("(?:" + "|".join(sorted(_NAMES, key=lambda w: (-len(w), w))) + "){2,}")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROOTS = {"html", "body", "main", "article"}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "figure", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "address", "fieldset", "details"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "section", "article", "main", "body", "td", "th", "blockquote", "details", "header", "nav", "aside", "footer"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<", re.S)
#: The same behind the last ``>``, where no tag ends.
_LAST = re.compile(r"(?:<!--.*\Z|[^<]+|<)()()()()()()", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(hidden)\b", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _names_apart(word: str) -> bool:
    """Whether one class or id names a part inside an article that isn't its text: all of its parts do, or stand beside one that does."""
    parts = [p.lower() for p in _NAME_PART.findall(word)]
    named = {p for p in parts if p in _NAMES or _COMPOUND.fullmatch(p)} - _AMBIGUOUS
    return bool(named) and all(p in named or p in _PLAIN_NAMES or p in _AMBIGUOUS for p in parts)


def _named_apart(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's attributes say that it is no article text."""
    if not attributes or attributes.isspace():
        return False
    for name, value, bare in _ATTR.findall(attributes):
        name, value = name.lower() or bare.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if in_article and tag not in _ROOTS:
                if not (name == "id" and tag in _HEADINGS) and any(map(_names_apart, value.split())):
                    return True
                continue
            if any(_COMPOUND.fullmatch(w) for w in value.lower().split()) and tag not in _ROOTS:
                return True
            parts = {p.lower() for p in _NAME_PART.findall(value)} & _NAMES
            if tag in _ROOTS:
                parts &= {"comment", "comments", "teaser", "related", "ad", "sponsored", "promo"} if tag == "article" else set()
            if parts:
                return True
        elif name == "role" and value.lower() in _ROLES and tag not in _ROOTS:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return tag not in ("html", "body")
    return False


class Page:
    """One reading of a page.

    ``pieces`` are texts, with None at the bounds of blocks; ``parts`` has
    ``(hash, first piece, end)`` for each element that may be template;
    ``headlines``, ``articles``, ``mains`` and ``body`` are ranges of pieces.
    """

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.parts: list[tuple[int, int, int]] = []
        self.headlines: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        stack: list[list] = []  # tag, first piece, digests of what it holds, silent, articles around it, has a headline
        self._stack, self._silent, self._depth = stack, 0, 0
        self._places: defaultdict[str, list[int]] = defaultdict(list)  # where open elements of a tag stand in the stack
        self._blocks: list[int] = []  # where those that aren't inline do
        at, end, pieces = 0, len(source), self.pieces
        lower, last = None, source.rfind(">")
        while at < end:
            m = (_TOKEN if at < last else _LAST).match(source, at)
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if source[m.start()] != "<" or at == m.start() + 1:
                    text = m[0]
                    if not self._silent:
                        text = html.unescape(text) if "&" in text else text
                        pieces.append(text)
                        if stack and not text.isspace():
                            stack[-1][2].append(text)
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            if tag in _RAW:
                lower = source.lower() if lower is None else lower
                if len(lower) != end:  # a letter whose lower case is longer
                    lower = re.sub(r"[A-Z]+", lambda x: x[0].lower(), source)
                stop = lower.find(f"</{tag}", at)
                at = end if stop < 0 else stop
                at = end if (close := source.find(">", at)) < 0 else close + 1
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    pieces.append(None)
                continue
            self._open(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "path"):
                self._close(tag)
        while stack:
            self._pop()
        self.body = (0, len(pieces))

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        closes = {"p"} if tag in _ENDS_P else _SIBLINGS.get(tag, ())
        if any(self._places[t] for t in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        self._pop()
                    if tag != "tr":
                        break
                elif stack[k][0] in _SCOPES:
                    break
        silent = tag in _NEVER or tag == "header" and not self._depth or _named_apart(tag, attributes, self._depth > 0)
        self._silent += silent
        self._depth += tag == "article"
        if tag not in _INLINE:
            self.pieces.append(None)
        self._places[tag].append(len(stack))
        if tag not in _INLINE:
            self._blocks.append(len(stack))
        stack.append([tag, len(self.pieces), [], silent, False])

    def _pop(self) -> None:
        tag, first, held, silent, headline = self._stack.pop()
        self._places[tag].pop()
        if tag not in _INLINE:
            self._blocks.pop()
        end = len(self.pieces)
        if tag not in _INLINE:
            self.pieces.append(None)
        self._silent -= silent
        self._depth -= tag == "article"
        headline = headline or tag == "h1"
        if not silent and not self._silent:
            if tag == "h1":
                self.headlines.append((first, end))
            if held:
                digest = hashlib.blake2b("\x1f".join([tag, *held]).encode("utf-8", "replace"), digest_size=8).hexdigest()
                if self._stack:
                    self._stack[-1][2].append(digest)
                if tag not in _ROOTS and tag not in _INLINE and not headline:
                    self.parts.append((int(digest, 16) - (1 << 63), first, end))
            if tag == "article" and not self._depth:
                self.articles.append((first, end))
            elif tag == "main":
                self.mains.append((first, end))
        if headline and self._stack:
            self._stack[-1][4] = True

    def _close(self, tag: str) -> None:
        places = self._places[tag]
        if places and not (tag in _INLINE and self._blocks and self._blocks[-1] > places[-1]):
            to = places[-1]
            while len(self._stack) > to:
                self._pop()

    def text(self, template=frozenset()) -> str:
        """The main text: blocks with single spaces, joined by a space, without the template's subtrees.

        Where these are as long as the rest of the text beside its headlines, they
        are what near copies of a page share, and stay.
        """
        gone = bytearray(len(self.pieces))
        for digest, first, end in reversed(self.parts):  # what holds others comes first
            if digest in template and first < end and not gone[first]:
                gone[first:end] = b"\1" * (end - first)
        for ranges in (self.articles, self.mains, [self.body]):
            out = self._words(ranges, gone if any(gone) and not self._is_copy(ranges, gone) else None)
            if out:
                return " ".join(out)
        return ""

    def _is_copy(self, ranges, gone: bytearray) -> bool:
        """Whether the marked pieces are half of the text beside the headlines, or more."""
        title = bytearray(len(gone))
        for first, end in self.headlines:
            title[first:end] = b"\1" * (end - first)
        sizes = [0, 0]
        for first, end in ranges:
            for k in range(first, end):
                if self.pieces[k] and not title[k]:
                    sizes[gone[k]] += len("".join(self.pieces[k].split()))
        return 0 < sizes[1] >= sizes[0]

    def _words(self, ranges, gone: bytearray | None) -> list[str]:
        out: list[str] = []
        for first, end in ranges:
            block: list[str] = []
            for k in range(first, end):
                piece = self.pieces[k]
                if piece is None:
                    out += "".join(block).split()
                    block = []
                elif not gone or not gone[k]:
                    block.append(piece)
            out += "".join(block).split()
        return out


def host(url_col: str = "url") -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def find_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """``(host, part)``: hashes of subtrees on at least ``share`` of a host's distinct pages, and on ``least`` of them."""

    def scan(batches):
        for batch in batches:
            hosts, contents, parts = [], [], []
            seen = set()
            for site, content, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (site, content) in seen:
                    continue
                seen.add((site, content))
                own = {p[0] for p in Page(source or "").parts}
                hosts += [site] * (len(own) + 1)
                contents += [content] * (len(own) + 1)
                parts += [None, *own]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, contents, parts)], ["host", "content", "part"])

    rows = pages.select(F.xxhash64(host(url_col)).alias("host"), F.xxhash64(html_col).alias("content"), F.col(html_col).alias("html"))
    found = rows.transform(small_batches).mapInArrow(scan, "host long, content long, part long")
    counts = durable(found.groupBy("host", "part").agg(F.count_distinct("content").alias("n")).where(F.col("part").isNull() | (F.col("n") >= least)), "parts")
    sites = counts.where("part is null").select("host", F.col("n").alias("pages"))
    return counts.where("part is not null").join(sites, "host").where(F.col("n") >= share * F.col("pages")).select("host", "part")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """``(id, url, text)`` for each row of ``pages``, from the whole html.

    Null or empty html, and pages without text of their own, give the empty
    text; a null or odd url counts as one host without a name; repeated rows
    get their text but count once for the template; other columns aren't read;
    an empty table gives an empty result. Headlines (and what holds them) are never deleted as template.
    """
    templates = durable(find_templates(pages, url_col, html_col, share, least), "templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host(url_col)).alias("host"))
    small = templates.count() <= BROADCAST_HASHES
    known: dict[int, frozenset] = {}
    if small:
        by: dict[int, set] = {}
        for r in templates.collect():
            by.setdefault(r["host"], set()).add(r["part"])
        known = {k: frozenset(v) for k, v in by.items()}
        rows = rows.withColumn("parts", F.lit(None).cast("array<bigint>"))
    else:
        lists = templates.groupBy("host").agg(F.collect_list("part").alias("parts"))
        rows = rows.join(lists, "host", "left").select("id", "url", "html", "host", "parts")
    sent = pages.sparkSession.sparkContext.broadcast(known)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = []
            for source, site, parts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                texts.append(Page(source or "").text(parts and frozenset(parts) or sent.value.get(site, frozenset())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, url string, text string")
