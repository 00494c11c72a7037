"""Blocks of a web page: text with the zone its markup puts it in.

A forgiving one-pass reader: tags that HTML closes by itself are closed,
unknown end tags are ignored, raw text elements are skipped as a whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter

MAIN, REST, CHROME = 0, 1, 2

_ATTRS = (r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'"""
          r"""|[^\s>"'][^\s>]*+)?+)?+|=)*+""")
_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRS
    + r")>", re.S)
_ATTR = re.compile(
    r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_OPEN_END = re.compile(r"<[a-zA-Z/!?]")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source "
                 "track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes "
                "xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details "
    "dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody "
    "template tfoot thead title tr ul".split())
# Containers that a new paragraph or item doesn't look beyond.
SCOPE = BLOCK - {"p", "li", "dt", "dd", "option"} | {"td", "th", "object",
                                                    "button"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
            "option": ("option",), "tr": ("td", "th", "tr"),
            "td": ("td", "th"), "th": ("td", "th")}
# Elements that are never part of the article.
DROP = frozenset(
    "head title script style noscript template nav aside footer form button "
    "select option textarea fieldset iframe object embed svg canvas audio "
    "video menu dialog map math search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog "
    "alertdialog alert menu menubar toolbar tablist".split())
# Words of class and id values by which sites mark such parts.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner "
    "breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus donate footer gdpr header hidden login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination paywall popup promo promoted promotion related reply "
    "replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola toolbar topbar widget "
    "widgets".split())
# Words that beside hints still name a part: share-buttons, related-posts.
PARTS = frozenset(
    "area bar block body box btn button buttons card cards container content "
    "feed field form group icon icons inner item items link links list panel "
    "post posts row section slot thread title unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# What the class of an article element may say to be no article.
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments reply "
                       "sponsored promo related teaser".split())
# Words that turn a hint into a statement about layout.
LAYOUT = frozenset("has with without no".split())


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def _named_parts(names: str) -> set[str]:
    """Hints among class tokens and ids that name nothing but page parts; a
    slug such as ``related-work`` isn't one."""
    out: set[str] = set()
    for token in names.split():
        words = set(_WORD.findall(token))
        if words & HINTS and words <= HINTS | PARTS:
            out |= words & HINTS
    return out


class Forms:
    """Which forms of a page hold an article, a main element or most of its
    text; found in one pass, when first asked."""

    def __init__(self, page: str):
        self.page, self.ends = page, None

    def _read(self) -> None:
        self.ends, self.bodies, self.at, self.sums = [], [], [0], [0]
        pos, total, size = 0, 0, len(self.page)
        while pos < size:
            m = _TAG.search(self.page, pos)
            stop = m.start() if m else size
            total += sum(map(len, self.page[pos:stop].split()))
            pos = m.end() if m else size
            self.at.append(pos)
            self.sums.append(total)
            name = m[2].lower() if m and m[2] else ""
            if name == "form" and m[1]:
                self.ends.append(pos)
            elif name and not m[1]:
                if name in RAW:
                    end = re.compile(rf"</{name}\s*>?", re.I).search(
                        self.page, pos)
                    pos = end.end() if end else size
                elif name in ("article", "main") or _attributes(m[3]).get(
                        "role", "").lower() in ("article", "main"):
                    self.bodies.append(pos)

    def contains(self, pos: int) -> bool:
        """Whether the form whose start tag ends at ``pos`` is a container."""
        if self.ends is None:
            self._read()
        k = bisect_left(self.ends, pos)
        end = self.ends[k] if k < len(self.ends) else len(self.page)
        k = bisect_left(self.bodies, pos)
        if k < len(self.bodies) and self.bodies[k] <= end:
            return True
        own = self.sums[bisect_right(self.at, end) - 1] - self.sums[
            bisect_right(self.at, pos) - 1]
        return 2 * own > self.sums[-1]


def _dropped(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element starts a part that isn't article text. A form that
    is a mere container comes under the name ``div``."""
    if name in DROP or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    style = attrs.get("style", "")
    if style and re.search(r"display\s*:\s*none", style, re.I):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    words = set(_WORD.findall(
        f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if name == "article":
        return bool(words & NO_ARTICLE)
    if in_article and name in HEADINGS:
        return False
    found = words & HINTS
    if found and (in_article or name in HEADINGS or name == "section"):
        found = _named_parts(
            f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    if in_article:
        found = found - {"header"}
    return bool(found) and not words & LAYOUT


def blocks(page: str | None) -> list[tuple[int, str]]:
    """``(zone, text)`` of every block with text, in page order.

    Zone ``MAIN`` is inside an article (or, in a page without article text,
    the main element), ``CHROME`` what the markup marks as something else,
    ``REST`` what it doesn't tell. Character references are decoded and white
    space is one space. Null is a page without blocks."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    kept: list[str] = []
    aside: list[str] = []
    # name, dropped, in article, in main
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    is_open: Counter = Counter()
    forms = Forms(page)
    pos, size = 0, len(page)

    def flush() -> None:
        for parts, drop in ((kept, False), (aside, True)):
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    top = stack[-1]
                    out.append((3 if drop else MAIN if top[2] else
                                4 if top[3] else REST, text))

    def add(text: str) -> None:
        (aside if stack[-1][1] else kept).append(text)

    def close(name: str) -> None:
        while True:
            gone = stack.pop()[0]
            is_open[gone] -= 1
            if gone == name:
                return
    while pos < size:
        m = _TAG.search(page, pos)
        if m is None:
            rest = page[pos:]
            cut = _OPEN_END.search(rest)
            add(rest[:cut.start()] if cut else rest)
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            elif name in ("td", "th"):
                add(" ")
            if is_open[name]:
                close(name)
            continue
        if name in BLOCK:
            flush()
        if name == "br" or name in ("td", "th", "img"):
            add(" ")
        if name in VOID:
            continue
        ends = ("p",) if name in BLOCK and name not in SIBLINGS else ()
        for other in (*ends, *SIBLINGS.get(name, ())):
            if is_open[other]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == other:
                        close(other)
                        break
                    if stack[k][0] in SCOPE and stack[k][0] != other:
                        break
        _, drop, article, main = stack[-1]
        attrs = _attributes(m[3]) if m[3].strip() else {}
        if not drop:
            kind = name
            if name == "form" and (is_open["form"] or forms.contains(pos)):
                kind = "div"
                if attrs.get("role", "").lower() == "form":
                    attrs.pop("role")
            drop = _dropped(kind, attrs, article)
        if not drop:
            role = attrs.get("role", "").lower()
            article = article or name == "article" or role == "article"
            main = main or name == "main" or role == "main"
        if name in RAW:
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        stack.append((name, drop, article, main))
        is_open[name] += 1
    flush()
    has_article = any(z == MAIN for z, _ in out)
    zone = {MAIN: MAIN, REST: REST, 3: CHROME,
            4: REST if has_article else MAIN}
    return [(zone[z], t) for z, t in out]
