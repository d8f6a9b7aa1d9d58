"""Readable text of a page: the part of its tree that scores like prose."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "byline string, dir string, lang string, text string, length int, excerpt string, status string"

#: Class and id patterns, roles, tags and weights of the scoring.
UNLIKELY = re.compile(
    "-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss"
    "|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote",
    re.I,
)
MAYBE = re.compile("and|article|body|column|content|main|mathjax|shadow", re.I)
POSITIVE = re.compile("article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    "-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share"
    "|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget",
    re.I,
)
BYLINE = re.compile("byline|author|dateline|writtenby|p-author", re.I)
COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")
ROLES = {"menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"}
SCORED = {"section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"}
BLOCKS = {"blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul"}
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = {"script", "style", "noscript", "template"}
#: An open tag of the left kind ends when one of the right comes.
CLOSES = {"p": BLOCKS | {"h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "header", "nav", "form"}, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}

#: Elements that stand inside a line of text; and those that do if all of their children do.
PHRASING = frozenset(
    """abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript object
    output progress q ruby samp script select small span strong sub sup textarea time var wbr""".split()
) | {"a", "del", "ins"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "score")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.score: float | None = None

    def walk(self) -> Iterator[Node]:
        """This node and those below it in the order of the page; nesting may be of any depth."""
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_ += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def raw(self) -> str:
        out, open_ = [], self.kids[::-1]
        while open_:
            k = open_.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                open_ += reversed(k.kids)
        return "".join(out)

    def text(self) -> str:
        return re.sub(r"\s{2,}", " ", self.raw().strip())

    def ancestors(self) -> list[Node]:
        out, at = [], self.up
        while at is not None and at.tag != "#":
            out.append(at)
            at = at.up
        return out

    def link_density(self) -> float:
        size = len(self.text())
        links = sum(len(a.text()) * (0.3 if len(a.attrs.get("href", "")) > 1 and a.attrs["href"][0] == "#" else 1.0) for a in self.walk() if a.tag == "a")
        return links / size if size else 0.0

    def drop(self) -> None:
        self.up.kids.remove(self)

    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in CLOSES.get(self.at.tag, ()):
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.up is not None and at.tag != tag:
            at = at.up
        if at.up is not None:
            self.at = at.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def _similar(a: str, b: str) -> float:
    left, right = (re.findall(r"[A-Za-z0-9_]+", x.lower()) for x in (a, b))
    if not left or not right:
        return 0.0
    return 1 - len(" ".join(t for t in right if t not in left)) / len(" ".join(right))


def _visible(n: Node) -> bool:
    style = re.sub(r"\s", "", n.attrs.get("style", "").lower())
    dialog = n.attrs.get("aria-modal") == "true" and n.attrs.get("role") == "dialog"
    hidden = n.attrs.get("aria-hidden") == "true" and "fallback-image" not in n.attrs.get("class", "")
    return not ("display:none" in style or "visibility:hidden" in style or "hidden" in n.attrs or hidden or dialog)


class _Attempt:
    """One pass over a fresh tree, with or without the sieves."""

    def __init__(self, html: str, title: str, strip: bool, weigh: bool):
        builder = _Builder()
        builder.feed(html)
        builder.close()
        self.root, self.title, self.strip, self.weigh = builder.root, title, strip, weigh
        self.byline = self.dir = None
        html_node = next((n for n in self.root.walk() if n.tag == "html"), None)
        self.lang = html_node.attrs.get("lang") if html_node else None
        self.body = next((n for n in self.root.walk() if n.tag == "body"), self.root)
        self.header_left = True
        self.to_score: list[Node] = []

    def prepare(self, node: Node) -> None:
        open_ = [k for k in reversed(node.kids) if isinstance(k, Node)]
        while open_:
            kid = open_.pop()
            if kid.tag in SKIPPED or self.goes(kid):
                kid.drop()
                continue
            if kid.tag in SCORED:
                self.to_score.append(kid)
            if kid.tag == "div":
                self.wrap_phrases(kid)
            open_ += [k for k in reversed(kid.kids) if isinstance(k, Node)]

    def goes(self, n: Node) -> bool:
        if not _visible(n):
            return True
        names = n.names()
        if self.byline is None and (n.attrs.get("rel") == "author" or "author" in n.attrs.get("itemprop", "") or BYLINE.search(names)):
            own = next((k for k in n.walk() if k is not n and "name" in k.attrs.get("itemprop", "")), n)
            if 0 < len(n.raw().strip()) < 100:
                self.byline = own.raw().strip()
                return True
        if self.header_left and n.tag in ("h1", "h2") and _similar(self.title, n.raw().strip()) > 0.75:
            self.header_left = False
            return True
        if self.strip and n.tag not in ("body", "a"):
            inside = any(a.tag in ("table", "code") for a in n.ancestors())
            if UNLIKELY.search(names) and not MAYBE.search(names) and not inside:
                return True
            if n.attrs.get("role") in ROLES:
                return True
        empty = n.tag in ("div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6") and not n.raw().strip()
        return empty and all(k.tag in ("br", "hr") for k in n.walk() if k is not n)

    def wrap_phrases(self, div: Node) -> None:
        """Runs of text and inline tags become paragraphs; a div without blocks is a paragraph itself."""
        if not any(k.tag in BLOCKS for k in div.walk() if k is not div):
            div.tag = "p"
            self.to_score.append(div)
            return
        out: list[Node | str] = []
        run: Node | None = None
        for k in div.kids:
            inline = isinstance(k, str) or (k.tag in PHRASING and not any(x.tag in BLOCKS - {"img"} for x in k.walk()))
            if inline and (run is not None or not isinstance(k, str) or k.strip()):
                if run is None:
                    run = Node("p", {}, div)
                    out.append(run)
                run.kids.append(k)
                if isinstance(k, Node):
                    k.up = run
            else:
                run = None
                out.append(k)
        div.kids = out

    def weight(self, n: Node) -> float:
        if not self.weigh:
            return 0
        parts = [x for x in (n.attrs.get("class", ""), n.attrs.get("id", "")) if x]
        return sum(25 * bool(POSITIVE.search(x)) - 25 * bool(NEGATIVE.search(x)) for x in parts)

    def start_score(self, n: Node) -> None:
        if n.score is None:
            n.score = BASE.get(n.tag, 0) + self.weight(n)

    def content(self) -> list[Node]:
        self.prepare(self.root)
        candidates: dict[int, Node] = {}
        for n in self.to_score:
            text = n.text()
            if len(text) < 25:
                continue
            points = 1 + len(COMMAS.findall(text)) + 1 + min(len(text) // 100, 3)
            for level, a in enumerate(n.ancestors()[:5]):
                if a.tag == "html":
                    continue
                self.start_score(a)
                candidates[id(a)] = a
                a.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
        for c in candidates.values():
            c.score *= 1 - c.link_density()
        best = sorted(candidates.values(), key=lambda c: -c.score)[:5]
        if not best or best[0].tag == "body":
            return [self.body]
        top = self.promote(best)
        return self.with_siblings(top)

    def promote(self, best: list[Node]) -> Node:
        top = best[0]
        close = [c.ancestors() for c in best[1:] if c.score >= 0.75 * top.score]
        if len(close) >= 3:
            shared = next((a for a in top.ancestors() if a.tag != "body" and sum(any(x is a for x in path) for path in close) >= 3), None)
            top = shared or top
        self.start_score(top)
        last, floor = top.score, top.score / 3
        for up in top.ancestors():
            if up.tag == "body":
                break
            if up.score is None:
                continue
            if up.score < floor:
                break
            if up.score > last:
                top = up
                break
            last = up.score
        while top.up is not None and top.up.tag not in ("body", "#") and len([k for k in top.up.kids if isinstance(k, Node)]) == 1:
            top = top.up
        self.start_score(top)
        return top

    def with_siblings(self, top: Node) -> list[Node]:
        least = max(10, 0.2 * top.score)
        self.dir = next((a.attrs["dir"] for a in [top.up, top, *top.ancestors()] if a is not None and a.attrs.get("dir")), None)
        out = []
        for s in [k for k in top.up.kids if isinstance(k, Node)]:
            bonus = 0.2 * top.score if s.attrs.get("class") and s.attrs.get("class") == top.attrs.get("class") else 0
            if s is top or (s.score is not None and s.score + bonus >= least) or (s.tag == "p" and self.stands_alone(s)):
                out.append(s)
        return out

    @staticmethod
    def stands_alone(p: Node) -> bool:
        text, density = p.text(), p.link_density()
        return len(text) > 80 and density < 0.25 or 0 < len(text) < 80 and density == 0 and re.search(r"\.( |$)", text) is not None


def readable(html: str | None, title: str = "", least: int = 500) -> dict:
    """Byline, dir, lang, text, length and first paragraph of the article; fewer sieves until `least` characters are found."""
    tries = []
    for strip, weigh in ((True, True), (False, True), (False, False)):
        attempt = _Attempt(html or "", title or "", strip, weigh)
        nodes = attempt.content()
        text = re.sub(r"[ \t]*\n\s*", "\n", "\n".join(n.raw().strip() for n in nodes)).strip()
        first = next((p.raw().strip() for n in nodes for p in n.walk() if p.tag == "p" and p.raw().strip()), None)
        tries.append((len(re.sub(r"\s{2,}", " ", text)), text, first, attempt))
        if tries[-1][0] >= least:
            break
    size, text, first, attempt = tries[-1] if tries[-1][0] >= least else max(tries, key=lambda t: t[0])
    return {"byline": attempt.byline, "dir": attempt.dir, "lang": attempt.lang, "text": text or None, "length": size, "excerpt": first, "status": "ok" if size >= least else "too_short" if size else "no_article"}


def extract_article(pages: DataFrame, page: str = "page_id", title: str | None = None) -> DataFrame:
    """(page, byline, dir, lang, text, length, excerpt, status), one row a page. A page that cannot be parsed has the
    status failed; it never fails its task."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html, head in zip(batch["page"], batch["html"], batch["title"], strict=True):
                try:
                    rows.append({"page": key} | readable(html, head))
                except (ValueError, AssertionError):
                    rows.append({"page": key, "length": 0, "status": "failed"})
            out = pd.DataFrame(rows, columns=["page", *names]).rename(columns={"page": page})
            yield out.astype(object).where(out.notna(), None).astype({"length": "int32"})

    head = F.col(title) if title else F.lit("")
    kind = pages.schema[page].dataType.simpleString()
    source = pages.select(F.col(page).alias("page"), "html", head.alias("title"))
    return source.mapInPandas(run, f"{page} {kind}, {SCHEMA}")
