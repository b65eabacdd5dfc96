"""Articles from web pages, checks of addresses, and routes with fallbacks.

HTML is read by the standard library's parser in Arrow batches, one page at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, language, text as T
from ..functions.spans import FLAG, TEXT, js, struct

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that an opening tag of the key closes when they are open.
CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEAD = {"title", "meta", "link", "base", "style", "script"}
_GAPS = js(r"\s+")


class Element:
    """A node of a page: tag, attributes, and children that are elements or texts."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(e.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.head, self.body = Element("head"), Element("body")
        self.root.children = [self.head, self.body]
        self.open = [self.body]

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body"):
            into = {"html": self.root, "head": self.head, "body": self.body}[tag]
            into.attrs = values | into.attrs
            if tag != "html":
                self.open = [into]
            return
        if self.open[0] is self.head and tag not in HEAD | {"noscript", "template"} and len(self.open) == 1:
            self.open = [self.body]
        if tag in BLOCKS and self.open[-1].tag == "p":
            self.open.pop()
        if tag in CLOSES and self.open[-1].tag in CLOSES[tag]:
            self.open.pop()
        e = Element(tag, values)
        (self.head if tag in HEAD and self.open == [self.body] and not self.body.children else self.open[-1]).children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "head":
            self.open = [self.body]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if len(self.open) == 1 and self.open[0] is self.head and data.strip():
            self.open = [self.body]
        self.open[-1].children.append(data)


def _no_content(e: Element) -> bool:
    return e.tag in fixed.NO_CONTENT_TAGS or e.attrs.get("role") in fixed.NO_CONTENT_ROLES or any(c in fixed.NO_CONTENT_CLASSES for c in e.classes())


def _strip(e: Element) -> None:
    stack = [e]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not _no_content(c)]
        stack.extend(x.elements())


def _at(e: Element, kind: str, value: str) -> bool:
    return {"tag": e.tag == value, "role": e.attrs.get("role") == value, "class": value in e.classes(), "id": e.attrs.get("id") == value}[kind]


def main_part(root: Element, body: Element, least: int = 250) -> Element:
    """Where the article is: a usual place with enough text, else the block with most paragraph text, else the body."""
    for kind, value in fixed.ARTICLE_PLACES:
        hit = next((e for e in root.walk() if _at(e, kind, value)), None)
        if hit is not None and len(hit.text().strip()) > least:
            return hit
    best, most = body, 0
    for e in root.walk():
        if e.tag in ("div", "section"):
            paras = [len(p.text().strip()) for p in e.walk() if p.tag == "p"]
            if len(paras) >= 3 and sum(paras) > most:
                best, most = e, sum(paras)
    return best


def to_markdown(root: Element) -> str:
    out: list[str] = []
    stack = root.elements()[::-1]
    while stack:
        e = stack.pop()
        if e.tag == "br":
            out.append("")
            continue
        known = e.tag in ("p", "li", "blockquote") or re.fullmatch("h[1-6]", e.tag)
        if not known and e.elements():
            stack.extend(e.elements()[::-1])
            continue
        text = _GAPS.sub(" ", e.text()).strip()
        if not text:
            continue
        if e.tag == "li":
            out.append("- " + text)
        elif e.tag == "blockquote":
            out.append("> " + text + "\n")
        elif known and e.tag != "p":
            out.append("\n" + "#" * int(e.tag[1]) + " " + text + "\n")
        elif e.tag in ("p", "span", "div"):
            out.append(text + "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def parse_html(html: str | None) -> tuple[str, str, str, str]:
    """Title, description, article as Markdown, declared language."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    _strip(b.root)
    metas = [e.attrs for e in b.root.walk() if e.tag == "meta"]

    def meta(key: str, value: str) -> str:
        return next((m.get("content", "").strip() for m in metas if m.get(key) == value), "")

    title = meta("property", "og:title") or next((e.text().strip() for e in b.root.walk() if e.tag == "title"), "")
    about = meta("name", "description") or meta("property", "og:description")
    return title, about, to_markdown(main_part(b.root, b.body)), b.root.attrs.get("lang", "")


article = F.udf(parse_html, struct(title=TEXT, description=TEXT, content=TEXT, html_lang=TEXT), useArrow=True)


def check_address(raw: str | None) -> tuple[bool, str | None, str | None]:
    """Accepted, address with a scheme, reason of a refusal.  Other schemes are refused before one is added."""
    text = (raw or "").strip()
    if not text:
        return False, None, "empty"
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", text, re.I)
    if scheme and scheme[1].lower() not in ("http", "https"):
        return False, None, "scheme"
    try:
        parts = urlsplit(text if scheme else "https://" + text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return False, None, "invalid"
    if not host or re.search(r"[\s%]", host) or ("." not in host and host != "localhost"):
        return False, None, "host"
    usual = {"http": 80, "https": 443}[parts.scheme.lower()]
    user = parts.netloc.rpartition("@")[0]
    href = f"{parts.scheme.lower()}://{user + '@' if user else ''}{host}{f':{port}' if port and port != usual else ''}{parts.path or '/'}"
    return True, href.replace(" ", "%20") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else ""), None


address = F.udf(check_address, struct(accepted=FLAG, href=TEXT, reason=TEXT), useArrow=True)


def accepted_address(c: Column) -> Column:
    """Whether an address is accepted, by built-in functions; for filters that should reach the scan's stage."""
    t = T.trim(F.coalesce(c, F.lit("")))
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), "^.*@", ""), ":[0-9]*$", "")
    fine = (host != "") & ~host.rlike(f"[{T.SPACE}%]") & (F.contains(host, F.lit(".")) | (F.lower(host) == "localhost"))
    return (t != "") & scheme.isin("", "http", "https") & fine


def proxied(c: Column) -> dict[str, Column]:
    """Title, time and content of a reply with a small header block before its Markdown."""
    line = lambda name: T.trim(F.regexp_extract(c, rf"(?m)^{name}:{T.WS}*(.+)$", 1))
    parts = F.split(c, rf"(?m)^Markdown Content:{T.WS}*$")
    content = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "Markdown Content:")).otherwise(c)
    return {"title": line("Title"), "published": line("Published Time"), "content": T.trim(content)}


#: Shortest body that a route may return, and shortest article.
LEAST_BODY = {"direct": 200, "proxy": 100, "mirror": 200}
LEAST_ARTICLE = 120


def first_route(candidates: DataFrame) -> DataFrame:
    """For each page_id, the first route with an article, words, and how many routes were tried before.

    candidates: page_id, route (a key of LEAST_BODY), body, content.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(LEAST_BODY) for x in (r, i)])
    least = F.create_map(*[F.lit(x) for r, n in LEAST_BODY.items() for x in (r, n)])
    rows = candidates.withColumn("_at", order[F.col("route")])
    fine = (F.length("body") >= least[F.col("route")]) & (F.length("content") >= LEAST_ARTICLE)
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    place = Window.partitionBy("page_id").orderBy("_at")
    rows = rows.withColumn("attempts", F.row_number().over(place) - 1).where("_fine")
    best = rows.groupBy("page_id").agg(F.min_by(F.struct("route", "content", "attempts"), "_at").alias("b")).select("page_id", "b.*")
    return best.withColumn("words", T.word_count(F.col("content")))


def articles(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages as articles with declared and found language; a found one wins, a disagreement is shown."""
    rows = pages.select("page_id", "url", article("html").alias("a")).select("page_id", "url", "a.*")
    rows = language.detect(rows.withColumn("_prose", language.strip_noise(F.col("content"))), "_prose").drop("_prose")
    declared = language.declared_language(F.col("html_lang"))
    rows = rows.withColumns({"declared": declared, "words": T.word_count(F.col("content"))})
    return rows.withColumn("disagrees", (F.col("declared") != "") & (F.col("declared") != F.col("language")))
