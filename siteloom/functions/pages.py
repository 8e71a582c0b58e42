"""What is read out of a page's HTML: native expressions where a pattern does, one DOM pass in Python where it does not."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that JavaScript counts as white space, for Java's and Python's patterns.
JS_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
TITLE_BYTES = 16_384
#: Where a page's main content is looked for.
MAIN_SELECTORS = (
    "main", '[role="main"]', "#main", ".main", "#content", ".content", "#contents", ".contents",
    "#main-content", ".main-content", "#main_content", ".main_content", "#mainContent", ".mainContent",
)
#: Attributes that a keyword search leaves out.
UNSEARCHED = ("href", "src", "srcset", "id", "class", "style", "d")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def title(html: Column) -> Column:
    """The first title element's trimmed content, from the page's first TITLE_BYTES bytes of UTF-8 alone."""
    beginning = F.substring(html.cast("binary"), 1, TITLE_BYTES).cast("string")
    return F.trim(F.regexp_extract(beginning, r"(?is)<title[^>]*>(.*?)</title>", 1))


def lang(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html[^>]*\slang\s*=\s*["']?([^"'\s>]*)""", 1)


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, source: str = ""):
        self.tag, self.attrs, self.parent, self.source, self.children = tag, attrs, parent, source, []

    def nodes(self):
        """Elements and texts below, in document order, however deep."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            yield c
            if isinstance(c, Element):
                todo += reversed(c.children)

    def walk(self):
        return (c for c in self.nodes() if isinstance(c, Element))

    def text(self) -> str:
        return "".join(c for c in self.nodes() if isinstance(c, str))


class _Builder(HTMLParser):
    """Steps are constant on average: a page of deeply nested or unclosed elements costs no more than its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None)
        self.at = self.root
        self.open: Counter[str] = Counter()
        self.near = [{"p": None, "li": None}]  # for each open element, the p and the li that a start tag in it would close

    def _close(self, node: Element) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.near.pop()
            self.at = self.at.parent

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close(node)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P or tag == "li":
            same = self.near[-1]["li" if tag == "li" else "p"]
            if same is not None:
                self._close(same)
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.get_starttag_text() or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1
            if tag in ("td", "th", "table", "ul", "ol"):
                self.near.append({"p": None, "li": None})
            else:
                self.near.append(self.near[-1] | {tag: node} if tag in ("p", "li") else self.near[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(tag)

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.at.children.append(data)


def dom(source: str | None) -> Element:
    b = _Builder()
    b.feed(source or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


def selector(text: str):
    """A test of an element, for lists of compound selectors with descendant and child combinators; ValueError if it is none."""
    choices = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps = re.findall(r"\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[]+)+", one.strip())
        chain, join = [], " "
        for s in steps:
            if not s.strip(" \t\n>"):
                join = ">" if ">" in s else " "
                continue
            at, tests = 0, []
            while at < len(s):
                m = _SIMPLE.match(s, at)
                if not m:
                    raise ValueError(text)
                tests.append(m.groups())
                at = m.end()
            chain.append((join, tests))
            join = " "
        if not chain:
            raise ValueError(text)
        choices.append(chain)

    def one_test(e: Element, t) -> bool:
        tag, ident, cls, attr, op, *values = t
        if tag:
            return tag == "*" or e.tag == tag.lower()
        if ident:
            return e.attrs.get("id") == ident
        if cls:
            return cls in e.attrs.get("class", "").split()
        have, want = e.attrs.get(attr.lower()), next((v for v in values if v is not None), None)
        if have is None or op is None:
            return have is not None
        return {"=": have == want, "~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have, "|=": have == want or have.startswith(want + "-")}[op]

    def fits(e: Element, chain) -> bool:
        join, tests = chain[-1]
        if not all(one_test(e, t) for t in tests):
            return False
        if len(chain) == 1:
            return True
        up = e.parent
        while up is not None and up.tag != "#document":
            if fits(up, chain[:-1]):
                return True
            if join == ">":
                return False
            up = up.parent
        return False

    return lambda e: any(fits(e, c) for c in choices)


def first(root: Element, text: str) -> Element | None:
    """The first match in document order, whatever the order of the list."""
    test = selector(text)
    return next((e for e in root.walk() if test(e)), None)


META_FIELDS = (
    "title", "lang", "description", "keywords", "noindex", "nofollow", "noarchive", "canonical", "alternate",
    "og_type", "og_title", "og_site_name", "og_description", "og_url", "og_image", "twitter_card",
)


def meta(root: Element) -> dict:
    """Sixteen fields; a missing text is '', a missing robots word false."""
    out: dict = dict.fromkeys(META_FIELDS, "")
    names: dict[str, str] = {}
    for e in root.walk():
        if e.tag == "html":
            out["lang"] = out["lang"] or e.attrs.get("lang", "")
        elif e.tag == "title" and not out["title"]:
            out["title"] = e.text().strip()
        elif e.tag == "meta":
            names.setdefault((e.attrs.get("name") or e.attrs.get("property") or "").lower(), e.attrs.get("content", ""))
        elif e.tag == "link" and e.attrs.get("rel", "").lower() in ("canonical", "alternate"):
            out[e.attrs["rel"].lower()] = out[e.attrs["rel"].lower()] or e.attrs.get("href", "")
    for f in ("description", "keywords"):
        out[f] = names.get(f, "")
    for f in META_FIELDS[9:15]:
        out[f] = names.get(f.replace("og_", "og:"), "")
    out["twitter_card"] = names.get("twitter:card", "")
    words = {w.strip().lower() for w in names.get("robots", "").split(",")}
    return out | {f: f in words for f in ("noindex", "nofollow", "noarchive")}


def images(root: Element, url: str | None = None) -> list[dict]:
    """Every img; src against the page's address, an empty one as it is."""
    number = lambda v: float(v) if re.fullmatch(r"\d+(\.\d+)?", v or "") else 0.0
    return [
        {"src": resolved(url, e.attrs["src"]) if e.attrs.get("src") else "", "currentSrc": "", "alt": e.attrs.get("alt", ""), "width": number(e.attrs.get("width")), "height": number(e.attrs.get("height")), "isLazy": e.attrs.get("loading") == "lazy", "sourceCode": e.source}
        for e in root.walk() if e.tag == "img"
    ]


def links(root: Element) -> list[tuple[str, str]]:
    """href and text of every a and area with a href, in document order; text belongs to the nearest link around it."""
    out: list[tuple[str, list[str]]] = []
    todo: list = [(root, None)]
    while todo:
        e, link = todo.pop()
        if isinstance(e, str):
            if link:
                link[1].append(e)
        elif e.tag not in ("script", "style"):
            if e.tag in ("a", "area") and "href" in e.attrs:
                link = (e.attrs["href"], [])
                out.append(link)
            todo += [(c, link) for c in reversed(e.children)]
    return [(href, "".join(text)) for href, text in out]


def resolved(url: str | None, href: str) -> str:
    """href against the page's address; as it stands if it is no address."""
    try:
        return urljoin(url or "", href.strip())
    except ValueError:
        return href


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, pos, href (resolved against the page) and text of every link, from the DOM."""

    def run(batches):
        for batch in batches:
            out = []
            for i, url, source in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                out += [(i, pos, resolved(url, href), text) for pos, (href, text) in enumerate(links(dom(source)))]
            yield pd.DataFrame(out, columns=["page_id", "pos", "href", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, pos int, href string, text string")


def remove_spaces(text: str | None) -> str | None:
    return re.sub(JS_SPACE, "", text or "") or None


def main_contents(root: Element, extra: str | None = None) -> dict | None:
    """Counts of the main content, None without one. The text's length is in UTF-16 units, without white space."""
    main = first(root, ",".join(([extra] if extra else []) + list(MAIN_SELECTORS)))
    if main is None:
        return None
    inside = list(main.walk())
    count = lambda e, *tags: sum(x.tag in tags for x in e.walk())
    tables = []
    for t in (e for e in inside if e.tag == "table"):
        row = next((x for x in t.walk() if x.tag == "tr"), None)
        merged = any("colspan" in x.attrs or "rowspan" in x.attrs for x in t.walk())
        mark = lambda b: "o" if b else "x"
        tables.append(f"|{count(t, 'tr'):>3}| {count(row, 'th', 'td') if row else 0:>3} | {mark(count(t, 'thead'))} | {mark(count(t, 'tfoot'))} | {mark(merged)} |")
    return {
        "wordCount": len((remove_spaces(main.text()) or "").encode("utf-16-le")) // 2,
        "headings": sum(bool(re.fullmatch("h[1-6]", e.tag)) for e in inside),
        "images": sum(e.tag == "img" or e.tag == "input" and e.attrs.get("type") == "image" for e in inside),
        "table": len(tables),
        "note": "\n".join(["| r | c | h | f | m |", *tables]),
    }


def keyword_count(root: Element, pattern: re.Pattern) -> int:
    """Over text nodes and searched attributes that match: one, and one more for each group."""
    each = 1 + pattern.groups
    total = 0
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag in ("script", "style"):
            continue
        for name, value in e.attrs.items():
            if name not in UNSEARCHED and not name.startswith("data-") and pattern.search(value):
                total += each
        for c in e.children:
            if isinstance(c, Element):
                todo.append(c)
            elif pattern.search(c):
                total += each
    return total


def keyword_pattern(text: str) -> re.Pattern:
    m = re.fullmatch(r"/(.*)/([a-z]*)", text, re.S)
    flags = sum({"i": re.I, "m": re.M, "s": re.S}.get(f, 0) for f in (m[2] if m else ""))
    return re.compile(m[1] if m else re.escape(text), flags)


_DOM_SCHEMA = "id long, meta struct<{}>, images array<struct<src:string,currentSrc:string,alt:string,width:double,height:double,isLazy:boolean,sourceCode:string>>, main struct<wordCount:long,headings:long,images:long,`table`:long,note:string>".format(
    ",".join(f"{f}:{'boolean' if f in ('noindex', 'nofollow', 'noarchive') else 'string'}" for f in META_FIELDS)
)


def parsed(pages: DataFrame, main_selector: str | None = None) -> DataFrame:
    """One DOM pass for each page (id, url, html): meta, images and main-content counts together."""

    def run(batches):
        for batch in batches:
            out = []
            for i, url, source in zip(batch["id"], batch["url"], batch["html"], strict=True):
                root = dom(source)
                out.append((i, meta(root), images(root, url), main_contents(root, main_selector)))
            yield pd.DataFrame(out, columns=["id", "meta", "images", "main"])

    return pages.select("id", "url", "html").mapInPandas(run, _DOM_SCHEMA)
