"""Main text of web pages by wrapper induction.

1. A page's blocks form a tree of parts. Paragraphs, headings, list items and rows of one kind below a part are one repeated
   part; containers are parts of their own, in order, the RUN-th and later ones of a kind sharing one.
2. The different trees of a host are merged into one template by simple tree matching: parts with equal keys are aligned
   child list by child list with a dynamic program; what has no partner stays beside the others.
3. Every page is aligned with its host's template. A text that stands in the same slot on MIN_PAGES pages or more, and on
   SHARE of the pages that have the slot, is constant: it is template. All other text is varying.
4. The slots with the varying prose are the content. Counted over all pages of the host, a slot with more link text than
   prose is a menu, and of containers side by side, small ones are not the content. What the slots' text cannot tell is told
   by names: elements known by tag, role, class or id as navigation, notices, comments and the like are left out unless
   there is nearly no other varying prose beside them; article and main win over containers without such a tag.

Trees are merged in groups of about FAN, in the order of their text, until a host has one; texts are counted by (host, slot,
text). So no host with a third of all pages meets in one task, and the result does not depend on how rows are dealt out.

Nulls and edge cases: null or empty html gives an empty text; a null url, or one without a host, is of the host '' ;
malformed markup is repaired as it comes (open elements end with their block, a cut tag at the end is dropped); pages are
read whole, however long or deep; a page all of whose text is constant keeps what stands in content slots; a host with
fewer than MIN_PAGES pages has no constant text; repeated rows are rows of their own; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import release, small_batches, stored

MIN_PAGES, SHARE = 5, 0.5
#: Containers of one kind below a part that are parts of their own; trees merged in one group.
RUN, FAN = 8, 256
#: Child lists whose lengths' product is greater are aligned by the number of each key's occurrence instead of the dynamic program.
WIDE = 40_000
#: Of the varying prose: what a container must have of the largest one's; what names must leave over to be believed.
SMALL, LEFT = 0.2, 0.05
#: Templates and alignments that a Python worker remembers.
REMEMBERED = 2000

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title noscript iframe noembed noframes xmp")
BLOCKS = _words(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head optgroup option select"
)
#: Elements without readable text, and those whose text is seldom the page's own.
NEVER = _words("script style textarea title noscript iframe noembed noframes xmp head button select option optgroup input svg math template object canvas video audio")
SELDOM = _words("nav footer aside form menu dialog label fieldset")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: Blocks of text: those of one key below a part are one repeated part.
REPEATED = HEADINGS | _words("p li dt dd tr td th pre blockquote address figcaption caption summary hr")
REGIONS = _words("article main")
SCOPES = _words("table td th caption button object template")
#: What an opening element ends, when it is open in the same scope.
ENDS = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
BOILERPLATE = _words(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer sidebar aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login comment comments disqus reply replies respond discussion pagination pager toolbar skip copyright disclaimer masthead alert"
)
ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z", re.S)
#: Attributes that tell something; others are not read.
_TELLING = re.compile(r"(?i)class|id|role|style|hidden")
#: Marks in front of a key: known by name as not the content, and as the content.
SUSPECT, REGION = "!", "@"


class Node:
    """An element. key: tag and names for alignment, with its mark; never: its text is not read."""

    __slots__ = ("children", "key", "never", "tag")

    def __init__(self, tag: str, key: str, never: bool):
        self.tag, self.key, self.never, self.children = tag, key, never, []


def _element(tag: str, attributes: str) -> Node:
    mark = SUSPECT if tag in SELDOM else REGION if tag in REGIONS else ""
    never, names = tag in NEVER, []
    if attributes and _TELLING.search(attributes):
        for name, a, b, c, hidden in _ATTR.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                names += [re.sub(r"\d+", "#", one) for one in value.split()]
                if tag not in ("html", "body") and set(re.split(r"[^a-z]+", value)) & BOILERPLATE:
                    mark = mark or SUSPECT
            elif name == "role":
                mark = SUSPECT if value in ROLES else REGION if value == "main" else mark
            elif hidden or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
                never |= tag not in ("html", "body")
    return Node(tag, mark + ".".join([tag, *sorted(set(names))]), never)


def parse(source: str) -> Node:
    """The element tree; text stays undecoded in the nodes' children."""
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(source)
    open_: dict[str, int] = {}  # open elements of each tag, so that an end without a start costs nothing
    deepest = 1

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    def end(names) -> None:
        if not any(open_.get(name) for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return cut(k)
            if stack[k].tag in SCOPES and "tr" not in names:
                return

    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else _CUT.sub("", source[at:])
        if text:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in BLOCKS and tag != "option":
                end(("p",))
            if tag in ENDS:
                end(ENDS[tag])
            node = _element(tag, m[3])
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s>/])[^>]*>?", re.I).search(source, at)
                node.children.append(source[at : close.start() if close else n])
                at = close.end() if close else n
            elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS - VOID:
                stack.append(node)
                open_[tag] = open_.get(tag, 0) + 1
                deepest = max(deepest, len(stack))
        elif m[1] and open_.get(tag := m[1].lower()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # an inline element does not end a block
    # the functions below call themselves once or twice for each level of a tree
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * deepest))
    return root


class Part:
    """A node of a page's tree of blocks, or of a template. repeated: all kids of one key are one part."""

    __slots__ = ("at", "key", "kids", "last", "repeated")

    def __init__(self, key: str, repeated: bool = False):
        self.key, self.repeated, self.kids, self.at = key, repeated, [], -1
        self.last: dict[str, tuple[int, Part]] = {}  # key: number of kids and the last one

    def kid(self, key: str, tag: str) -> Part:
        count, part = self.last.get(key, (0, None))
        if part is not None and (self.repeated or tag in REPEATED or count >= RUN):
            part.repeated |= count >= RUN
            return part
        part = Part(key, self.repeated or tag in REPEATED)
        self.kids.append(part)
        self.last[key] = (count + 1, part)
        return part


def tag_of(key: str) -> str:
    return key.lstrip(SUSPECT + REGION).partition(".")[0]


def blocks(root: Node) -> tuple[Part, list[tuple[Part, str, int]]]:
    """The page's tree of blocks, and (part, text, characters in links) for every block of text, in page order."""
    top = Part("#")
    out: list[tuple[Part, str, int]] = []
    buffer: list[str] = []
    linked = [0]

    def flush(part: Part) -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append((part, text, min(linked[0], len(text))))
            buffer.clear()
        linked[0] = 0

    def walk(node: Node, part: Part, link: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                buffer.append(child)
                if link:
                    linked[0] += len(child.strip())
            elif child.never:
                if child.tag in BLOCKS:
                    flush(part)
                else:
                    buffer.append(" ")
            elif child.tag in BLOCKS or child.key[0] == SUSPECT:
                flush(part)
                below = part.kid(child.key, child.tag)
                walk(child, below, link or child.tag == "a")
                flush(below)
            elif child.tag == "br":
                buffer.append(" ")
            else:
                walk(child, part, link or child.tag == "a")

    walk(root, top, False)
    flush(top)
    return top, out


def written(top: Part) -> str:
    """A tree as lines of depth, mark of repetition and key; numbers its parts in that order."""
    lines: list[str] = []
    todo = [(top, 0)]
    while todo:
        part, depth = todo.pop()
        part.at = len(lines)
        lines.append(f"{depth} {'*' if part.repeated else '-'}{part.key}")
        todo += [(kid, depth + 1) for kid in reversed(part.kids)]
    return "\n".join(lines)


def read(text: str) -> list[Part]:
    """The parts of a written tree, the root first."""
    parts: list[Part] = []
    path: list[Part] = []
    for at, line in enumerate(text.split("\n")):
        depth, _, key = line.partition(" ")
        part = Part(key[1:], key[0] == "*")
        part.at = at
        del path[int(depth) :]
        if path:
            path[-1].kids.append(part)
        path.append(part)
        parts.append(part)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(parts)))
    return parts


def match(a: Part, b: Part, known: dict) -> int:
    """Simple tree matching: the most pairs of parts that agree in key, order and ancestors."""
    if a.key != b.key:
        return 0
    if (id(a), id(b)) not in known:
        known[id(a), id(b)] = 1 + sum(match(p, q, known) for p, q in aligned(a.kids, b.kids, known) if p and q)
    return known[id(a), id(b)]


def aligned(x: list[Part], y: list[Part], known: dict) -> list[tuple[Part | None, Part | None]]:
    """Both lists as pairs in order; what has no partner is paired with None."""
    if [p.key for p in x] == [q.key for q in y]:
        return list(zip(x, y, strict=True))
    if len(x) * len(y) > WIDE:
        later: dict[str, list[Part]] = {}
        for q in reversed(y):
            later.setdefault(q.key, []).append(q)
        pairs = [(p, later[p.key].pop() if later.get(p.key) else None) for p in x]
        left = {id(q) for rest in later.values() for q in rest}
        return pairs + [(None, q) for q in y if id(q) in left]
    table = [[0] * (len(y) + 1)]
    for p in x:
        row, before = [0], table[-1]
        for j, q in enumerate(y):
            pair = before[j] + match(p, q, known) if p.key == q.key else 0
            row.append(max(row[j], before[j + 1], pair))
        table.append(row)
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and x[i - 1].key == y[j - 1].key and table[i][j] == table[i - 1][j - 1] + match(x[i - 1], y[j - 1], known):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out[::-1]


def merged(a: Part, b: Part, known: dict | None = None) -> Part:
    """Two trees with equal root keys aligned and united."""
    known = {} if known is None else known
    out = Part(a.key, a.repeated or b.repeated)
    for p, q in aligned(a.kids, b.kids, known):
        new = merged(p, q, known) if p and q else p or q
        count, last = out.last.get(new.key, (0, None))
        if count >= (1 if out.repeated else RUN):
            new = merged(last, new)
            out.kids[next(k for k, kid in enumerate(out.kids) if kid is last)] = new
            out.last[new.key] = (count, new)
        else:
            out.kids.append(new)
            out.last[new.key] = (count + 1, new)
    return out


def slots(page: Part, template: Part) -> dict[int, tuple[int, bool]]:
    """For each part of a page, by number: the number of its template part, or of the nearest one around it, and whether
    it stands below an element that the template lacks and that names leave out."""
    found: dict[int, tuple[int, bool]] = {}
    known: dict = {}

    def lost(part: Part, slot: int, out: bool) -> None:
        out |= part.key[0] == SUSPECT
        found[part.at] = (slot, out)
        for kid in part.kids:
            lost(kid, slot, out)

    def pair(part: Part, other: Part) -> None:
        found[part.at] = (other.at, False)
        for p, q in aligned(part.kids, other.kids, known):
            if p and q:
                pair(p, q)
            elif p:
                lost(p, other.at, False)

    pair(page, template)
    return found


def content_slots(parts: list[Part], prose: dict[int, int], links: dict[int, int]) -> set[int]:
    """The slots of a template that hold content, by the characters of varying prose and link text in each."""
    own, linked = [prose.get(p.at, 0) for p in parts], [links.get(p.at, 0) for p in parts]
    total, link = list(own), list(linked)
    region = [p.key[0] == REGION for p in parts]
    headed = [tag_of(p.key) in HEADINGS and n > 0 for p, n in zip(parts, own, strict=True)]
    for p in reversed(parts):  # kids come after their parts
        for kid in p.kids:
            total[p.at] += total[kid.at]
            link[p.at] += link[kid.at]
            region[p.at] |= region[kid.at] and kid.key[0] != SUSPECT
            headed[p.at] |= headed[kid.at]
    kept: set[int] = set()
    todo = [(parts[0], False)]
    while todo:
        part, inside = todo.pop()
        kept.add(part.at)
        kids = [k for k in part.kids if total[k.at] and link[k.at] <= total[k.at]]
        suspects = [k for k in kids if k.key[0] == SUSPECT or not inside and tag_of(k.key) == "header"]
        plain = [k for k in kids if k not in suspects]
        rest, most = own[part.at] + sum(total[k.at] for k in plain), max((total[k.at] for k in kids), default=0)
        if rest < LEFT * (rest + sum(total[k.at] for k in suspects)):
            plain = [k for k in kids if k in plain or 2 * total[k.at] >= most or headed[k.at]]
        boxes = [k for k in plain if tag_of(k.key) not in REPEATED]
        largest = max((total[k.at] for k in boxes), default=0)
        named = [k for k in boxes if region[k.at] and total[k.at] >= LEFT * total[part.at]]
        for k in plain:
            if k in boxes and not inside:
                if largest and total[k.at] < SMALL * largest and not headed[k.at] and k not in named:
                    continue
                if named and k not in named and total[k.at] < largest / SMALL:
                    continue
            todo.append((k, inside or k.key[0] == REGION))
    return kept


class Wrapper:
    """A host's template: its parts, content slots and constant texts; remembers the alignments of page shapes."""

    def __init__(self, template: str, kept=(), constant=()):
        self.parts, self.kept, self.constant = read(template), set(kept), {tuple(c) for c in constant}
        self.known: dict[str, dict] = {}

    def placed(self, source: str | None) -> list[tuple[int, bool, str, int]]:
        """(slot, left out by name, text, characters in links) of every block of a page."""
        top, found = blocks(parse(source or ""))
        shape = written(top)
        if shape not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[shape] = slots(top, self.parts[0])
        at = self.known[shape]
        return [(*at[part.at], text, link) for part, text, link in found]

    def text(self, source: str | None) -> str:
        inside = [(slot, text) for slot, out, text, _ in self.placed(source) if slot in self.kept and not out]
        varying = [text for slot, text in inside if (slot, hashed(text)) not in self.constant]
        return "\n\n".join(varying or [text for _, text in inside])


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 or 1  # 0 stands for the slot as such


def _shapes(batches):
    """The different trees of a batch's pages."""
    for batch in batches:
        found = {(host, written(blocks(parse(source or ""))[0])) for host, source in zip(batch["host"], batch["html"], strict=True)}
        yield pd.DataFrame(sorted(found), columns=["host", "tree"], dtype=object)


def _united(frame: pd.DataFrame) -> pd.DataFrame:
    trees = [read(t)[0] for t in sorted(frame["tree"])]
    whole = trees[0]
    for t in trees[1:]:
        whole = merged(whole, t)
    return pd.DataFrame({"host": frame["host"].iloc[:1], "tree": [written(whole)]})


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tree): one template for every host of pages (host, html), of all its pages."""
    trees = stored(pages.select("host", "html").mapInPandas(_shapes, "host string, tree string").distinct(), "trees")
    while (most := trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        group = F.pmod(F.xxhash64("tree"), F.lit(-(-most // FAN)))
        fewer = stored(trees.withColumn("group", group).groupBy("host", "group").applyInPandas(lambda x: _united(x), "host string, tree string").distinct(), "trees")
        release(trees)
        trees = fewer
    return trees


def _remembered(held: dict, key: str, make):
    if key not in held:
        if len(held) >= REMEMBERED:
            held.clear()
        held[key] = make(key)
    return held[key]


def _counts(batches):
    """(host, slot, text): on how many pages it stands, its prose and link characters; text 0 counts the slot's pages."""
    held: dict[str, Wrapper] = {}
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, source, tree in zip(batch["host"], batch["html"], batch["tree"], strict=True):
            page: dict[tuple, list[int]] = {}
            for slot, _, text, link in _remembered(held, tree, Wrapper).placed(source):
                page.setdefault((host, slot, 0), [1, 0, 0])
                one = page.setdefault((host, slot, hashed(text)), [1, 0, 0])
                one[1] += len(text) - link
                one[2] += link
            for key, values in page.items():
                old = sums.setdefault(key, [0, 0, 0])
                for k in range(3):
                    old[k] += values[k]
        yield pd.DataFrame([(*key, *values) for key, values in sums.items()], columns=["host", "slot", "text", "pages", "prose", "links"])


def _decided(trees: pd.Series, totals: pd.Series, constants: pd.Series) -> pd.Series:
    out = []
    for tree, sums, texts in zip(trees, totals, constants, strict=True):
        prose = {s["slot"]: s["prose"] for s in sums if s["slot"] >= 0}
        links = {s["slot"]: s["links"] for s in sums if s["slot"] >= 0}
        for t in texts:
            prose[t["slot"]] -= t["prose"]
            links[t["slot"]] -= t["links"]
        kept = content_slots(read(tree), prose, links)
        out.append(json.dumps([tree, sorted(kept), sorted((t["slot"], t["text"]) for t in texts if t["slot"] in kept)]))
    return pd.Series(out, dtype=object)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): template, content slots and constant texts of every host of pages (host, html)."""
    trees = templates(pages)
    sums = [F.sum(c).alias(c) for c in ("pages", "prose", "links")]
    counted = pages.select("host", "html").join(trees, "host").mapInPandas(_counts, "host string, slot int, text long, pages long, prose long, links long")
    counted = stored(counted.groupBy("host", "slot", "text").agg(*sums), "counted")
    totals = counted.groupBy("host", "slot").agg(F.max(F.when(F.col("text") == 0, F.col("pages"))).alias("of"), *sums[1:])
    totals = stored(totals, "totals")
    often = counted.filter((F.col("text") != 0) & (F.col("pages") >= MIN_PAGES))
    constant = often.join(totals.select("host", "slot", "of"), ["host", "slot"]).filter(F.col("pages") >= SHARE * F.col("of"))
    # a slot has at most its blocks for each page divided by SHARE constant texts, a host as many slots as its template parts
    by_host = totals.groupBy("host").agg(F.collect_list(F.struct("slot", "prose", "links")).alias("totals"))
    texts = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "text", "prose", "links")).alias("constant"))
    empty = lambda name: F.coalesce(name, F.array()).alias(name)
    whole = trees.join(by_host, "host", "left").join(texts, "host", "left").select("host", "tree", empty("totals"), empty("constant"))
    made = stored(whole.select("host", F.pandas_udf(_decided, "string")("tree", "totals", "constant").alias("wrapper")), "wrappers")
    release(trees, counted, totals)
    return made


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    held: dict[str, Wrapper] = {}
    for sources, made in batches:
        texts = [_remembered(held, w, lambda x: Wrapper(*json.loads(x))).text(s) for s, w in zip(sources, made, strict=True)]
        yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page. Catalyst broadcasts the wrappers only below its size limit; beyond it, AQE
    splits the rows of a host that has too many."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of().alias("host"))
    found = pages.join(wrappers(pages), "host", "left").withColumn("x", F.pandas_udf(_extract, "text string, n_chars long")("html", "wrapper"))
    return found.select("page_id", "url", "x.text", "x.n_chars")
