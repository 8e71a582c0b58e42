"""Per-page analyzers: a plugin gets a page and gives cells and violations; results stay in long form until a sheet is made."""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import pages as html

CELLS = "kind string, url string, col string, value string, value_type string, note string, validator string, severity string, rule string, code string, message string, plugin_seq int, emit_seq int"


@dataclass
class Analyzer:
    """A plugin: each_page(url, html) and each_url(url, external) give (cells, violations), or None for no row.

    Cells are (column, value, note); violations are dicts of validator, severity, rule, code, message and url.
    """

    name: str
    headers: dict[str, str]
    label: str | None = None
    each_page: Callable | None = None
    each_url: Callable | None = None


REGISTRY: dict[str, Callable[[dict], Analyzer]] = {}
ALLOWED = ("siteloom-", "analyze-")


def register(name: str):
    def add(factory):
        REGISTRY[name] = factory
        return factory

    return add


def load(settings: dict[str, dict | bool], overrides: dict[str, dict] | None = None) -> list[Analyzer]:
    """Plugins of a settings table: true means no options, a false value leaves one out; overrides are merged on top."""
    out = []
    for name, value in (settings or dict.fromkeys(REGISTRY, True)).items():
        if not value:
            continue
        if not name.startswith(ALLOWED):
            raise ValueError(f"{name} is not an analyzer")
        out.append(REGISTRY[name]((value if isinstance(value, dict) else {}) | (overrides or {}).get(name, {})))
    return out


def select(available: list[str], everything: bool = False, chosen: Iterable[str] | None = None) -> list[str]:
    return available if everything or chosen is None else [a for a in available if a in set(chosen)]


def labels() -> dict[str, str]:
    found = {}
    for name, factory in REGISTRY.items():
        try:
            found[name] = factory({}).label or name
        except Exception:  # a plugin that fails has no label
            continue
    return found


def headers(plugins: list[Analyzer]) -> dict[str, str]:
    """All columns, the first place and the last label of each."""
    out: dict[str, str] = {}
    for p in plugins:
        out |= p.headers
    return out


def _kind(value) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


def _rows(result, url: str, seq: int):
    cells, found = result
    for k, (col, value, note) in enumerate(cells or ()):
        shown = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        yield ("cell", url, col, shown, _kind(value), note, None, None, None, None, None, seq, k)
    for k, v in enumerate(found or ()):
        yield ("violation", v.get("url", url), None, None, None, None, v.get("validator"), v.get("severity"), v.get("rule"), v.get("code"), v.get("message"), seq, k)


def analyze(pages: DataFrame, plugins: list[Analyzer]) -> DataFrame:
    """Long rows of kind cell, violation or error for pages (url, html, isExternal). A page that fails spoils no other.

    All plugins run in one pass over the pages: first the page parts, then the url parts, which so come later in order.
    """

    def run(batches):
        for batch in batches:
            out = []
            for url, source, external in zip(batch["url"], batch["html"], batch["isExternal"], strict=True):
                for seq, (p, call) in enumerate([(p, "each_page") for p in plugins] + [(p, "each_url") for p in plugins]):
                    f = getattr(p, call)
                    if f is None or (call == "each_page" and source is None):
                        continue
                    try:
                        result = f(url, source) if call == "each_page" else f(url, bool(external))
                        if result is not None:
                            out += _rows(result, url, seq)
                    except Exception:
                        out.append(("error", url, p.name, None, None, None, None, None, None, None, traceback.format_exc(limit=1), seq, 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])

    return pages.select("url", "html", "isExternal").mapInPandas(run, CELLS)


def merged(cells: DataFrame) -> DataFrame:
    """One cell for each url and column: the last plugin's, and its last."""
    w = Window.partitionBy("url", "col").orderBy(F.col("plugin_seq").desc(), F.col("emit_seq").desc())
    own = cells.filter("kind = 'cell'") if "kind" in cells.columns else cells
    return own.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("url", "col", "value", "value_type", "note")


def pivoted(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The sheet's form; the column list is given, so no extra job looks for it."""
    return cells.groupBy("url").pivot("col", columns).agg(F.first("value"))


def violation_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("validator", "severity", "rule").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


# Adapters: raw findings of outside rule engines as violations and cells.


def accessibility(findings: DataFrame) -> DataFrame:
    """findings (url, outcome, impact, rule, message, nodes): incomplete ones first, then violations; of these, ones without
    impact are dropped. Other outcomes are no findings. A run that failed is a row without outcome."""
    rows = findings.filter("outcome IN ('incomplete', 'violations') AND impact IS NOT NULL OR outcome IS NULL")
    return rows.select(
        F.lit("accessibility").alias("validator"), F.coalesce("impact", F.lit("error")).alias("severity"), F.coalesce("rule", F.lit("UNKNOWN_RULE")).alias("rule"),
        F.array_join("nodes", "\n").alias("code"), "message", "url", F.when(F.col("outcome") == "incomplete", 0).otherwise(1).alias("turn"),
    )


def markup(findings: DataFrame) -> DataFrame:
    """findings (url, severity, ruleId, message, line, col)."""
    place = F.concat("url", F.lit(" ("), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(")"))
    return findings.select(F.lit("markup").alias("validator"), "severity", F.col("ruleId").alias("rule"), F.lit("").alias("code"), "message", place.alias("url"))


def markup_cells(findings: DataFrame) -> DataFrame:
    """The number of findings of each page, as text, with a line for each."""
    line = F.concat(F.lit("["), "severity", F.lit("] "), "message", F.lit(" ("), "ruleId", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("line", "col", line.alias("v"))))
    return findings.groupBy("url").agg(F.count("*").cast("string").alias("value"), F.array_join(F.transform(rows, lambda r: r["v"]), "\n").alias("note"))


def prose(findings: DataFrame) -> DataFrame:
    """findings (url, severity, ruleId, message, line, col): severity 1 is a warning, any other an error."""
    place = F.concat("url", F.lit(" ("), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(")"))
    level = F.when(F.col("severity") == 1, "warning").otherwise("error")
    return findings.select(F.lit("prose").alias("validator"), level.alias("severity"), F.col("ruleId").alias("rule"), F.lit("-").alias("code"), "message", place.alias("url"))


def scores(audits: DataFrame) -> DataFrame:
    """audits (url, category, score, title, description): a category's rounded score of 100 and its lines; an error is 0."""
    line = F.concat("title", F.lit(": "), "description")
    rows = F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), line)))
    out = audits.groupBy("url", "category").agg(F.floor(F.max("score") * 100 + 0.5).cast("long").alias("value"), F.array_join(rows, "\n").alias("note"))
    return out.select("url", "category", F.coalesce("value", F.lit(0)).alias("value"), F.when(F.col("value").isNull(), "Error").otherwise(F.col("note")).alias("note"))


# Built-in analyzers.


@register("analyze-search")
def search(options: dict) -> Analyzer:
    """Keyword counts below an optional scope element, and whether selectors hit anything in the document.

    Keywords and selectors are texts, or dicts of search and title; each is taken once. Of a dict, the header names search and
    the pattern is title, as in the tool whose results these are. A page without the scope has no row.
    """

    def entries(name: str) -> list[tuple[str, str]]:
        given = [(x["search"], x["title"]) if isinstance(x, dict) else (x, x) for x in options.get(name, ())]
        return list(dict.fromkeys(given))

    words = [(f"keyword:{title}", html.keyword_pattern(title)) for _, title in entries("keywords")]
    tests = []
    for _, title in entries("selectors"):
        try:
            tests.append((f"selector:{title}", html.selector(title)))
        except ValueError:  # finds nothing
            continue
    scope = html.selector(options["scope"]) if options.get("scope") else None

    def each_page(url: str, source: str):
        document = html.dom(source)
        root = document if scope is None else next((e for e in document.walk() if scope(e)), None)
        if root is None:
            return None
        cells = [(name, html.keyword_count(root, p), None) for name, p in words]
        return cells + [(name, True, None) for name, test in tests if any(map(test, document.walk()))], []

    headers = {f"keyword:{s}": f"Search keyword: {s}" for s, _ in entries("keywords")} | {f"selector:{s}": f"Search selector: {s}" for s, _ in entries("selectors")}
    return Analyzer("analyze-search", headers, "Search", each_page)


@register("analyze-main-contents")
def main_contents(options: dict) -> Analyzer:
    def each_page(url: str, source: str):
        found = html.main_contents(html.dom(source), options.get("mainContentSelector"))
        if found is None:
            return None
        return [(c, found[c], found["note"] if c == "table" else None) for c in ("wordCount", "headings", "images", "table")], []

    return Analyzer("analyze-main-contents", {"wordCount": "Word count", "headings": "Headings", "images": "Images", "table": "Tables"}, "Main contents", each_page)


@register("analyze-rules")
def rules(options: dict) -> Analyzer:
    """A few rules of markup on the element tree: lang, title, alt, ids and heading order."""

    def each_page(url: str, source: str):
        root, found = html.dom(source), []
        add = lambda rule, level, code, message: found.append({"validator": "rules", "severity": level, "rule": rule, "code": code, "message": message, "url": url})
        nodes = list(root.walk())
        if not any(e.tag == "html" and e.attrs.get("lang") for e in nodes):
            add("html-lang", "error", "<html>", "The page has no language")
        if not any(e.tag == "title" and e.text().strip() for e in nodes):
            add("title", "error", "<title>", "The page has no title")
        ids: set[str] = set()
        level = 0
        for e in nodes:
            if e.tag == "img" and "alt" not in e.attrs:
                add("img-alt", "error", e.source, "The image has no alternative text")
            if i := e.attrs.get("id"):
                if i in ids:
                    add("id-duplication", "error", e.source, f"The id {i} is given twice")
                ids.add(i)
            if re.fullmatch("h[1-6]", e.tag):
                if level and int(e.tag[1]) > level + 1:
                    add("heading-levels", "warning", e.source, f"h{level} is followed by {e.tag}")
                level = int(e.tag[1])
        return [("rules", str(len(found)), "\n".join(f"[{v['severity']}] {v['message']}" for v in found))], found

    return Analyzer("analyze-rules", {"rules": "Rules"}, "Rules", each_page)
