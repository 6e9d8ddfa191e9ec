"""Parsed document trees, web pages and binary files as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import unescape
from .tables import ITEMS

BULLETS = ("·", "•", "-", "–", "*")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "nav", "header", "footer"}
CONTAINERS = {"main", "article", "section", "div", "td"}


def table_text(table: dict) -> str:
    grid = (table.get("data") or {}).get("grid") or []
    return "\n".join(" | ".join((cell.get("text") or "").strip() for cell in row) for row in grid)


@dataclass
class Tree:
    """A parsed document: its nodes by reference, and the heights of its pages."""

    nodes: dict[str, dict]
    heights: dict[int, float | None]
    roots: list[str]

    @classmethod
    def of(cls, doc: dict) -> Tree:
        collections = {name: part for name, part in doc.items() if isinstance(part, list)}
        nodes = {f"#/{name}/{n}": node for name, part in collections.items() for n, node in enumerate(part)}
        heights = {int(n): (page.get("size") or {}).get("height") for n, page in (doc.get("pages") or {}).items()}
        return cls(nodes, heights, below(doc.get("body") or {}))

    def located(self, node: dict) -> dict:
        """Page and distance from the top of the page; boxes are measured from the bottom unless they say otherwise."""
        first = next(iter(node.get("prov") or []), None) or {}
        page, box = first.get("page_no"), first.get("bbox") or {}
        top = box.get("t")
        if box.get("coord_origin", "BOTTOMLEFT") == "BOTTOMLEFT" and top is not None:
            height = self.heights.get(page)
            top = height - top if height else None
        return {"page": page, "top": None if top is None else float(top)}

    def item(self, node: dict, pictured: bool, text: str | None = None, label: str = "text") -> dict:
        marker = node.get("marker") or "" if text is None else ""
        return {"label": node.get("label", label), "text": node.get("text") or "" if text is None else text, "marker": "•" if marker in BULLETS else marker, "in_picture": pictured, **self.located(node)}

    def items(self, refs: list[str], pictured: bool = False) -> Iterator[dict]:
        """What the nodes and those below them show, in reading order. Only the body layer counts; a line made of inline pieces is one item."""
        waiting = [iter([(ref, pictured) for ref in refs])]
        while waiting:
            ref, pictured = next(waiting[-1], (None, False))
            if ref is None:
                waiting.pop()
                continue
            node = self.nodes[ref]
            kind = ref.split("/")[1]
            if node.get("content_layer", "body") != "body":
                continue
            if kind == "groups" and node.get("label") == "inline":
                pieces = [self.nodes[r] for r in below(node)]
                if line := " ".join(filter(None, (p.get("text") for p in pieces))):
                    yield self.item(pieces[0], pictured, line)
            elif kind == "tables":
                yield self.item(node, pictured, table_text(node), "table")
            else:
                if kind not in ("groups", "pictures"):
                    yield self.item(node, pictured)
                waiting.append(iter([(r, pictured or kind == "pictures") for r in below(node)]))


def below(node: dict) -> list[str]:
    return [child["$ref"] for child in node.get("children", [])]


def walk_tree(doc: dict) -> Iterator[dict]:
    """Items of a parsed document in reading order."""
    tree = Tree.of(doc)
    return tree.items(tree.roots)


def tree_items(trees: DataFrame, doc: str = "doc", tree: str = "json") -> DataFrame:
    """Items (see ``ITEMS``) of documents parsed to JSON, one text per document. Null and unreadable trees give no items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch[doc], batch[tree]):
                try:
                    items = list(walk_tree(json.loads(text))) if text else []
                except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                    items = []
                rows += [(name, n, i["label"], i["text"], i["page"], i["top"], i["marker"], i["in_picture"]) for n, i in enumerate(items)]
            out = pd.DataFrame(rows, columns=[f.name for f in ITEMS.fields])
            yield out.astype({"seq": "Int32", "page": "Int32", "top": "Float64"})

    return trees.select(doc, tree).mapInPandas(run, ITEMS)


def grid_text(grid: Column) -> Column:
    """A table of cells (array<array<struct<text>>>) as lines of cells joined by ' | '."""
    return F.array_join(F.transform(grid, lambda row: F.array_join(F.transform(row, lambda c: F.trim(F.coalesce(c["text"], F.lit("")))), " | ")), "\n")


class _Page(HTMLParser):
    """Elements of a page with their source ranges, paragraph counts and links."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.open: list[dict] = []
        self.boxes: list[dict] = []
        self.cuts: list[tuple[int, int]] = []
        self.links: list[tuple[str, str, str]] = []
        self.title, self.muted, self.in_title, self.link = "", None, False, None
        self.row: list[str] = []
        self.feed(source)
        self.close()
        self.end = len(source)
        while self.open:
            self._shut(self.open.pop(), self.end, self.end)

    def _at(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        at = self._at()
        if tag in VOID:
            return
        if self.muted is None and tag in DROPPED:
            self.muted = len(self.open)
        el = {"tag": tag, "from": at, "inner": at + len(self.get_starttag_text() or ""), "depth": len(self.open), "p": 0, "muted": self.muted is not None}
        if tag == "p" and self.muted is None:
            for o in self.open:
                o["p"] += 1
        if tag == "tr":
            self.row = []
        if tag == "title":
            self.in_title = True
        if tag == "a" and self.muted is None:
            self.link = [dict(attrs).get("href") or "", ""]
        self.open.append(el)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.link is not None:
            self.link[1] += data
        self.row.append(data)

    def _shut(self, el: dict, at: int, after: int):
        el["to"] = at
        if el["tag"] in CONTAINERS and not el["muted"]:
            self.boxes.append(el)
        if el["tag"] in DROPPED and self.muted == el["depth"]:
            self.cuts.append((el["from"], after))
            self.muted = None

    def handle_endtag(self, tag):
        at = self._at()
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.link is not None:
            self.links.append((self.link[0], " ".join(self.link[1].split()), " ".join(" ".join(self.row).split())))
            self.link = None
        if any(o["tag"] == tag for o in self.open):
            while True:
                el = self.open.pop()
                self._shut(el, at, at + len(tag) + 3)
                if el["tag"] == tag:
                    return


def main_content(source: str, name: str = "") -> str:
    """The part of a page with most paragraphs (the innermost of equals) as a small page of its own; menus, scripts and styles are left out."""
    page = _Page(source)
    best = max(page.boxes, key=lambda b: (b["p"], b["depth"]), default={"inner": 0, "to": len(source)})
    out, at = [], best["inner"]
    for a, z in sorted(page.cuts):
        if a >= at and z <= best["to"]:
            out.append(source[at:a])
            at = z
    body = "".join([*out, source[at : best["to"]]])
    return f"<html><head><meta charset='utf-8'><title>{' '.join(page.title.split()) or name}</title></head><body>{body}</body></html>"


@F.pandas_udf(StringType())
def main_content_of(pages: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else main_content(p, n or "") for p, n in zip(pages, names)], dtype=object)


def html_text(c: Column) -> Column:
    return unescape(F.regexp_replace(c, "<[^>]+>", " "))


def page_links(pages: DataFrame, key: str = "url", source: str = "html") -> DataFrame:
    """(key, href, text, around): the links of each page with their text and that of the row they stand in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *x) for k, s in zip(b[key], b[source]) if s for x in _Page(s).links], columns=[key, "href", "text", "around"])

    return pages.select(key, source).mapInPandas(run, f"{key} string, href string, text string, around string")


def link_title(c: Column) -> Column:
    """Titles for comparison: one kind of dash, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "–—‐‑", "----"), r"(?U)\s+", " ")))


def pdf_links(links: DataFrame, title: str | None = None) -> DataFrame:
    """Links to PDF files; with ``title`` only those whose text or row holds it."""
    own = links.filter(F.lower("href").rlike(r"\.pdf(?:[?#]|$)"))
    return own if title is None else own.filter(link_title(F.concat_ws(" ", "text", "around")).contains(link_title(F.lit(title))))


def find_pdfs(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(title, href) for each row of ``wanted`` (title, url): the link to a PDF file on that page whose text or row holds the title; else the first
    such link of a page that a link with the title leads to; else the page's only PDF file. ``pages`` is (url, html), with the pages led to."""
    title = link_title(F.col("title"))
    links = page_links(pages).withColumns({"_pdf": F.lower("href").rlike(r"\.pdf(?:[?#]|$)"), "_said": link_title(F.concat_ws(" ", "text", "around"))})
    met = wanted.join(links, "url")
    own = met.filter(F.col("_pdf") & F.col("_said").contains(title)).select("title", "href", F.lit(0).alias("_way"))
    named = met.filter(~F.col("_pdf") & link_title(F.col("text")).contains(title)).select("title", F.col("href").alias("url"))
    beyond = named.join(links.filter("_pdf").select("url", "href"), "url").select("title", "href", F.lit(1).alias("_way"))
    only = met.filter("_pdf").groupBy("title").agg(F.min("href").alias("href"), F.count_distinct("href").alias("_k")).filter("_k = 1").select("title", "href", F.lit(2).alias("_way"))
    return own.unionByName(beyond).unionByName(only).groupBy("title").agg(F.min(F.struct("_way", "href")).alias("_b")).select("title", "_b.href")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.unhex(F.lit("25504446")), F.lit(False))
