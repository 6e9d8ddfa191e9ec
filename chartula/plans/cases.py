"""Small inputs written by hand, with the rows they must give: for operators whose inputs (pages, document trees, parsed items) no table holds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..sources import documents as D
from ..sources import tables as K
from .tables import read, shared_dir

PAGES = [
    ("a.html", "<html><head><title> One  page </title><script>x<p></script></head><body><nav><p>menu</p><p>menu</p></nav><div><p>First &amp; best</p><p>Second</p></div><footer><p>foot</p></footer></body></html>"),
    ("b.html", "<table><tr><td>Rules on Gold – 2020</td><td><a href='/f/gold.pdf'>PDF</a> <a href='more.html'>more</a></td></tr><tr><td><a href='/f/other.PDF?x=1'>Rules on Silver</a></td></tr></table>"),
    ("c.html", "plain text"),
]
TREE = {
    "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/4"}]},
    "texts": [
        {"self_ref": "#/texts/0", "label": "section_header", "text": "Chapter I - Scope", "prov": [{"page_no": 1, "bbox": {"t": 700, "coord_origin": "BOTTOMLEFT"}}]},
        {"self_ref": "#/texts/1", "label": "list_item", "text": "First", "marker": "-", "prov": [{"page_no": 2, "bbox": {"t": 10, "coord_origin": "TOPLEFT"}}]},
        {"self_ref": "#/texts/2", "label": "text", "text": "rule."}, {"self_ref": "#/texts/3", "label": "text", "text": "in a picture"},
        {"self_ref": "#/texts/4", "label": "text", "text": "hidden", "content_layer": "furniture"},
    ],
    "groups": [{"self_ref": "#/groups/0", "label": "inline", "children": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/2"}]}],
    "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "children": [{"$ref": "#/texts/3"}]}],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"grid": [[{"text": " a "}, {"text": "b"}], [{}, {"text": "c"}]]}}],
    "pages": {"1": {"size": {"height": 800}}},
}
LONG = "many words of a clause " * 20
#: (doc, seq, label, text, page, top, marker, in_picture)
ITEMS = [
    ("guide.pdf", 1, "text", "MASTHEAD", 1, None, "", False), ("guide.pdf", 2, "section_header", "Introduction", 1, None, "", False), ("guide.pdf", 3, "text", "Before the rules &amp; all.", 1, None, "", False),
    ("guide.pdf", 4, "text", "Chapter I", 1, None, "", False), ("guide.pdf", 5, "section_header", "Scope", 1, None, "", False), ("guide.pdf", 6, "text", "1. [1First rule: it", 1, None, "", False), ("guide.pdf", 7, "text", "goes on. 2. Second rule.", 2, None, "", False),
    ("guide.pdf", 8, "section_header", "B. Duties", 2, None, "", False), ("guide.pdf", 9, "section_header", "B.1 Phases of Work", 2, None, "", False), ("guide.pdf", 10, "text", "4. After a gap.", 3, None, "", False),
    ("guide.pdf", 11, "footnote", "1 Inserted vide notice 7", 1, None, "", False), ("guide.pdf", 12, "text", "(A. Signatory)", 3, None, "", False), ("guide.pdf", 13, "text", "Not part of it", 3, None, "", False),
    ("guide.pdf", 14, "text", "Annex II - Form", 4, None, "", False), ("guide.pdf", 15, "text", "Q. 1. Question one?", 4, None, "", False), ("guide.pdf", 16, "text", "Yours faithfully", 5, None, "", False),
    ("long.pdf", 1, "text", "1. The lender shall:", 1, None, "", False), *[("long.pdf", 2 + i, "text", f"({'abcdef'[i]}) {LONG}ends;", 1 + i, None, "", False) for i in range(6)],
]
#: (chunk_id, chapter, section, para_title, part, parts, page_start, page_end, amendment_note, warning, chars) of ITEMS, derived by hand from the rules.
CHUNKS = [
    ("guide__main__pre__1", None, "Introduction", "Introduction", 1, 1, 1, 1, None, None, 23),
    ("guide__main__p1__1", "Chapter I - Scope", None, "[First rule", 1, 1, 1, 2, "Inserted vide notice 7", None, 27),
    ("guide__main__p2__1", "Chapter I - Scope", None, "Second rule", 1, 1, 2, 2, None, None, 15),
    ("guide__main__p4__1", "Chapter I - Scope", "B. Duties › B.1 Phases of Work", "After a gap", 1, 1, 3, 3, None, "main para 4 follows 2 on page 3", 15),
    ("guide__annex_II__p1__1", None, "Form", "Question one?", 1, 1, 4, 5, None, None, 36),
    ("long__main__p1__1", None, None, "The lender shall", 1, 2, 1, 3, None, None, 20 + 3 * (1 + 4 + 460 + 5)),
    ("long__main__p1__2", None, None, "The lender shall", 2, 2, 4, 6, None, None, 35 + 3 * (1 + 4 + 460 + 5)),
]


def values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Main content of pages, as text."""
    pages = spark.createDataFrame(PAGES, "name string, html string")
    return pages.select("name", F.trim(F.regexp_replace(D.html_text(F.regexp_extract(D.main_content_of("html", "name"), r"(?s)<body>(.*)</body>", 1)), r"\s+", " ")).alias("text"), F.regexp_extract(D.main_content_of("html", "name"), "<title>(.*)</title>", 1).alias("title"))


def pdf_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to PDF files whose text or row holds a title, in any dash or case."""
    return D.pdf_links(D.page_links(spark.createDataFrame(PAGES, "url string, html string")), "rules on gold - 2020").select("url", "href")


def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    trees = spark.createDataFrame([("t.pdf", json.dumps(TREE)), ("broken.pdf", "{")], "doc string, json string")
    return D.tree_items(trees).select("doc", "seq", "label", "text", "page", "top", "marker", "in_picture")


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    grids = spark.createDataFrame([("x", [[{"text": " a "}, {"text": None}], [{"text": "b"}, {"text": "c"}]]), ("y", [])], "name string, grid array<array<struct<text:string>>>")
    return grids.select("name", D.grid_text(F.col("grid")).alias("text"))


def pdf_magic(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7")), ("b", bytearray(b"<html>")), ("c", None)], "name string, content binary")
    return files.select("name", D.is_pdf(F.col("content")).alias("is_pdf"))


def chunk_cases(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain from items to chunk records."""
    items = spark.createDataFrame(ITEMS, "doc string, seq int, label string, text string, page int, top double, marker string, in_picture boolean")
    return C.chunk_items(items).select("chunk_id", "chapter", "section", "para_title", "part", "parts", "page_start", "page_end", "amendment_note", "warning", F.length("text").alias("chars"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The questions written as CSV and read again by their schema."""
    path = shared_dir(spark)
    K.write_csv(read(spark, d, "questions").withColumn("_left_out", F.lit(1)), path)
    return K.read_csv(spark, path, K.QUESTIONS)


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as JSON lines by source and read again, as chunk records."""
    path = shared_dir(spark)
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("source", F.lit("none")).alias("doc"), "text")
    K.write_chunks(docs, path)
    return K.read_chunks(spark, path).select("chunk_id", "doc", "title", F.length("text").alias("chars"))


def column_union(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "questions")
    return K.union_of_columns([q.filter("type = 'simple'").select("id", "type"), q.filter("type = 'change'").select("id", "page")])


def updated_column(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "questions").select("id", "verified", "auto_check")
    return K.update_column(q, q.filter("verified is not null").select("id", F.upper(F.trim("verified")).alias("auto_check")), "id", "auto_check")


def typed_results(spark: SparkSession, d: str) -> DataFrame:
    """Results as an older file holds them: texts, blanks, no column for exact refusals."""
    v = read(spark, d, "questions").select("id", F.when(F.length("id") % 2 == 0, " 1 ").otherwise("").alias("refused"), F.lit("").alias("answer_cost_usd"), F.length("question").cast("string").alias("answer_input_tokens"))
    return K.typed_results(v)


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "questions").select("id", "type")
    return K.point_lookup(q, "id", "q001")


CASES = {f.__name__: f for f in (html_pages, pdf_links, tree_walk, table_cells, pdf_magic, chunk_cases, csv_round_trip, jsonl_round_trip, column_union, updated_column, typed_results, point_lookup)}

CASE_ORACLES = {
    "html_pages": values([("a.html", "First & best Second", "One page"), ("b.html", "Rules on Gold – 2020", "b.html"), ("c.html", "plain text", "c.html")], "name, text, title"),
    "pdf_links": values([("b.html", "/f/gold.pdf")], "url, href"),
    "tree_walk": values([("t.pdf", 0, "section_header", "Chapter I - Scope", 1, 100.0, "", False), ("t.pdf", 1, "list_item", "First rule.", 2, 10.0, "", False), ("t.pdf", 2, "text", "in a picture", None, None, "", True), ("t.pdf", 3, "table", "a | b\n | c", None, None, "", False)], "doc, seq, label, text, page, top, marker, in_picture"),
    "table_cells": values([("x", "a | \nb | c"), ("y", "")], "name, text"),
    "pdf_magic": values([("a", True), ("b", False), ("c", False)], "name, is_pdf"),
    "chunk_cases": values(CHUNKS, "chunk_id, chapter, section, para_title, part, parts, page_start, page_end, amendment_note, warning, chars"),
    "csv_round_trip": "select " + ", ".join(f"nullif(trim({c}), '') as {c}" for c in K.QUESTIONS.names) + " from questions",
    "jsonl_round_trip": "select doc_id::varchar as chunk_id, coalesce(source, 'none') as doc, null::varchar as title, length(text)::int as chars from documents",
    "column_union": "select id, type, null as page from questions where type = 'simple' union all select id, null, page from questions where type = 'change'",
    "updated_column": "select id, verified, case when verified is not null then upper(trim(verified)) else auto_check end as auto_check from questions",
    "typed_results": "select id, case when length(id) % 2 = 0 then 1 end as refused, 0.0::double as answer_cost_usd, length(question)::bigint as answer_input_tokens, case when length(id) % 2 = 0 then 1 end as exact_refusal from questions",
    "point_lookup": "select id, type from questions where id = 'q001'",
}
