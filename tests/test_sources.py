import json

import pytest

from chartula.operators.chunking import chunk_items
from chartula.sources import documents as D
from chartula.sources import tables as K
from chartula.streaming.events import ChunkLoader, run_available
from pyspark.sql import functions as F

PAGE = """<html><head><title>A  page</title><script>var p='<p>';</script></head><body><nav><p>menu</p><p>m</p><p>m</p><p>m</p></nav>
<table><tr><td><div id="x"><p>One</p><p>Two &amp; three</p><style>p{}</style></div></td></tr>
<tr><td>Circular on lending – 2020</td><td><a href="/f/x.PDF?v=1">download</a><br><a href="y.html">other</a></td></tr></table><footer><p>f</p></footer></body></html>"""


def test_main_content():
    out = D.main_content(PAGE, "stem")
    assert out.startswith("<html><head><meta charset='utf-8'><title>A page</title>") and "<p>One</p>" in out and "menu" not in out and "style" not in out and "download" not in out
    assert "<body>plain</body>" in D.main_content("plain", "n") and "<title>n</title>" in D.main_content("plain", "n")
    assert D.main_content("<div><p>a<div><p>b", "")


def test_pages_table(spark):
    df = spark.createDataFrame([("u", PAGE), ("n", None), ("e", "")], "url string, html string")
    links = D.page_links(df)
    assert {(r.href, r.text) for r in links.collect()} == {("/f/x.PDF?v=1", "download"), ("y.html", "other")}
    assert D.pdf_links(links).count() == D.pdf_links(links, "circular on  lending - 2020").count() == 1 and D.pdf_links(links, "absent").count() == 0
    assert df.select(D.main_content_of("html", "url")).filter("`main_content_of(html, url)` is null").count() == 1
    assert spark.createDataFrame([("<p>a &lt; b</p>",)], "h string").select(F.trim(D.html_text(F.col("h")))).first()[0] == "a < b"
    assert [r[0] for r in spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"<html"),), (None,)], "c binary").select(D.is_pdf(F.col("c"))).collect()] == [True, False, False]


TREE = {
    "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/4"}]},
    "texts": [
        {"self_ref": "#/texts/0", "label": "section_header", "text": "Chapter I - Scope", "prov": [{"page_no": 1, "bbox": {"t": 700, "coord_origin": "BOTTOMLEFT"}}]},
        {"self_ref": "#/texts/1", "label": "list_item", "text": "1. First", "marker": "-", "prov": [{"page_no": 1, "bbox": {"t": 10, "coord_origin": "TOPLEFT"}}]},
        {"self_ref": "#/texts/2", "label": "text", "text": "rule."}, {"self_ref": "#/texts/3", "label": "text", "text": "in a picture"},
        {"self_ref": "#/texts/4", "label": "text", "text": "hidden", "content_layer": "furniture"},
    ],
    "groups": [{"self_ref": "#/groups/0", "label": "inline", "children": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/2"}]}],
    "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "children": [{"$ref": "#/texts/3"}]}],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"grid": [[{"text": " a "}, {"text": "b"}], [{}, {"text": "c"}]]}}],
    "pages": {"1": {"size": {"height": 800}}},
}


def test_tree_to_chunks(spark):
    df = spark.createDataFrame([("d.pdf", json.dumps(TREE)), ("bad.pdf", "{"), ("none.pdf", None)], "doc string, json string")
    items = D.tree_items(df).orderBy("seq").collect()
    assert [(r.label, r.text, r.page, r.top, r.in_picture) for r in items] == [
        ("section_header", "Chapter I - Scope", 1, 100.0, False), ("list_item", "1. First rule.", 1, 10.0, False), ("text", "in a picture", None, None, True), ("table", "a | b\n | c", None, None, False),
    ]
    got = chunk_items(D.tree_items(df)).collect()
    assert [(r.chapter, r.para) for r in got] == [("Chapter I - Scope", "1")]
    grid = spark.createDataFrame([([[{"text": " a "}, {"text": None}]],)], "g array<array<struct<text:string>>>")
    assert grid.select(D.grid_text(F.col("g"))).first()[0] == "a | "


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('file_name,title,issue_date,status\na.pdf," T, ""q""\nline two ",2024-01-02,active\nb.pdf,,bad,\n', encoding="utf-8")
    got = {r.file_name: r for r in K.read_csv(spark, str(p), K.REGISTER).collect()}
    assert got["a.pdf"].title == 'T, "q"\nline two' and str(got["a.pdf"].issue_date) == "2024-01-02" and got["b.pdf"].title is None and got["b.pdf"].issue_date is None and got["b.pdf"].notes is None
    chunks = spark.createDataFrame([("c1", "d.pdf", "é text", 1), ("c2", "d.pdf", None, None)], "chunk_id string, doc string, text string, part int")
    K.write_chunks(chunks, str(tmp_path / "j"))
    back = {r.chunk_id: (r.doc, r.text, r.part) for r in K.read_chunks(spark, str(tmp_path / "j")).collect()}
    assert back == {"c1": ("d.pdf", "é text", 1), "c2": ("d.pdf", None, None)}
    K.write_csv(chunks.withColumn("_x", F.lit(1)).withColumn("a", F.array(F.lit(1))), str(tmp_path / "c"))
    assert K.read_csv(spark, str(tmp_path / "c")).columns == ["chunk_id", "doc", "text", "part", "a"]


def test_results_and_updates(spark):
    old = spark.createDataFrame([("1", "1", "", "")], "id string, refused string, answer_cost_usd string, answer_input_tokens string")
    r = K.typed_results(old).first()
    assert (r.refused, r.exact_refusal, r.answer_cost_usd, r.answer_input_tokens) == (1, 1, 0.0, 0)
    u = K.update_column(spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, v string, w string"), spark.createDataFrame([("2", None)], "id string, v string"), "id", "v")
    assert {tuple(x) for x in u.collect()} == {("1", "a", "x"), ("2", None, "y")} and u.columns == ["id", "v", "w"]
    assert K.union_of_columns([old, u]).columns[:1] == ["id"] and K.union_of_columns([old, u]).count() == 3
    assert K.markdown_table(u.orderBy("id")).splitlines()[2] == "| 1 | a | x |"
    assert K.point_lookup(u, "id", "1").count() == 1


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS chartula_test")
    K.create_tables(spark, "chartula_test")
    K.create_tables(spark, "chartula_test")
    assert K.column_counts(spark, "chartula_test") == {"register": len(K.REGISTER.fields), "chunks": len(K.CHUNKS.fields)}
    spark.sql("DROP DATABASE chartula_test CASCADE")


def test_streams(spark, sf, tmp_path):
    got = run_available(spark, f"{sf}/events.parquet")
    assert 0 < got.count() and got.agg(F.sum("n")).first()[0] <= spark.read.parquet(f"{sf}/events.parquet").count()
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "chunk_id string, loaded_at int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    loader = ChunkLoader(spark, f"file://{tmp_path}/out", rows.schema)
    assert {tuple(r) for r in loader.run(str(tmp_path / "in")).collect()} == {("a", 2, "y"), ("b", 1, "z")}


def test_pdfs_behind_titled_pages(spark):
    pages = [("p", "<table><tr><td>Rules on Gold</td><td><a href='g.pdf'>x</a></td></tr><tr><td><a href='s.html'>Rules on Silver</a></td></tr></table>"), ("s.html", "<a href='s1.pdf'>download</a>"), ("o", "<a href='only.pdf'>x</a>"), ("n", None)]
    wanted = spark.createDataFrame([("rules on GOLD", "p"), ("Rules on Silver", "p"), ("Rules on Tin", "o"), ("Rules on Tin 2", "p2"), ("Rules on Lead", "n")], "title string, url string")
    got = {r.title: r.href for r in D.find_pdfs(spark.createDataFrame(pages, "url string, html string"), wanted).collect()}
    assert got == {"rules on GOLD": "g.pdf", "Rules on Silver": "s1.pdf", "Rules on Tin": "only.pdf"}


def test_csv_is_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    K.write_csv(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string"), path)
    K.replace_csv(K.read_csv(spark, path).withColumn("v", F.upper("v")), path)
    assert sorted(tuple(r) for r in K.read_csv(spark, path).collect()) == [("1", "A"), ("2", "B")]


def test_lookup_without_a_row_fails(spark):
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    assert K.point_lookup(df, "id", "a").first().v == 1
    with pytest.raises(Exception, match="no row with id b"):
        K.point_lookup(df, "id", "b").collect()
