from collections import defaultdict

from chartula.llm import boilerplate as B
from pyspark.sql import functions as F


def rows(spark, data):
    return spark.createDataFrame(data, "id string, doc string, text string, source string, key string")


def test_wording(spark):
    lines = ["Page 54 of 101", "PAGE 7 0f 9", "* Poge  3 of 101 |", "Print serial 19 - on1y", "print serial 7 only.", "12/34-56", "", None, "Issued on 5 March 2024", "issued on April 17, 2023", "Issued on 3rd Dec. 1999."]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(B.wording(F.col("l"))).collect()]
    assert got[0] == got[1] == got[2] != ""
    assert got[3] == got[4] != ""
    assert got[5] == got[6] == "" and got[7] is None
    assert got[8] == got[9] == got[10] == "issnedon"


def test_found_and_removed_against_brute_force(spark):
    data = []
    for i in range(30):
        notice = f"Page {i} of 90" if i % 7 else f"PAGE {i} 0f 90"
        data.append((f"a{i}", "a", f"Own text number {'x' * i}\n{notice}\n17/3", "s", "k"))
        data.append((f"b{i}", "b" if i < 9 else None, f"Share this\r\nline {'y' * (i + 1)}", None, None))
    data += [("n", "a", None, None, None), ("e", "a", "", None, None), ("twice", "z", "Same\n" * 40, None, None)]
    df = rows(spark, data)
    keyed, found = B.repeated_lines(df, "id", "doc", "text")
    got = {(r.record, r.line_no) for r in found.collect()}
    count = defaultdict(set)
    for i, d, t, *_ in data:
        for line in (t or "").split("\n"):
            w = "".join(c for c in line.lower() if c.isalpha() or c == "0").replace("0f", "of")
            if (w := w.replace("0", "")):
                count[d, w].add(i)
    want = set()
    for i, d, t, *_ in data:
        for n, line in enumerate((t or "").split("\n")):
            w = "".join(c for c in line.lower() if c.isalpha() or c == "0").replace("0f", "of").replace("0", "")
            if w and len(count[d, w]) >= 10:
                want.add((i, n))
    assert got == want and ("b20", 0) in got and ("b3", 0) not in got and not any(r == "twice" for r, _ in got)
    clean = {r.id: r for r in B.without_repeated(df, "id", "doc", "text").collect()}
    assert len(clean) == len(data)
    assert clean["a3"].text == "Own text number xxx\n17/3" and clean["a3"].removed == 1
    assert clean["n"].text is None and clean["e"].text == "" and clean["b20"].text == f"line {'y' * 21}"


def test_hot_source_is_divided(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_LINES", 50)
    data = [(f"r{i}", "hot", f"unique {chr(97 + i % 26)}{chr(97 + i // 26)} {'q' * i}\ncommon notice", None, None) for i in range(200)]
    _, found = B.repeated_lines(rows(spark, data), "id", "doc", "text")
    assert {(r.record, r.line_no) for r in found.collect()} == {(f"r{i}", 1) for i in range(200)}


def test_empty(spark):
    keyed, found = B.repeated_lines(rows(spark, []), "id", "doc", "text")
    assert found.count() == 0 and B.without_repeated(rows(spark, []), "id", "doc", "text").count() == 0


def test_dates_in_other_languages(spark):
    rows = [(a, b) for a, b in [("Gültig ab 5. März 2020", "Gültig ab 11. Mai 2021"), ("Vu le 1er janvier 2020", "Vu le 3 août 2021"), ("Firmado el 5 de mayo de 2020", "Firmado el 17 de enero de 2021"), ("As of May 5, 2020", "As of 7 June 2021")]]
    df = spark.createDataFrame(rows, "a string, b string").select(B.wording(F.col("a")).alias("a"), B.wording(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    one = spark.createDataFrame([("You may ask for a review",)], "a string").select(B.wording(F.col("a"))).first()[0]
    assert "may" in one.replace("nay", "may") or len(one) == len("youmayaskforareview")
