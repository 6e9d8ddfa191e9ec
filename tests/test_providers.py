import pytest
from chartula.operators import answering as A
from chartula.operators import evaluate as E
from chartula.operators import providers as P
from pyspark.sql import functions as F


def test_retries():
    calls, waits = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return x.upper()

    assert P.with_retries(call, sleep=waits.append)("a") == "A" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(TimeoutError):
        P.with_retries(lambda x: (_ for _ in ()).throw(TimeoutError()), tries=2, sleep=waits.append)("a")
    late = TimeoutError()
    late.retry_after = 999
    with pytest.raises(TimeoutError):
        P.with_retries(lambda x: (_ for _ in ()).throw(late), sleep=waits.append)("a")


def test_registry_and_callable(spark):
    with pytest.raises(ValueError):
        P.generator("none")
    df = spark.createDataFrame([("Sources:\n\n[S1] h\nText:\nThe fee is due in May. Other.\n\n---\n\nQuestion: when is the fee due",), (None,)], "prompt string")
    assert P.generator("extractive")(df).select("answer").collect()[0][0] == "The fee is due in May. [S1]"
    assert sorted(str(r.answer) for r in P.calling_generator(lambda p: p.upper())(df.limit(2)).collect())[0] == "None"


def test_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    got = [r.v for r in df.select(P.hashing_embedder(8)(F.col("text")).alias("v")).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] is None and got[2] is None
    assert P.embed_queries(df).filter("vec is null").count() == 0


def test_delta_embeds_only_changes(spark):
    df = spark.createDataFrame([("1", "x y", [1.0], "reuse"), ("2", "x y", None, "new")], "id string, text string, vec array<float>, change string")
    got = {r.id: r.vec for r in P.embed_delta(df, "text", "vec").collect()}
    assert got["1"] == [1.0] and len(got["2"]) == 64


def test_judge(spark):
    df = spark.createDataFrame([("1", "The fee is 5 per cent and due in May", ["5 per cent", "due in May"]), ("2", "fee May", ["due in May", "the fee of 5"]), ("3", None, ["x"]), ("4", "y", [])], "id string, answer string, facts array<string>")
    got = {r.id: (r.verdict, r.present, r.facts) for r in P.judge(P.rule_votes(df), ["id"]).collect()}
    assert got["1"] == ("correct", 2, 2) and got["3"] == ("incorrect", 0, 1) and got["4"][0] == "incorrect" and got["2"][0] == "incorrect"
    votes = spark.createDataFrame([("a", 0, ["present", "present"]), ("a", 1, ["present"]), ("a", 2, ["present", "missing"])], "id string, vote int, statuses array<string>")
    assert tuple(P.judge(votes, ["id"]).first())[:4] == ("a", "partial", 2, 1)


def test_parser_isolates_failures(spark):
    files = spark.createDataFrame([("x/a.pdf", bytearray(b"{}")), ("x/b.pdf", bytearray(b"bad")), ("x/c.pdf", bytearray(b"{}"))], "path string, content binary")
    done = spark.createDataFrame([("c.pdf",)], "doc string")

    def parser(doc, content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    got = {r.doc: (r.json, r.error) for r in P.parse_files(files, parser, done).collect()}
    assert got == {"a.pdf": ("{}", None), "b.pdf": (None, "ValueError: broken")}


def test_graded_rows_and_names(spark):
    df = spark.createDataFrame([("1", " Correct"), ("2", ""), ("3", None)], "id string, v string")
    assert [tuple(r) for r in E.graded_rows(df, "v").collect()] == [("1", "correct")]
    with pytest.raises(Exception, match="no verdict"):
        E.graded_rows(spark.createDataFrame([("1", "maybe")], "id string, v string"), "v").collect()
    reg = spark.createDataFrame([("a.html",), ("a.pdf",), ("b.pdf",)], "file_name string")
    assert {r.name: r.doc for r in E.resolve_document(spark.createDataFrame([("a.json",), ("z",)], "name string"), reg).collect()} == {"a.json": "a.html", "z": "z.pdf"}
    assert spark.createDataFrame([(1, None, "f.pdf"), (2, "c", "g")], "n int, chunk_id string, doc string").select(E.encoded_sources()).collect()[0][0] == "S1=status:f.pdf"


def test_cache_outlives_its_session(spark, tmp_path):
    r = spark.createDataFrame([("q1", "p"), ("q2", "p"), ("q3", "other"), ("q4", "fails")], "qid string, prompt string")
    generate = lambda df: df.withColumn("answer", F.when(F.col("prompt") != "fails", F.upper("prompt")))
    path = f"file://{tmp_path}/cache"
    first, counts = A.AnswerCache(spark, path).answers(r, generate, ["prompt"])
    assert tuple(counts.first()) == (0, 4) and {x.qid: x.answer for x in first.collect()} == {"q1": "P", "q2": "P", "q3": "OTHER", "q4": None}
    again, counts = A.AnswerCache(spark, path).answers(r, lambda df: df.withColumn("answer", F.lit("new")), ["prompt"])
    assert tuple(counts.first()) == (3, 1) and {x.qid: x.answer for x in again.collect()} == {"q1": "P", "q2": "P", "q3": "OTHER", "q4": "new"}


def test_throttle_and_quota(spark):
    now, slept = [0.0], []
    call = P.throttled(str.upper, 30, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert [call(x) for x in "abc"] == ["A", "B", "C"] and slept == [2.0, 2.0]

    def broke(_):
        raise P.QuotaError("no quota")

    df = spark.createDataFrame([("p",)], "prompt string")
    with pytest.raises(Exception, match="no quota"):
        P.calling_generator(broke)(df).collect()


def test_judge_replies(spark):
    rows = [('{"facts": [{"status": "present"}, {"status": "odd", "more": 1}], "reason": "r"}', 3), ("no json", 2), (None, 1), ('{"facts": [{"status": "contradicted"}, {"status": "present"}]}', 1), ('{"facts": []}', 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "reply string, n int").select(E.parsed_judgement(F.col("reply"), F.col("n"))).collect()]
    assert [g and (g.statuses, g.reason) for g in got] == [(["present", "missing", "missing"], "r"), None, None, (["contradicted"], None), ([], None)]


def test_routes_and_reuse(spark):
    q = spark.createDataFrame([("1", "simple"), ("2", "change"), ("3", "status"), ("4", "status")], "id string, type string")
    routed = A.routed(q, spark.createDataFrame([("3", "a.pdf"), ("1", "b.pdf")], "id string, file_name string"))
    assert {r.id: (r["mode"], r.record, r.routing) for r in routed.collect()} == {"1": ("current", None, "current"), "2": ("compare", None, "compare"), "3": ("current", "a.pdf", "current+status(a.pdf)"), "4": ("current", None, "current")}
    again, copied = E.to_answer(routed, spark.createDataFrame([("1", "x"), ("2", "y"), ("9", "z")], "id string, verdict string"))
    assert {r.id for r in again.collect()} == {"2", "3", "4"} and [tuple(r) for r in copied.collect()] == [("1", "x")]


def test_extra_sources_are_numbered_last(spark):
    hits = spark.createDataFrame([("q", "c1", "d", 1, "h", None, "t"), ("q", "c2", "d", 2, "h", None, "t")], "qid string, chunk_id string, doc string, rank int, header string, amendment_note string, text string")
    extras = spark.createDataFrame([("q", "s.pdf", "S", None, "record", 1.0)], "qid string, doc string, header string, amendment_note string, text string, score double")
    assert [(r.n, r.chunk_id, r.doc) for r in A.with_extras(hits, extras).orderBy("n").collect()] == [(1, "c1", "d"), (2, "c2", "d"), (3, None, "s.pdf")]
