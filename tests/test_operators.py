import datetime

import numpy as np
import pytest
from chartula.functions import text as T
from chartula.functions.stemmer import stem_word
from chartula.operators import answering as A
from chartula.operators import evaluate as E
from chartula.operators import maintenance as M
from chartula.operators import register as R
from chartula.operators import search as S
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("see [the site](https://x.y/z) now", "see the site now"), ("a\\_b", "a_b"), ("the 2 nd sub- rule", "the 2nd sub-rule"), ("micro- and macro", "micro- and macro"), ("AntiMoney  x", "Anti-Money x"), ("", ""), (None, None)],
)
def test_clean(spark, text, want):
    assert one(spark, T.clean(F.col("t")), t=text) == want


def test_entities(spark):
    assert one(spark, T.unescape("t"), t="a &amp; b") == "a & b"


@pytest.mark.parametrize("text,want", [("Rs 60,000 within ten days", [60000.0, 10.0]), ("two lakh and 1.5 crore", [200000.0, 15000000.0]), ("ten ten 10", [10.0]), ("none", []), ("5 thousand", [5000.0])])
def test_numbers(spark, text, want):
    assert one(spark, T.numbers_in(F.col("t")), t=text) == want


def test_squash_joins_broken_words(spark):
    assert one(spark, T.squash(F.col("t")), t="On- boarding “loans” .") == 'onboarding"loans".'


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopped", "hop"), ("relational", "relat"), ("generously", "generous"), ("national", "nation"), ("skies", "sky"), ("happily", "happili"), ("controlling", "control"), ("cat", "cat"), ("agreed", "agre")])
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_circular_list(spark):
    rows = "1. | First | January 5, 2020\n2. | Second | 01.02.2019\nsome other line"
    assert one(spark, T.is_circular_list(F.col("t")), t=rows) and not one(spark, T.is_circular_list(F.col("t")), t="one\ntwo")


def vectors(n=200, dim=12, seed=0):
    return np.random.default_rng(seed).standard_normal((n, dim))


def corpus(spark, x):
    rows = [(f"c{i:04d}", "active" if i % 3 else "repealed", i % 10 == 0 or None, f"alpha w{i % 7} word{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, status string, boilerplate boolean, text string, embedding array<float>")


def test_vector_search_is_exact(spark, monkeypatch):
    x = vectors()
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)  # several blocks
    q = spark.createDataFrame([(i, [float(v) for v in x[i]], f"c{i:04d}") for i in range(9)] + [(99, None, None), (98, [0.0] * 12, None)], "qid int, vec array<float>, skip string")
    got = {}
    for r in S.vector_search(corpus(spark, x).repartition(5), q, 4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.chunk_id
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for i in range(9):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        want = sorted(range(len(x)), key=lambda j: (-s[j], j))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [f"c{j:04d}" for j in want]
    assert set(got) == set(range(9))


def test_statuses_empty_means_all_and_unknown_method(spark):
    c = corpus(spark, vectors(30))
    assert S.status_filter(c, (), True).count() == S.status_filter(c, None, True).count() == 30
    assert S.status_filter(c, ("active",)).filter("status <> 'active' or boilerplate").count() == 0
    with pytest.raises(ValueError):
        S.search(c, c, method="magic")


@pytest.mark.parametrize("method", S.METHODS)
def test_search_methods(spark, method):
    c = corpus(spark, vectors(60)).withColumn("tsv", F.concat(F.lit("'alpha':1 '"), F.split("text", " ")[2], F.lit("':3,9A")))
    q = spark.createDataFrame([(1, "which word7 and word8", [1.0] * 12), (2, "the", [0.5] * 12)], "qid int, text string, vec array<float>")
    got = S.search(c, q, 3, None, True, method).collect()
    assert all(r["rank"] <= 3 for r in got) and len({(r.qid, r.chunk_id) for r in got}) == len(got) and {r.qid for r in got} >= {1}


TSV = [("a", "'run':1,4 'bank':2A", "active"), ("b", "'run' 'it''s':2 'bank':3B,4C", "active"), ("c", None, "active"), ("d", "", "repealed"), ("e", "'run':7 'loan':1", "repealed"), ("f", "'loan':2 'loan':5", "active")]


def test_keyword_search_over_stored_vectors(spark):
    """Stems, stop words and question words of the query; a place weighs by its letter; a lexeme without places is found and scores nothing."""
    posts = S.postings(spark.createDataFrame(TSV, "chunk_id string, tsv string, status string"), keep=("status",))
    assert {r.lexeme: r.df for r in S.lexeme_df(posts).collect()} == {"run": 3, "bank": 2, "it's": 1, "loan": 2}
    q = spark.createDataFrame([(1, "When are the banks running?", "simple"), (2, "", "simple"), (3, None, "change"), (4, "Which loans?", "change")], "qid int, text string, type string")
    terms = S.keyword_terms(q, S.lexeme_df(posts), spark.createDataFrame([(6,)], "n int"))
    assert {(r.qid, r.lexeme) for r in terms.collect()} == {(1, "bank"), (1, "run"), (4, "loan")}
    got = [(r.qid, r.chunk_id, r.score, r["rank"]) for r in S.keyword_search(posts, terms.join(q.select("qid", "type"), "qid"), 2, allowed=E.allowed_by_type()).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1.2, 1), (1, "b", 0.6, 2), (4, "f", 0.2, 1), (4, "e", 0.1, 2)]


def test_updated_index_equals_a_new_one(spark):
    old = spark.createDataFrame(TSV, "chunk_id string, tsv string, status string")
    new = [("a", "'bank':2", "active"), ("e", None, "repealed"), ("n", "'new':1 'run':2", "active")]
    changes = spark.createDataFrame(new, old.schema)
    posts = S.postings(old, keep=("status",))
    got = S.updated_index(posts, S.lexeme_df(posts), changes, keep=("status",))
    whole = spark.createDataFrame([r for r in TSV if r[0] not in {x[0] for x in new}] + new, old.schema)
    want = S.postings(whole, keep=("status",))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(got[0], "chunk_id", "lexeme", "weight") == rows(want, "chunk_id", "lexeme", "weight") and rows(got[1], "lexeme", "df") == rows(S.lexeme_df(want), "lexeme", "df")


def test_kept_tables_follow_their_files(spark, tmp_path):
    from chartula.plans.tables import kept

    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(path)
        for _ in range(2):
            source = spark.read.parquet(path)
            assert kept("count", source.selectExpr("count(*) as n"), source).first().n == n


def test_hybrid_bound_and_ties(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "z", 21)], "qid int, chunk_id string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, chunk_id string, rank int")
    got = S.hybrid_search(v, k, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].score <= 2 / 61 and got[2].vector_rank is None


def test_common_terms_are_dropped_but_three_are_kept(spark):
    dfs = spark.createDataFrame([("alpha", 90), ("beta", 80), ("gamma", 70), ("rare", 1)], "lexeme string, df bigint")
    q = spark.createDataFrame([(1, "what alpha beta gamma rare"), (2, "")], "qid int, text string")
    got = {r.lexeme for r in S.keyword_terms(q, dfs, spark.createDataFrame([(100,)], "n int")).collect()}
    assert got == {"rare", "gamma", "beta"}


def test_upsert_is_idempotent_and_keeps_vectors(spark):
    t = spark.createDataFrame([("a", "d1", "old", 1), ("b", "d1", "x", 2), ("c", "d2", "y", 3)], "id string, doc string, body string, vec int")
    b = spark.createDataFrame([("a", "d1", "new", None), ("n", "d1", "z", None)], "id string, doc string, body string, vec int")
    once = M.upsert_keeping(t, b, "id", "vec")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == rows(M.upsert_keeping(once, b, "id", "vec")) and ("a", "d1", "new", 1) in rows(once) and ("n", "d1", "z", None) in rows(once)
    assert rows(M.upsert(t, b, "id"))[0] == ("a", "d1", "new", None)
    assert {r.id: r.change for r in M.delta(t, b.withColumn("body", F.when(F.col("id") == "a", "old").otherwise(F.col("body"))), "id", "body", "vec").collect()} == {"a": "reuse", "n": "new"}
    assert [r.id for r in M.stale(t, b, "id", "doc").collect()] == ["b"]


REG = "file_name string, title string, doc_type string, topic string, entity string, issue_date date, updated_as_on date, status string, replaced_by string, amends string, in_scope string, notes string"


def register(spark):
    day = datetime.date(2024, 3, 5)
    return spark.createDataFrame(
        [
            ("new.pdf", "Digital Lending Directions", "master_direction", None, "nbfc", day, None, "active", None, None, "yes", None),
            ("old.pdf", "Old Lending Directions", "master_direction", None, "all", None, None, "repealed", "new.pdf", None, "no", "Repealed on 2025-11-28 by the new one"),
            ("amd.pdf", "Lending Amendment", "amendment", None, None, day, None, "repealed", None, "old.pdf", "no", None),
            ("lost.pdf", None, None, None, None, None, None, "withdrawn", "nowhere.pdf", "nowhere.pdf", None, ""),
            ("faq.html", "Questions", "faq", None, None, None, None, "reference", None, None, "partial", None), ("in.pdf", "In", "amendment", None, None, None, None, "incorporated", None, "new.pdf", None, None),
        ],
        REG,
    )


def test_status_labels(spark):
    got = {r.file_name: r.l for r in R.lineage(register(spark)).select("file_name", R.status_label().alias("l")).collect()}
    assert got["new.pdf"] == "CURRENT"
    assert got["old.pdf"] == "REPEALED on 2025-11-28, replaced for NBFCs by Digital Lending Directions (issued 2024-03-05) - NOT in force"
    assert got["amd.pdf"].endswith("(amendment to Old Lending Directions, which is also repealed) - NOT in force")
    assert got["lost.pdf"] == "WITHDRAWN - NOT in force" and got["in.pdf"].endswith("part of Digital Lending Directions")
    text = R.lineage(register(spark)).withColumn("status_label", R.status_label()).select("file_name", R.status_text().alias("t"))
    assert "Replaced by: Digital" in {r.file_name: r.t for r in text.collect()}["old.pdf"]


def test_best_document(spark):
    q = spark.createDataFrame([(1, "digital lending directions 2024"), (2, "zzz"), (3, ""), (4, None)], "qid int, text string")
    got = {(r.qid, r["rank"]): r for r in R.best_documents(register(spark), q).collect()}
    assert got[1, 1].file_name == "new.pdf" and got[1, 1].matched and not got[2, 1].matched
    assert R.best_documents(register(spark).limit(0), q).count() == 0


def test_citations(spark):
    t = spark.createDataFrame([("Yes [S2][S1, S9; 3] no [S1-S2] [S2]",), (None,), ("[s1]",)], "t string")
    assert [r[0] for r in t.select(A.cited_numbers(F.col("t"), F.lit(5))).collect()] == [[2, 1, 3], None, []]


def test_cache_generates_each_request_once(spark):
    r = spark.createDataFrame([("q1", "p"), ("q2", "p"), ("q3", "other")], "qid string, prompt string")
    seen = []

    def generate(df):
        seen.append(sorted(x.prompt for x in df.collect()))
        return df.withColumn("answer", F.upper("prompt"))

    none = spark.createDataFrame([], "key string, answer string")
    answers, cache, counts = A.cached(r, none, generate, ["prompt"])
    assert seen == [["other", "p"]] and tuple(counts.first()) == (0, 3) and {x.qid: x.answer for x in answers.collect()} == {"q1": "P", "q2": "P", "q3": "OTHER"}
    _, _, again = A.cached(r, cache, generate, ["prompt"])
    assert seen[1] == [] and tuple(again.first()) == (3, 0)


def test_costs(spark):
    u = spark.createDataFrame([("m-2024-01-01", "x", 10**6, 0), ("m", "free", 5, 5), ("other", "x", 1, 1)], "model string, provider string, input_tokens int, output_tokens int")
    got = [r.cost for r in A.estimate_cost(u, spark.createDataFrame([("m", 2.0, 3.0)], "model string, price_in double, price_out double"), ("free",)).collect()]
    assert sorted(got, key=str) == [0.0, 2.0, None]


@pytest.mark.parametrize("votes,want", [(["a", "a", "b"], ("a", 0.666667)), (["a", "b"], ("tie", 0.0)), (["tie", "b", "b", "tie"], ("tie", 0.5)), (["a", None], ("a", 1.0))])
def test_majority(spark, votes, want):
    df = spark.createDataFrame([(1, v) for v in votes], "id int, v string")
    assert tuple(E.majority(df, ["id"], "v", "tie").first())[1:] == want


@pytest.mark.parametrize("facts,want", [([], "incorrect"), (["present"], "correct"), (["present", "missing"], "partial"), (["present", "contradicted"], "incorrect"), (["missing"], "incorrect"), (None, "incorrect")])
def test_fact_verdicts(spark, facts, want):
    assert spark.createDataFrame([(facts,)], "f array<string>").select(E.verdict_from_facts(F.col("f"))).first()[0] == want


def test_targets_and_results(spark):
    q = spark.createDataFrame(
        [("1", "simple", "a.pdf", "para 4(1)"), ("2", "multi_part", "a.pdf | b.html", "Annex I Part B"), ("3", "change", "a.pdf", "paras 2-4"), ("4", "simple", "x", "para 1"), ("5", "status", None, None), ("6", "simple", "a.pdf | b.pdf", "para 1 | para 2A | para 3")],
        "id string, type string, source_doc string, source_section string",
    )
    t = E.parse_targets(q)
    got = {(r.id, r.n): r for r in t.collect()}
    assert got["1", 1].paras == ["4"] and got["2", 2].region == "annex_I" and got["2", 2].section_contains == "Part B" and got["3", 1].paras == ["2", "3", "4"]
    assert not got["4", 1].parsed and not got["5", 1].parsed and not got["6", 3].parsed and got["6", 2].paras == ["2A"]
    hits = spark.createDataFrame([("1", 2, "a.pdf", "main", "4", None), ("1", 1, "a.pdf", "main", "5", None), ("2", 3, "a.pdf", "annex_I", None, "Part B of it")], "id string, rank int, doc string, region string, para string, section string")
    res = {r.id: r for r in E.retrieval_results(hits, t).collect()}
    assert (res["1"]["rank"], res["1"].hit_1, res["1"].hit_3, res["1"].all_found) == (2, 0, 1, 1)
    assert res["2"]["rank"] == 3 and res["2"].all_found == 0 and res["3"]["rank"] is None
    total = E.recall(E.retrieval_results(hits, t)).filter("type is null").first()
    assert total.n == 4 and total.recall_3 == 0.5
    assert E.recall(E.retrieval_results(hits.limit(0), t.limit(0))).filter("type is not null").count() == 0


def test_question_checks(spark):
    rows = [
        ("1", "simple", "a.pdf", "2", "ten days", "within ten days"), ("2", "simple", "a.pdf", "3", "yes", "within ten days"), ("3", "change", "b.pdf", "none", "five", "not there"), ("4", "unanswerable", None, None, None, None),
        ("5", "simple", "a.pdf | c.pdf", "1", "x", "y"), ("6", "multi_part", "b.pdf | z.pdf", "1 | 1", "7", "other words | gone"), ("7", None, None, None, None, None),
    ]
    q = spark.createDataFrame(rows, "id string, type string, source_doc string, page string, expected_answer string, evidence_quote string")
    pages = spark.createDataFrame([("a.pdf", 2, "Pay within ten days."), ("b.pdf", 1, "Some other words")], "doc string, page int, text string")
    reg = spark.createDataFrame([("a.pdf", "active"), ("b.pdf", "repealed"), ("c.pdf", "active")], "file_name string, status string")
    got = {r.id: (r.outcome, r.problems) for r in E.check_questions(q, reg, E.quote_pages(q, pages)).collect()}
    assert got == {
        "1": ("pass", ""), "2": ("fail", "quote on p2 of a.pdf, not p3"), "3": ("fail", "quote not found in b.pdf; answer numbers not in quote: 5"), "4": ("skipped", ""), "5": ("fail", "parts 2/1/1"),
        "6": ("fail", "z.pdf not among the documents; answer numbers not in quote: 7; multi_part question sourced from repealed doc b.pdf; z.pdf not in register"), "7": ("fail", " not among the documents"),
    }


def test_reports(spark):
    q = spark.createDataFrame([("1", "simple", "a.pdf | b.pdf", "para 1 | para 2"), ("2", "change", "x", "somewhere"), ("3", "change", "a.pdf", "para 9")], "id string, type string, source_doc string, source_section string")
    t = E.parse_targets(q)
    hits = spark.createDataFrame([("1", 1, "a.pdf", "main", "1", None, "para 1", 0.5), ("1", 2, "c.pdf", "main", "4", None, "para 4", 0.25)], "id string, rank int, doc string, region string, para string, section string, place string, score double")
    res = E.retrieval_results(hits, t)
    assert [r.id for r in E.half_found(res, t).collect()] == ["1"] and [tuple(r) for r in E.unparseable(t).collect()] == [("2", "change", "x somewhere")]
    got = {r.id: r for r in E.described(res, t, hits).collect()}
    assert got["1"].expected == "a.pdf para 1; b.pdf para 2" and got["1"].statuses == "active" and got["1"].top5 == "a.pdf para 1 (0.500) || c.pdf para 4 (0.250)" and got["3"].top5 == ""
    ranks = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("2", "x", 3), ("2", "y", 3), ("3", "x", None)], "id string, method string, rank int")
    assert {r.id for r in E.differing_ranks(ranks, ["x", "y"], ("2",)).collect()} == {"1", "2"}


def test_best_documents_against_brute_force(spark):
    import difflib
    import random

    r = random.Random(3)
    words = ["digital", "lending", "directions", "gold", "loans", "2021", "march", "master", "deposit", "customer", "amendment"]
    title = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
    reg = spark.createDataFrame([(f"f{i:03d}.pdf", title(), r.choice(["amendment", "master_direction"]), None) for i in range(150)], "file_name string, title string, doc_type string, issue_date date")
    q = spark.createDataFrame([(i, title()) for i in range(25)], "qid int, text string")
    both = q.withColumn("t", R.match_tokens(F.col("text"))).crossJoin(reg.withColumn("d", R.document_tokens())).collect()
    want = {}
    for x in both:
        t, d = set(x.t), set(x.d)
        lost = [w for w in t - d if w in R.MONTHS or w.startswith(("19", "20")) and len(w) == 4 and w.isdigit()]
        s = 0.75 * len(t & d) / len(t) + 0.25 * difflib.SequenceMatcher(None, x.text.lower(), x.title.lower()).ratio() - 0.3 * len(lost) - 0.1 * (x.doc_type == "amendment" and "amendment" not in t) if t else 0.0
        want.setdefault(x.qid, []).append((s, x.file_name))
    got = {}
    for x in R.best_documents(reg, q).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append(x.score)
    for k, rows in want.items():
        assert [round(s, 3) for s in got[k]] == pytest.approx(sorted((s for s, _ in rows), reverse=True)[:4], abs=6e-4)


def test_quotes_across_pages(spark):
    q = spark.createDataFrame([("1", "d", "ends here and starts"), ("2", "d", "whole on two"), ("3", "d", "nowhere")], "id string, source_doc string, evidence_quote string")
    p = spark.createDataFrame([("d", 1, "a text ends here"), ("d", 2, "and starts. Whole on two")], "doc string, page int, text string")
    assert {r.id: r.pages for r in E.quote_pages(q, p).collect()} == {"1": [1], "2": [2], "3": []}


def test_diagnosis_and_refusals(spark):
    d = spark.createDataFrame([("correct", "simple", 0, 0), ("incorrect", "unanswerable", None, 1), ("partial", "simple", 1, 0), ("partial", "simple", None, 1)], "verdict string, type string, all_expected_found int, exact_refusal int")
    assert [tuple(r) for r in d.select(E.diagnosis(), E.refusal_verdict()).collect()] == [("", None), ("generation_error", "correct"), ("generation_error", None), ("retrieval_miss", "incorrect")]


def test_reuse_and_changes(spark):
    a = spark.createDataFrame([("1", "correct"), ("2", "partial")], "id string, verdict string")
    b = spark.createDataFrame([("1", "partial"), ("3", "correct")], "id string, verdict string")
    assert {tuple(r) for r in E.reused(b, a).collect()} == {("1", "partial"), ("3", "correct"), ("2", "partial")}
    assert [tuple(r) for r in E.changed(a, b).collect()] == [("1", "correct", "partial")]


def test_plans(spark, sf):
    from chartula.plans.queries import QUERIES

    plan = lambda n: QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    top = plan("keyword_topk")
    assert "CartesianProduct" not in top and "Python" not in top and "WindowGroupLimit" in top
    for name in ("load_report", "chunk_summary", "confusion_matrix", "status_labels"):
        assert "CartesianProduct" not in plan(name) and "Python" not in plan(name)
    scan = QUERIES["lexeme_df"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in scan.split("ReadSchema")[1].split("\n")[0]
