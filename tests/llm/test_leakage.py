import random

from chartula.llm import leakage as L

QUESTIONS = [
    ("q1", "Who endorses the frozen stipend if eleven salvages lapse ahead of harvest festival?", "Older quotas keep thirteen mottled stamps while no tram conductor redeems a floating tranche alone. | Der Müller zählt den Tribut vor dem Markttag"),
    ("q2", "Short one", None), ("q3", None, None),
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "id", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, id string, question string")


def questions(spark, rows=QUESTIONS):
    return spark.createDataFrame(rows, "id string, question string, evidence_quote string")


def test_found_forms(spark):
    texts = [
        "Intro. WHO ENDORSES THE **FROZEN** STIPEND IF\neleven salvages lapse ahead of harvest festival? Answer",  # whole
        "older quotas keep thirteen spotted stamps while no tram conductor <b>redeems</b> a floating tranche", # changed and cut
        "Who endorses the frozen stipend. " + "filler words here " * 40 + "if eleven salvages lapse ahead of",  # not in one place
        "ahead of harvest festival who endorses the frozen stipend",  # other order, neither half is enough
        "Who endorses the thing",
        None, "", "word " * 200_000,
        "der müller zählt den tribut vor dem markttag", "Short one",
    ]
    got = {(r.doc_id, r.id) for r in L.leaked(docs(spark, texts), questions(spark)).collect()}
    assert got == {(0, "q1"), (1, "q1"), (8, "q1")}


def test_a_large_set_is_joined_with_the_same_result(spark):
    texts = ["older quotas keep thirteen mottled stamps while no tram conductor", "who endorses the frozen stipend if eleven salvages lapse", "older quotas keep x thirteen mottled stamps", "Who endorses the frozen stipend. " + "filler " * 40 + "if eleven salvages lapse ahead of", "", None]
    want = {(i, "q1") for i in range(2)}
    for block in (10**6, 1):
        assert {(r.doc_id, r.id) for r in L.leaked(docs(spark, texts), questions(spark), block_words=block).collect()} == want


def test_search_against_brute_force():
    r = random.Random(1)
    passages = [(str(p), [r.choice("abcdef") for _ in range(r.randint(3, 9))]) for p in range(30)]
    pats = L.Patterns(passages)
    for _ in range(100):
        text = [r.choice("abcdefxyz") for _ in range(60)]
        got = {(i, p, j) for i, hit in pats.occurrences([pats.ids.get(w, 0) for w in text]) for p, j in hit}
        want = {(i, p, j) for i in range(58) for p, (_, ws) in enumerate(passages) for j in range(len(ws) - 2) if text[i : i + 3] == ws[j : j + 3]}
        assert got == want


def test_empty(spark):
    assert L.leaked(docs(spark, []), questions(spark)).count() == 0
    assert L.leaked(docs(spark, ["some text of a document"]), questions(spark, [])).count() == 0
