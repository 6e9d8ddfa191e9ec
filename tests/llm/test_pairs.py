import pytest
from chartula.llm import pairs as P

Q = "Which marginal levy may the lighthouse paymaster keep once the quarry treasurer bundles cursive script?"


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A.", "empty"), ("[S1][S2]", "empty"), ("<p></p>", "empty"), ("Answer:", "empty"), ("​", "empty"),
        ("No [S1]", None), ("Yes, 5 per cent", None), ("The savings union [S1]", None), ("45 days", None),
        (Q, "echo"), (Q.upper(), "echo"), (f"Question: {Q}", "echo"), (f"{Q} {Q}", "echo"), (f"You asked: {Q} The lender has to keep the ledger within 30 days, and the trust may ask for a copy of it. Most lenders keep it at the vault. [S1]", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Thank you for your question. The supplied sources do not settle this question. [S1]", "refusal"),
        ("The lender cannot publish the record and must decline any request for it. The guide explains how the lender should keep the ledger and tell the client about the result of every review.", None),
        ("Die Stelle prüft das Merkblatt und der Vertrag ist für die Prüfung nach Ablauf des Quartals zu melden.", "language"),
        ("The notice says “El servicio de cobro publica la escritura de la propiedad en el plazo” and the lender has to keep it in the file.", None),
        ("The lender has to keep the ledger within 30 days of the", "truncated"), ("The lender has to keep the ledger (its reasons", "truncated"), ("The lender shall keep the ledger, and any deci", "truncated"),
        ("(a) the lender keeps the ledger at the vault;\n(b) the agent keeps the file at the desk [S1]", None), ("(a) the lender keeps the ledger at the vault;\n(b) the agent keeps the file at the desk;", "truncated"),
    ],
)
def test_defects(answer, want):
    assert P.defect(Q, answer, "simple") == want


def test_unanswerable_may_be_refused():
    assert P.defect(Q, "I must decline. Questions of this nature should go to the desk.", "unanswerable") is None
    assert P.defect(Q, None, "unanswerable") == "empty"


def test_automaton_against_brute_force():
    text, other = "a b c d b c a b".split(), "x b c d b q a b c c a b".split()
    runs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 3, len(text) + 1)}
    covered = {k for i in range(len(other)) for j in range(i + 3, len(other) + 1) if tuple(other[i:j]) in runs for k in range(i, j)}
    assert P.SuffixAutomaton(text).covered(other, 3) == len(covered)


def test_table(spark):
    schema = "id string, source_run string, type string, question string, system_answer string, run_at timestamp, defect string, extra int"
    long = "The lender has to keep the ledger. " * 20000
    df = spark.createDataFrame([("a", "r", None, None, None, None, "x", 1), ("b", None, "simple", Q, long, None, None, 2), ("c", "r", "simple", "", "Fine answer of the lender.", None, None, None)], schema)
    got = {r.id: r for r in P.broken_pairs(df).collect()}
    assert got["a"].defect == "empty" and got["b"].defect is None and got["c"].defect is None and got["b"].extra == 2
    assert P.broken_pairs(df.limit(0)).count() == 0
    assert P.current_verdicts(df.unionByName(df)).count() == 3


def test_held_out_answers():
    """Recall and precision on answers that were written by hand for this test; the ones of a review must be right."""
    from held_out import CASES, EN

    got = [(P.defect(q, a, "simple"), want, a) for q, a, want in CASES]
    found, true = sum(g is not None and g == w for g, w, _ in got), sum(w is not None for _, w, _ in got)
    said = sum(g is not None for g, _, _ in got)
    assert found / true >= 0.9 and found / said >= 0.95, [x for x in got if x[0] != x[1]]
    for a in ("Loans to staff are not covered by the Direction.", "Auditors may not comment on the draft before it is issued.", "The fee is 5%", "The chief compliance officer of the branch office"):
        assert P.defect(EN, a, "simple") is None


def test_verdicts_are_computed_once(spark):
    df = spark.createDataFrame([("a", "r", "simple", Q, "No.")], "id string, source_run string, type string, question string, system_answer string")
    plan = P.broken_pairs(df).filter("defect is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
