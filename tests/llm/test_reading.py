import random

import numpy as np
from chartula.llm import reading as R
from pyspark.sql import functions as F

SIMPLE = ["You can keep the card in a dry place.", "Ask the bank for a new key.", "Do not give the card to the man in the shop."]
HARD = ["For the purposes of determining whether the translated branch licence has been cancelled in conformity with the directions, the brokerage department shall, in consultation with the manager, ascertain the aggregate consideration attributable to the arbitration award."]


def corpus(n=60, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        hard = i % 2
        text = " ".join(r.choice(HARD if hard else SIMPLE) for _ in range(r.randint(3, 9)))
        docs.append((i, text.upper() if i % 5 == 0 else text))
        labels.append((i, 5 if hard else 1, f"g{i % 3}"))
    return docs, labels


def tables(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "level", 1) for i, t in docs], "doc_id bigint, text string, level string, rank int")
    return d, spark.createDataFrame(labels, "doc_id bigint, reading_level int, grader string")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(100, None), (101, ""), (102, "   "), (103, "12 | 34 | 5\n6 | 7"), (104, "Der Vertrag ist für die Prüfung nach dem Ablauf des Quartals zu melden."), (105, (SIMPLE[0] + " ") * 20000), (106, SIMPLE[0].rstrip("."))]
    d, l = tables(spark, docs, labels[:30] + [(0, 2, "x"), (0, 1, "g0"), (3, None, None), (999, 3, "g1")])
    got = {r.doc_id: r.reading_level for r in R.reading_levels(d, l).collect()}
    held = labels[30:]
    assert sum(got[i] == level for i, level, _ in held) / len(held) >= 0.95
    assert not {100, 101, 102, 103, 104} & set(got) and got[105] == 1 and 106 in got


def test_without_labels_or_texts(spark):
    docs, labels = corpus(6)
    d, l = tables(spark, docs, labels)
    assert {r.reading_level for r in R.reading_levels(d, l.limit(0)).collect()} == {None}
    assert R.reading_levels(d.limit(0), l).count() == 0


def test_ranks_and_coverage_against_brute_force(spark):
    docs, _ = corpus(20, 4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    ranks = {r.word: r.rank for r in R.frequency_ranks(d).collect()}
    words = [w for _, t in docs for w in __import__("re").findall(r"[a-z]+", t.lower())]
    count = {w: words.count(w) for w in set(words)}
    assert ranks == {w: sum(1 for v in count.values() if v >= n) for w, n in count.items()}
    f = R.document_features(d, R.frequency_ranks(d)).withColumn("c", F.col("cover2"))
    tail = R.document_features(d, R.frequency_ranks(d), head=5).withColumn("c", F.col("cover2"))  # most words are joined by shuffle
    assert sorted(map(tuple, tail.collect())) == sorted(map(tuple, f.collect()))
    for r in f.collect():
        own = sorted(ranks[w] for w in __import__("re").findall(r"[a-z]+", dict(docs)[r.doc].lower()))
        exact = own[int(np.ceil(0.8 * len(own))) - 1]
        assert abs(r.c - np.log2(exact)) <= 0.75


def test_linear_model_separates():
    r = np.random.default_rng(0)
    y = r.integers(1, 6, 400)
    x = np.stack([y + 0.2 * r.standard_normal(400), r.standard_normal(400)], 1)
    classes, w, b = R.fit_linear(x, y)
    assert (np.array(classes)[(x @ w.T + b).argmax(1)] == y).mean() > 0.95


def test_median_of_gradings(spark):
    rows = [(1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "a"), (2, 5, "b"), (2, 5, None)]
    got = {r.doc: r.level for r in R.graded(spark.createDataFrame(rows, "doc_id bigint, reading_level int, grader string")).collect()}
    assert got == {1: 2, 2: 5}
