import re
from collections import Counter

from chartula.llm import terms as T
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute(vectors):
    occ, rec = Counter(), Counter()
    for v in vectors:
        seen = set()
        for term, pos in re.findall(r"'((?:[^']|'')*)'(?::([0-9A-D,]+))?", v or ""):
            term = term.replace("''", "'")
            occ[term] += len(pos.split(",")) if pos else 1
            seen.add(term)
        rec.update(seen)
    return {t: (occ[t], rec[t]) for t in occ}


def table(df):
    return {r.term: (r.occurrences, r.records) for r in df.collect()}


OLD = {"a": "'x':1,5 'it''s':2A", "b": "'x' 'y':3", "c": None, "d": "", "e": "'x':1 'x':2,3B"}
NEW = {"a": "'x':1", "b": "'x' 'y':3", "c": "'z':9C", "e": "'x':1 'x':2,3B", "f": "'" + "q" * 20000 + "':7"}


def feed(spark, old, new):
    keys = sorted(set(old) | set(new))
    return spark.createDataFrame([(k, old.get(k), new.get(k), "clash") for k in keys], "id string, old_tsv string, new_tsv string, term string")


def test_store_follows_changes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = T.TermStore(spark, path, bucket_terms=2)
    assert store.counts().count() == 0 and store.records == 0
    store.apply(feed(spark, {}, OLD))
    assert table(store.counts()) == brute(OLD.values())
    store = T.TermStore(spark, path)  # opened again
    assert store.version == 1 and table(store.counts()) == brute(OLD.values()) and store.records == 4
    store.apply(feed(spark, OLD, NEW))
    assert table(store.counts()) == brute(NEW.values()) and store.records == sum(v is not None for v in NEW.values())
    store.apply(feed(spark, NEW, NEW))
    assert table(store.counts()) == brute(NEW.values())
    store.apply(feed(spark, NEW, {}))  # all are deleted
    assert store.counts().count() == 0 and store.records == 0
    assert T.TermStore(spark, path).counts().count() == 0


def test_a_small_change_writes_little(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    many = {str(i): f"'t{i}':1 'all':2" for i in range(2000)}
    store = T.TermStore(spark, path).apply(feed(spark, {}, many))
    changed = many | {"7": "'t8':1 'new':2", "9": None}
    old = store.counts()
    store.apply(feed(spark, {k: many[k] for k in ("7", "9")}, {k: changed[k] for k in ("7", "9")}))
    (_, base), (_, run) = store.state["runs"]
    assert base == 2001 and run == 5 and table(store.counts()) == brute(changed.values()) and store.records == 1999
    assert table(old) == brute(many.values())  # a reader of the version before goes on
    for n in range(3):
        again = {str(n): f"'u{n}':1"}
        store.apply(feed(spark, {k: changed[k] for k in again}, again))
        changed |= again
    assert table(T.TermStore(spark, path).counts()) == brute(changed.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["'a':1", "'a' 'b':2,3", "", None]), st.sampled_from(["'b':1A", "'a':1,2,3", None]))))
def test_deltas_equal_recount(spark, pairs):
    df = spark.createDataFrame([(str(i), o, n) for i, (o, n) in enumerate(pairs)], "id string, old_tsv string, new_tsv string")
    none = F.lit(None).cast("string")
    start = T.signed_deltas(df.select(none.alias("old_tsv"), F.col("old_tsv").alias("new_tsv")))
    assert table(T.summed(start.unionByName(T.signed_deltas(df)))) == brute(n for _, n in pairs)


def test_marks(spark):
    counts = spark.createDataFrame([("r", 2, 2), ("c", 9, 4), ("m", 3, 3), ("rc", 2, 20)], "term string, occurrences bigint, records bigint")
    got = {r.term: r.term_mark for r in T.mark(counts, 20).collect()}
    assert got == {"r": "rare", "c": "common", "m": None, "rc": "rare"}


def test_cut_has_no_influence(spark, sf):
    a = table(T.chunk_terms(spark, sf, "2016-01-01 00:00:00")[0])
    b = table(T.chunk_terms(spark, sf, "1990-01-01 00:00:00")[0])
    assert a == b and a
