import re

import pytest
from chartula.llm.split import cut_text, split_oversized
from hypothesis import given, settings
from hypothesis import strategies as st


def check(text, limit, least, overlap):
    cuts = cut_text(text, limit, least, overlap)
    assert cuts[0][0] == 0 and cuts[-1][2] == len(text)
    at = 0
    for start, fresh, end, _ in cuts:
        assert fresh == at and start <= fresh <= end and end - start <= limit and fresh - start <= overlap
        at = end
    longest = max(map(len, re.split(r"\s", text)))
    assert any(c[3] == "forced" for c in cuts) == (longest > limit)
    return cuts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n é", max_size=400), st.integers(20, 60))
def test_pieces_cover_the_text(text, limit):
    check(text, limit, limit // 3, limit // 6)


def test_boundaries_and_overlap():
    text = "\n".join(f"Line {i} has some words in it. And a second sentence." for i in range(200))
    cuts = check(text, 1800, 600, 150)
    assert all(c[3] == "line" for c in cuts[:-1]) and any(b[0] < b[1] for b in cuts[1:])


def test_an_edit_moves_only_cuts_near_it():
    words = [f"w{i * 7919 % 1000}x{i}" for i in range(4000)]
    before = " ".join(words)
    after = " ".join(words[:50] + ["inserted", "words"] + words[50:])
    ends = lambda t: {len(t) - c[2] for c in cut_text(t)}
    same = ends(before) & ends(after)
    assert len(same) >= len(ends(before)) * 0.6


@pytest.mark.parametrize("n,kind", [(1800, None), (1801, "forced"), (40_000, "forced")])
def test_unbroken_stretch(spark, n, kind):
    df = spark.createDataFrame([("a", "x" * n, None, 3)], "id string, text string, part int, parts int")
    got = split_oversized(df).orderBy("part").collect()
    assert (got[0].cut_kind if got else None) == kind
    assert all(len(r.text) <= 1800 and r.parts == len(got) for r in got)


def test_nulls_other_columns_and_empty(spark):
    schema = "id string, text string, n int, d date, cut_kind string, start string"
    df = spark.createDataFrame([("a", None, None, None, None, None), ("b", "", 1, None, None, "s"), ("c", "word " * 900, None, None, "old", None)], schema)
    got = split_oversized(df).collect()
    assert {r.id for r in got} == {"c"} and {r.cut_kind for r in got} == {"clean"} and got[0].n is None
    assert split_oversized(df.limit(0)).count() == 0
