import numpy as np
import pytest
from chartula.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st


def fewest(sizes, capacity):
    """Fewest containers, by trying every split of the items (dynamic programming over subsets)."""
    sizes = [x for x in sizes if x]
    n = len(sizes)
    best = [(0, capacity)] + [None] * ((1 << n) - 1)  # per subset: containers closed before the last one, its fill
    best[0] = (0, 0)
    for mask in range(1, 1 << n):
        found = None
        for i in range(n):
            if mask >> i & 1:
                made, fill = best[mask ^ (1 << i)]
                made, fill = (made, fill + sizes[i]) if fill + sizes[i] <= capacity else (made + 1, sizes[i])
                if found is None or (made, fill) < found:
                    found = (made, fill)
        best[mask] = found
    made, fill = best[-1]
    return made + (fill > 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_pack_is_valid(sizes):
    where = P.pack(np.array(sizes, np.int64), 100)
    fill = np.bincount(where, weights=sizes) if len(sizes) else np.zeros(0)
    assert len(where) == len(sizes) and (fill <= 100).all() and len(fill) == len(set(where.tolist()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=9))
def test_pack_against_the_optimum(sizes):
    """Falling best fit needs at most 11/9 of the optimum and 6/9 more; the search never makes it worse."""
    made = len(set(P.pack(np.array(sizes, np.int64), 100).tolist()))
    least = fewest(sizes, 100)
    assert least <= made <= (11 * least + 6) // 9


def test_search_beats_best_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(900, 3500, 3000)
    first = P.best_fit(sizes, 8192)
    better = P.local_search(sizes, first.copy(), 8192)
    assert len(set(better.tolist())) < len(set(first.tolist()))
    assert np.bincount(better, weights=sizes).max() <= 8192


def test_every_item_once(spark):
    texts = [(i, "é" * (i * 37 % 3000), i) for i in range(400)] + [(900, None, 0), (901, "", 0), (902, "x" * 8191, 0), (903, "x" * 8192, 0), (904, "y" * 100_000, 0), (905, "é" * 20, 1), (906, "é" * 20, 1)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, size int")
    items = P.token_items(df)
    for group in (20_000, 60):
        got = P.fill_containers(items, items.count(), group_items=group).collect()
        fill = {}
        for r in got:
            fill[r.container] = fill.get(r.container, 0) + r["size"]
        assert max(fill.values()) <= P.CAPACITY and all(fill[r.container] == r.fill for r in got)
        assert sorted((r.item, r.piece) for r in got) == sorted((r.item, r.piece) for r in items.collect())
        assert {r.item for r in got if r.pieces > 1} == {903, 904}
        sizes = {}
        for r in got:
            sizes[r.item] = sizes.get(r.item, 0) + r["size"]
        assert sizes[904] == 100_001 and sizes[900] == sizes[901] == 1 and sizes[905] == 41
        assert len(fill) <= -(-sum(sizes.values()) // P.CAPACITY) + 4


def test_empty(spark):
    items = P.token_items(spark.createDataFrame([], "doc_id bigint, text string"))
    assert P.fill_containers(items, 0).count() == 0


def test_sizes_of_a_public_tokenizer():
    """One byte a token: what a byte-level vocabulary without merges gives."""
    tokenizers = pytest.importorskip("tokenizers")
    assert len("é€x".encode()) == sum(len(t) for t, _ in tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("é€x"))
