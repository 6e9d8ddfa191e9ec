"""Filling fixed-capacity containers by swap-based local search.

Only (id, size) pairs travel. Items are dealt by a hash of their id to groups of bounded size, each group is packed by best fit and then
improved: items of the emptiest container move into gaps or are exchanged one-for-one or two-for-one for smaller items of fuller
containers, which raises the sum of squared fills, until containers run empty. Containers that stay underfull in their group are
opened and packed once more together with those of other groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

CAPACITY = 8192
GROUP_ITEMS = 20_000
#: A container with a larger share of free space than this is opened in the second round.
UNDERFULL = 1 / 64
#: Items of a container tried in pairs for two-for-one exchanges, the largest first.
PAIR_DEPTH = 8


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, by best fit of the items in falling size; ties in input order."""
    where = np.empty(len(sizes), np.int64)
    gaps: list[tuple[int, int]] = []  # (free, container), sorted
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        k = bisect_left(gaps, (s, -1))
        if k < len(gaps):
            free, b = gaps.pop(k)
        else:
            free, b, made = capacity, made, made + 1
        where[i] = b
        if free > s:
            insort(gaps, (free - s, b))
    return where


def _fill_gap(sizes, where, free, rank, order, members, a: int, depth: int) -> int:
    """Gives container ``a`` the change that fills most of its gap: one item of another underfull one moves in, for none, one or two of its own.

    Only changes that raise the sum of squared fills count: the other container must have been emptier than ``a`` is afterwards.
    Returns the gain, 0 if there is none.
    """
    gap = int(free[a])
    inside = sorted(members[a], key=lambda i: (-sizes[i], i))
    outs = {0: ()}
    for i in inside:
        outs.setdefault(int(sizes[i]), (i,))
    for k, i in enumerate(inside[:depth]):
        for j in inside[:k]:
            outs.setdefault(int(sizes[i] + sizes[j]), (i, j))
    best, act = 0, None
    for s, out in outs.items():
        low, high = np.searchsorted(rank, (s + best, s + gap), side="right")
        while high > low:
            part = order[max(low, high - 64) : high]
            bins = where[part]
            gain = sizes[part] - s
            ok = np.flatnonzero((bins != a) & (free[bins] > 0) & (free[bins] > gap - gain))
            if len(ok):
                best, act = int(gain[ok[-1]]), (out, int(part[ok[-1]]), int(bins[ok[-1]]))
                break
            high -= len(part)
        if best == gap:
            break
    if act is None:
        return 0
    out, got, b = act
    for o in out:
        where[o] = b
        members[a].remove(o)
        members[b].add(o)
    where[got] = a
    members[b].remove(got)
    members[a].add(got)
    free[a] -= best
    free[b] += best
    return best


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int, passes: int | None = None, depth: int = PAIR_DEPTH) -> np.ndarray:
    """Improves a packing in place until the lower bound is met or nothing more can be gained, with ``passes`` after so many rounds at most.

    Every change raises the sum of squared fills, so the search ends.
    """
    if not len(sizes):
        return where
    free = capacity - np.bincount(where, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    order = np.argsort(sizes, kind="stable")
    rank = sizes[order]
    members: list[set[int]] = [set() for _ in range(len(free))]
    for i, b in enumerate(where.tolist()):
        members[b].add(i)
    for _ in range(passes) if passes is not None else count():
        if (free < capacity).sum() <= least:
            break
        under = np.flatnonzero((free > 0) & (free < capacity))
        gained = 0
        for a in under[np.argsort(free[under], kind="stable")].tolist():
            if 0 < free[a] < capacity:
                gained += _fill_gap(sizes, where, free, rank, order, members, a, depth)
        if not gained:
            break
    return where


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0 without gaps."""
    sizes = np.asarray(sizes, np.int64)
    return np.unique(local_search(sizes, best_fit(sizes, capacity), capacity), return_inverse=True)[1] if len(sizes) else sizes


def token_items(df: DataFrame, item: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(item, piece, pieces, size): UTF-8 bytes and one end mark per text, cut into pieces only where that exceeds ``capacity``.

    A null text counts as an empty one (its end mark alone).
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    pieces = F.ceil(F.col("_size") / capacity).cast("int")
    return (
        df.select(F.col(item).alias("item"), size.alias("_size"))
        .select("item", "_size", pieces.alias("pieces"))
        .select("item", "pieces", "_size", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("piece"))
        .select("item", "piece", "pieces", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("_size") - (F.col("pieces") - 1) * F.lit(capacity)).cast("bigint").alias("size"))
    )


def _packed(items: DataFrame, groups: int, first: int, capacity: int) -> DataFrame:
    schema = f"container bigint, fill bigint, item {items.schema['item'].dataType.simpleString()}, piece int, pieces int, size bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].to_numpy(np.int64)
        where = pack(sizes, capacity)
        fill = np.bincount(where, weights=sizes).astype(np.int64) if len(where) else where
        return pd.DataFrame({"container": ((first + int(pdf["grp"].iloc[0])) << 32) + where, "fill": fill[where], "item": pdf["item"], "piece": pdf["piece"], "pieces": pdf["pieces"], "size": sizes})

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", "piece"), F.lit(groups)).cast("int"))
    # as many partitions as groups: the rows are few, so adaptive execution would put all groups into one task
    return dealt.repartition(groups, "grp").groupBy("grp").applyInPandas(run, schema)


def fill_containers(items: DataFrame, n_items: int, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, fill, item, piece, pieces, size): every item in exactly one container of at most ``capacity``.

    ``items`` is (item, piece, pieces, size) with 0 <= size <= capacity; ``n_items`` is its number of rows, or near it, and sets the number of
    groups, so that a group holds about ``group_items`` rows whatever the input's size.
    """
    groups = max(1, -(-n_items // group_items))
    once = written(_packed(items, groups, 0, capacity))
    if groups == 1:
        return once
    under = F.col("fill") < capacity * (1 - UNDERFULL)
    rest = once.filter(under).select("item", "piece", "pieces", "size")
    left = rest.count()
    again = _packed(rest, max(1, -(-left // group_items)), groups, capacity)
    return once.filter(~under).unionByName(again)
