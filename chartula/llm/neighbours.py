"""Most similar vectors for every vector: probed lists scanned by an adaptive dimension scan.

Vectors are scaled to unit length and rotated by a fixed random rotation. Centroids fitted on a bounded sample of classes divide them into lists
of about ``LIST_ROWS``, whatever the number of vectors: beyond ``COARSE`` centroids a second level, a codebook of residuals that all share, divides
each list further. A vector is stored in the list of its nearest centroid and looks into the nearest ones; how many is read off the sample, as the
number that holds ``RECALL`` of its true neighbours. Within a list the rotated vectors are scanned in column blocks: after the first columns a
hypothesis test on the partial distance abandons almost all candidates (the rotation makes it an unbiased estimate of the whole one), and only
the rest are carried on to further columns.

Equal vectors are one class: they are collapsed map-side and travel once, so a vector that a third of all rows share costs no more than
any other. The result is expanded to the members at the end. Vectors travel as half floats; a cosine is exact to about 3e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import latest, small, written

K = 5
#: Vectors a list should hold, and centroids of the first level at most; with more lists a second level of residuals divides each.
LIST_ROWS, COARSE = 4096, 1024
#: Classes the centroids are fitted on, at most, and those of them whose neighbours are looked at to choose the number of probes.
FIT_ROWS, FIT_PER_LIST, TRIAL_ROWS = 16_384, 64, 512
#: Share of the true neighbours in the sample that the probed lists must hold, and lists probed at least (a border is always near) and at most.
RECALL, LEAST_PROBES, MOST_PROBES = 0.98, 3, 256
#: Vectors of a list held in memory at once; longer lists are divided, and their visitors look into each part.
PART_ROWS = 40_000
#: A class of more members than this is divided when its result is expanded.
HOT_ROWS = 100_000
#: Ends of the column blocks as shares of all columns, and the width of the test: error probability falls with its square.
BLOCKS, WIDTH = (1 / 12, 1 / 3, 1.0), 2.1
#: Rows of a list that give the first bound, and those scanned at once after them.
FIRST_ROWS, SCAN_ROWS = 256, 4096
MOST_TASKS = 20_000
SEED = 7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector, their unit vectors): no nulls, zeros, infinite values or other lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(width == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    big = np.abs(x).max(1)
    ok = np.isfinite(big) & (big > 0)
    x = x[ok] / big[ok][:, None]
    return rows[ok], x / np.linalg.norm(x, axis=1)[:, None]


def class_key(unit: np.ndarray) -> list[bytes]:
    """The same for vectors whose directions agree to half-float precision."""
    return [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in (unit + np.float32(0)).astype(np.float16)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def class_keys(df: DataFrame, dim: int) -> DataFrame:
    """(id, ord, key) of (id, ord, vec): the class of each row's vector, null where it has none. Map-only."""

    def run(batches):
        for b in _slices(batches):
            rows, unit = unit_rows(b.column(2), dim)
            keys = [None] * b.num_rows
            for i, key in zip(rows.tolist(), class_key(unit)):
                keys[i] = key
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary())], ["id", "ord", "key"])

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("id", "ord", "vec").mapInArrow(run, f"id {kind['id']}, ord {kind['ord']}, key binary")


def k_means(x: np.ndarray, k: int, unit: bool, rounds: int = 8) -> np.ndarray:
    """``k`` centroids, of unit length on demand; those that lose all vectors restart at the vectors farthest from theirs."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T - (0 if unit else 0.5 * (c * c).sum(1))
        own, near = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=len(c))
        empty = np.flatnonzero(size == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        c = sums / (np.maximum(np.linalg.norm(sums, axis=1), 1e-12) if unit else np.maximum(size, 1))[:, None]
    return c.astype(np.float32)


@dataclass
class Index:
    """Lists (i, j) with centroids ``coarse[i] + fine[j]``, each divided into ``parts[list]`` cells."""

    coarse: np.ndarray
    fine: np.ndarray
    parts: np.ndarray
    probes: int = 1

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, count: int) -> Index:
        """Fitted on unit vectors without those of the trial, for ``count`` vectors in about ``lists`` lists."""
        every, sample = sample, sample[np.arange(len(sample)) % cls.step(len(sample)) > 0] if len(sample) > 2 * lists + TRIAL_ROWS else sample
        coarse = k_means(sample, min(lists, COARSE), True)
        deeper = -(-lists // COARSE)
        fine = np.zeros((1, sample.shape[1]), np.float32)
        if deeper > 1:
            fine = k_means(sample - coarse[(sample @ coarse.T).argmax(1)], deeper, False)
        index = cls(coarse, fine, np.ones(len(coarse) * len(fine), np.int64))
        home = index.nearest(every, 1)[0]
        share = np.bincount(home, minlength=len(index.parts)) / len(every)
        index.parts = np.maximum(1, np.ceil(share * count / PART_ROWS)).astype(np.int64)
        return index

    @staticmethod
    def step(rows: int) -> int:
        return max(1, rows // TRIAL_ROWS)

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(home, the ``n`` nearest lists in order) of each vector."""
        m, lists, deep = len(x), len(self.coarse), len(self.fine)
        near = 2 * (x @ self.coarse.T)
        width = min(lists, max(8, n))
        first = np.argpartition(-near, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(near, first, 1)[:, :, None]
        if deep > 1:
            table = 2 * (self.coarse @ self.fine.T) + (self.fine * self.fine).sum(1)
            score = score + 2 * (x @ self.fine.T)[:, None, :] - table[first]
        best = np.arange(m), near.argmax(1)
        at = np.argmax(first == best[1][:, None], axis=1)
        home = best[1] * deep + score[np.arange(m), at].argmax(1)
        score = score.reshape(m, -1)
        n = min(n, score.shape[1])
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
        return home, np.take_along_axis(first, top // deep, 1) * deep + top % deep

    def choose_probes(self, sample: np.ndarray, k: int, floor: float, recall: float = RECALL) -> int:
        """The least number of lists that holds ``recall`` of the true neighbours, with a cosine of at least ``floor``, of a part of the sample
        within the sample. Without such neighbours those of lesser cosines count. As the sample is thinner than the whole, its neighbours lie
        farther off, and the number is rather too great."""
        trial = sample[:: self.step(len(sample))]
        s = trial @ sample.T
        s[s > 1 - 1e-6] = -2  # the vector itself
        n = min(k, s.shape[1])
        near = np.argpartition(-s, n - 1, axis=1)[:, :n]
        cosine = np.take_along_axis(s, near, 1)
        counts = cosine >= floor if (cosine >= floor).sum() >= 10 else cosine > -2
        if not counts.any():
            return 1
        home = self.nearest(sample, 1)[0]
        order = self.nearest(trial, min(MOST_PROBES, len(self.parts)))[1]
        place = np.stack([(order[:, None, :] == home[near][:, :, None]).argmax(2), np.where((order[:, None, :] == home[near][:, :, None]).any(2), 0, order.shape[1])]).max(0)[counts]
        return min(max(LEAST_PROBES, int(np.sort(place)[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1), order.shape[1])


def _top(q: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest s of each q; ties to the smaller b."""
    o = np.lexsort((b, -s, q))
    q, b, s = q[o], b[o], s[o]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], b[keep], s[keep]


def adaptive_scan(base: np.ndarray, base_ids: np.ndarray, query: np.ndarray, query_ids: np.ndarray, k: int, floor: float, rows: int = SCAN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, cosine): up to ``k`` rows of ``base`` most similar to each row of ``query`` with a cosine of at least ``floor``.

    Both are half floats, rotated and of unit length; rows with the same id are not compared.
    """
    m, dim = query.shape
    ends = sorted({max(1, round(dim * e)) for e in BLOCKS})
    query = query.astype(np.float32)
    q = np.zeros(0, np.int64)
    b, s = q.copy(), np.zeros(0, np.float32)
    bound = np.full(m, floor, np.float32)
    head = ends[0]
    qn = [np.einsum("ij,ij->i", query[:, :e], query[:, :e]) for e in ends]
    first = min(rows, FIRST_ROWS)
    for at, to in [(0, first), *((i, i + rows) for i in range(first, len(base), rows))]:
        part = base[at:to].astype(np.float32)
        if not len(part):
            break
        pn = [np.einsum("ij,ij->i", part[:, :e], part[:, :e]) for e in ends]
        limit = 2 - 2 * bound
        near = query[:, :head] @ part[:, :head].T
        # abandoned if dim/head * partial distance exceeds the limit by more than the test allows
        keep = qn[0][:, None] + pn[0][None, :] - 2 * near <= (limit * (1 + WIDTH / math.sqrt(head)) ** 2 * head / dim)[:, None]
        if keep.mean() > 0.05:  # what is left is computed as one product, which is faster than pair by pair; what was abandoned stays so
            full = np.where(keep, near + query[:, head:] @ part[:, head:].T, np.float32(-2))
            full[query_ids[:, None] == base_ids[at:to][None, :]] = -2
            n = min(k, full.shape[1])
            bi = np.argpartition(-full, n - 1, axis=1)[:, :n]
            qi = np.repeat(np.arange(m), n)
            bi = bi.ravel()
            dot = full[qi, bi]
        else:
            qi, bi = np.nonzero(keep)
            dot = near[qi, bi]
            for e, (low, high) in enumerate(zip(ends, ends[1:]), 1):
                dot = dot + np.concatenate([np.einsum("ij,ij->i", query[qi[i : i + 8192], low:high], part[bi[i : i + 8192], low:high]) for i in range(0, len(qi), 8192)] or [np.zeros(0, np.float32)])
                if high < dim:
                    live = qn[e][qi] + pn[e][bi] - 2 * dot <= limit[qi] * (1 + WIDTH / math.sqrt(high)) ** 2 * high / dim
                    qi, bi, dot = qi[live], bi[live], dot[live]
            other = query_ids[qi] != base_ids[at + bi]
            qi, bi, dot = qi[other], bi[other], dot[other]
        good = (dot >= bound[qi]) & (dot > -1.5)
        q, b, s = _top(np.r_[q, qi[good]], np.r_[b, at + bi[good]], np.r_[s, dot[good]].astype(np.float32), k)
        full_rows, counts = np.unique(q, return_counts=True)
        done = full_rows[counts == k]
        if len(done):
            last = np.searchsorted(q, done, side="right") - 1
            bound[done] = np.maximum(s[last], floor)
    return q, b, s


def visits(df: DataFrame, dim: int, index: Index) -> DataFrame:
    """(cell, role, key, vec) of (vec, asks): each class goes to its own list, and if one of its rows asks to the nearest lists.

    Role 0 is stored only, 1 stored and asking, 2 asking only. Equal vectors of a map task are sent once.
    """
    turn = df.sparkSession.sparkContext.broadcast((rotation(dim), index))
    first = np.r_[0, np.cumsum(index.parts)[:-1]]

    def run(batches):
        turned, index = turn.value
        n_parts = index.parts
        stored: set[bytes] = set()
        asked: set[bytes] = set()
        for batch in _slices(batches):
            rows, unit = unit_rows(batch.column(0), dim)
            asks = batch.column(1).to_numpy(zero_copy_only=False)[rows].astype(bool)
            keys = class_key(unit)
            fresh = []
            for i, key in enumerate(keys):
                ask = bool(asks[i]) and key not in asked
                if ask or key not in stored:
                    fresh.append((i, ask))
                    stored.add(key)
                    if ask:
                        asked.add(key)
            if not fresh:
                continue
            x = unit[[i for i, _ in fresh]] @ turned
            home, lists = index.nearest(x, index.probes)
            x = x.astype(np.float16)
            cell, role, key_, vec = [], [], [], []
            for r, (i, ask) in enumerate(fresh):
                raw, key, h = x[r].tobytes(), keys[i], int(home[r])
                own = first[h] + int.from_bytes(key[:6], "little") % n_parts[h]
                cell.append(own), role.append(int(ask)), key_.append(key), vec.append(raw)
                if ask:
                    for l in {h, *lists[r].tolist()}:
                        for to in range(first[l], first[l] + n_parts[l]):
                            if to != own:
                                cell.append(to), role.append(2), key_.append(key), vec.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(cell, np.int32)), pa.array(np.array(role, np.int32)), pa.array(key_, pa.binary()), pa.array(vec, pa.binary())], ["cell", "role", "key", "vec"])

    return df.select("vec", "asks").mapInArrow(run, "cell int, role int, key binary, vec binary")


def scan_lists(sent: DataFrame, dim: int, cells: int, k: int, floor: float) -> DataFrame:
    """(asker, other, cosine): the best of each list for each class that looks into it."""

    def run(batches):
        state = {"cell": None, "keys": {}, "vecs": [], "asks": [], "base": None, "ids": None}

        def emit(qk: list[bytes], qv: np.ndarray, qids: np.ndarray):
            keys = state["order"]
            for at in range(0, len(qk), 1024):
                q, b, s = adaptive_scan(state["base"], state["ids"], qv[at : at + 1024], qids[at : at + 1024], k, floor)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([qk[at + i] for i in q.tolist()], pa.binary()), pa.array([keys[i] for i in b.tolist()], pa.binary()), pa.array(s.astype(np.float64))], ["asker", "other", "cosine"])

        def close():
            """The stored vectors are complete: those that ask are looked up."""
            if state["base"] is None and state["vecs"]:
                state["base"] = np.frombuffer(b"".join(state["vecs"]), np.float16).reshape(-1, dim)
                state["vecs"] = []
                state["order"] = list(state["keys"])
                state["ids"] = np.arange(len(state["order"]), dtype=np.int64)
                rows = np.flatnonzero(state["asks"])
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield from emit([state["order"][i] for i in part.tolist()], state["base"][part], part)

        for batch in _slices(batches, 1024):
            cell = batch.column(0).to_numpy()
            role = batch.column(1).to_numpy()
            keys, vecs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(role) != 0)) + 1).tolist(), len(cell)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if cell[a] != state["cell"]:
                    yield from close()
                    state.update(cell=cell[a], keys={}, vecs=[], asks=[], base=None)
                if role[a] < 2:
                    for key, vec in zip(keys[a:z], vecs[a:z]):
                        at = state["keys"].get(key)
                        if at is None:
                            state["keys"][key] = len(state["asks"])
                            state["vecs"].append(vec)
                            state["asks"].append(role[a] == 1)
                        elif role[a] == 1:
                            state["asks"][at] = True
                else:
                    yield from close()
                    if state["base"] is not None:
                        yield from emit(keys[a:z], np.frombuffer(b"".join(vecs[a:z]), np.float16).reshape(-1, dim), np.full(z - a, -1, np.int64))
        yield from close()

    # a cell has a bounded size, so with a partition for each of them no task gets much more than a few
    dealt = sent.repartition(min(max(cells, 8), MOST_TASKS), "cell").sortWithinPartitions("cell", "role")
    return dealt.mapInArrow(run, "asker binary, other binary, cosine double")


def most_similar(df: DataFrame, key: str, vec: str, order: str | None = None, asks: Column | None = None, k: int = K, floor: float = -1.0, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): up to ``k`` most similar other rows of each row, by cosine, ties by id, with a cosine of at least ``floor``.

    ``order``: of several rows of one id the one with the greatest value counts, and rows that tie must be identical. ``asks``: the rows
    that look for others (default all); all rows can be found. Rows without a usable vector (null, all zero, a null or infinite element,
    another length than the first one) neither ask nor are found. ``lists`` defaults to the number of classes divided by ``LIST_ROWS``, ``probes``
    to what ``Index.choose_probes`` reads off the sample.
    """
    spark = df.sparkSession
    wants = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = df.select(F.col(key).alias("id"), (F.col(order) if order else F.lit(0)).alias("ord"), F.col(vec).alias("vec"), wants.alias("asks"))
    kind = df.schema[key].dataType.simpleString()
    empty = f"id {kind}, other {kind}, cosine double, rank int"
    one = rows.filter(F.size("vec") > 0).select(F.size("vec").alias("n")).first()
    if one is None:
        return spark.createDataFrame([], empty)
    dim = one.n

    seen = written(class_keys(rows, dim))
    members = written(latest(seen, ["id"], "ord", ["id", "key"]).filter(F.col("key").isNotNull()))
    live = members.select("key").distinct()
    count = live.count()
    if not count:
        return spark.createDataFrame([], empty)
    dead = written(seen.filter(F.col("key").isNotNull()).select("key").distinct().join(live, "key", "left_anti"))

    lists = lists or max(1, -(-count // LIST_ROWS))
    want = min(FIT_ROWS, max(8192, FIT_PER_LIST * lists))
    share = min(1.0, 1.1 * want / count)

    def units(batches):
        """The classes of a share of all keys, each once a task: how many copies a class has makes no difference."""
        seen: set[bytes] = set()
        for b in _slices(batches):
            unit = unit_rows(b.column(0), dim)[1]
            fresh = {}
            for i, key in enumerate(class_key(unit)):
                if int.from_bytes(key[-4:], "little") < share * 2**32 and key not in seen:
                    seen.add(key)
                    fresh[key] = unit[i].astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())], ["key", "vec"])

    # the same classes whatever the order of the rows
    picked = rows.select("vec").mapInArrow(units, "key binary, vec binary").groupBy("key").agg(F.min("vec").alias("vec")).orderBy("key").limit(want).select("vec").toArrow().column(0).to_pylist()
    sample = np.concatenate([np.frombuffer(b"".join(picked[i : i + 1024]), np.float16).reshape(-1, dim).astype(np.float32) @ rotation(dim) for i in range(0, len(picked), 1024)] or [np.zeros((0, dim), np.float32)])
    del picked
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    index = Index.fit(sample, lists, count)
    index.probes = probes or index.choose_probes(sample, k, floor)

    sent = visits(rows, dim, index)
    if dead.limit(1).count():
        sent = sent.join(small(dead), "key", "left_anti")
    found = scan_lists(sent.select("cell", "role", "key", "vec"), dim, int(index.parts.sum()), k, floor)

    by = Window.partitionBy("asker").orderBy(F.desc("cosine"), "other")
    best = written(found.groupBy("asker", "other").agg(F.max("cosine").alias("cosine")).withColumn("_n", F.row_number().over(by)).filter(f"_n <= {k}").drop("_n"))
    firsts = written(
        members.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(f"_n <= {k + 1}")
        .groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    others = (
        best.join(firsts, best["other"] == firsts["key"]).select("asker", F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("s"), i.alias("id"))).alias("near"))
        .groupBy("asker").agg(F.flatten(F.collect_list("near")).alias("near"))
    )
    own = firsts.select("key", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("id"))).alias("own"))
    asking = members
    if asks is not None:
        asking = members.join(rows.filter("asks").select("id").distinct(), "id", "left_semi")
    none = F.expr("array()").cast(own.schema["own"].dataType)
    # a class of many members is divided; there are few such classes
    hot = small(written(members.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > HOT_ROWS).select("key", F.ceil(F.col("_m") / HOT_ROWS).cast("int").alias("_ways"))))
    ways = F.coalesce("_ways", F.lit(1))
    asking = asking.join(hot, "key", "left").select("id", "key", F.pmod(F.xxhash64("id"), ways).cast("int").alias("_way"))
    both = own.join(others, own["key"] == others["asker"], "left").select("key", "own", "near").join(hot, "key", "left").select("key", "own", "near", F.explode(F.sequence(F.lit(0), ways - 1)).alias("_way"))
    return (
        asking.join(both, ["key", "_way"])
        .select("id", F.slice(F.array_sort(F.filter(F.concat("own", F.coalesce("near", none)), lambda x: x["id"] != F.col("id"))), 1, k).alias("near"))
        .select("id", F.posexplode("near").alias("rank", "x"))
        .select("id", F.col("x.id").alias("other"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("x.s"))).alias("cosine"), (F.col("rank") + 1).alias("rank"))
    )
