"""Retrieval: exact vector top-k, keyword top-k over postings, reciprocal rank fusion. Batch first: one query is a table of one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes, query_stems, query_words, words

POOL, RRF_K = 20, 60
MAX_DF, MIN_TERMS = 0.15, 3
NO_RANK = 1_000_000
METHODS = ("vector", "keyword", "hybrid")
#: Query vectors sent to the executors at once.
BLOCK_BYTES = 32 << 20


def status_filter(df: DataFrame, statuses=("active",), include_boilerplate: bool = False) -> DataFrame:
    """``statuses`` null or empty keeps all; a null boilerplate flag counts as false."""
    if statuses:
        df = df.filter(F.col("status").isin(list(statuses)))
    return df if include_boilerplate else df.filter(~F.coalesce(F.col("boilerplate"), F.lit(False)))


def ranked(df: DataFrame, by: str | list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """``df`` with a 1-based ``rank``, cut at ``k`` (a partial and a final group limit, so no partition keeps more than k rows per group)."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)))
    return out.filter(F.col("rank") <= k) if k is not None else out


def _same_filter(queries: DataFrame) -> bool:
    return "skip" in queries.columns


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vec: str = "embedding", qid: str = "qid", qvec: str = "vec") -> DataFrame:
    """(qid, key, score, rank): exact cosine, rounded to 6 places, ties by key.

    The queries are a stated set; they are sent in blocks of bounded size, each corpus partition keeps its best k per query, and a window
    ranks those. A query with a column ``skip`` leaves out the row of that key. Null, zero and wrong-length vectors on either side match nothing.
    """
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    qkind = queries.schema[qid].dataType.simpleString()
    schema = f"{qid} {qkind}, {key} {kind}, score double"
    cols = [qid, qvec] + (["skip"] if _same_filter(queries) else [])
    own = corpus.select(key, vec).filter(F.col(vec).isNotNull())
    found, block, size = None, [], 0

    def scan(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = [r[0] for r in sent.value]
            q = np.array([r[1] for r in sent.value], np.float64)
            skip = np.array([r[2] if len(r) > 2 else None for r in sent.value], object)
            at = np.zeros(0, np.int64)
            key_, score = np.zeros(0, object), np.zeros(0)
            for batch in batches:
                keep = [v is not None and len(v) == q.shape[1] for v in batch[vec]]
                keys = batch[key][keep].to_numpy().astype(object)
                if not len(keys):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in batch[vec][keep]])
                norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                keys, x, norm = keys[ok], x[ok], norm[ok]
                if not len(keys):
                    continue
                s = np.round((q @ x.T) / norm, 6)
                s[keys[None, :] == skip[:, None]] = -9
                n = min(len(keys), k)
                rows, cols = np.nonzero(s >= np.maximum(-np.partition(-s, n - 1, axis=1)[:, n - 1], -8)[:, None])
                at, key_, score = np.r_[at, rows], np.r_[key_, keys[cols]], np.r_[score, s[rows, cols]]
                order = np.lexsort((pd.factorize(key_, sort=True)[0], -score, at))
                at, key_, score = at[order], key_[order], score[order]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                best = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k
                at, key_, score = at[best], key_[best], score[best]
            yield pd.DataFrame({qid: [ids[i] for i in at.tolist()], key: key_.tolist(), "score": score})

        return own.mapInPandas(run, schema)

    def blocks():
        block, size, dim = [], 0, None
        for r in queries.select(*cols).filter(F.col(qvec).isNotNull()).toLocalIterator():
            v = np.asarray(r[1], np.float64)
            n = float(np.sqrt((v * v).sum())) if len(v) else 0.0
            if not (np.isfinite(n) and n > 0):
                continue
            if block and (size + v.nbytes > BLOCK_BYTES or len(v) != dim):
                yield block
                block, size = [], 0
            dim = len(v)
            block.append((r[0], (v / n).tolist(), *r[2:]))
            size += v.nbytes
        if block:
            yield block

    for b in blocks():
        part = scan(b)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    return ranked(found, qid, [F.desc("score"), F.col(key)], k)


def postings(df: DataFrame, key: str = "chunk_id", tsv: str = "tsv", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lexeme, weight, first, keep..) of a column of search vectors. One row per lexeme, without a shuffle."""
    own = df.select(key, *keep, F.explode_outer(lexemes(F.col(tsv))).alias("x")).filter(F.col("x").isNotNull())
    return own.select(key, *keep, "x.lexeme", "x.weight", "x.first")


def word_postings(df: DataFrame, key: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same of plain texts, for tables without search vectors: each place of a word weighs as a position."""
    own = df.select(key, *keep, F.explode_outer(words(F.col(text))).alias("lexeme")).filter(F.col("lexeme").isNotNull())
    return own.groupBy(key, *keep, "lexeme").agg(F.round(0.1 * F.count(F.lit(1)), 6).alias("weight")).withColumn("first", F.lit(True))


def lexeme_df(posts: DataFrame) -> DataFrame:
    """(lexeme, df): in how many records a lexeme stands."""
    return posts.groupBy("lexeme").agg(F.count_if("first").alias("df"))


def updated_index(posts: DataFrame, dfs: DataFrame, changes: DataFrame, key: str = "chunk_id", tsv: str = "tsv", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(postings, document frequencies) after changes: one row per record added, changed or deleted, with its new vector, null if it is gone.

    Only the changed records are read again; frequencies move by what their postings were and are.
    """
    ids = changes.select(key)
    gone, fresh = posts.join(ids, key, "left_semi"), postings(changes, key, tsv, keep)
    moved = gone.filter("first").select("lexeme", F.lit(-1).alias("d")).unionByName(fresh.filter("first").select("lexeme", F.lit(1).alias("d")))
    every = dfs.select("lexeme", F.col("df").alias("d")).unionByName(moved).groupBy("lexeme").agg(F.sum("d").cast("bigint").alias("df"))
    return posts.join(ids, key, "left_anti").unionByName(fresh), every.filter("df > 0")


def keyword_terms(queries: DataFrame, dfs: DataFrame, total: DataFrame, qid: str = "qid", text: str = "text", max_df: float = MAX_DF, min_terms: int = MIN_TERMS, stem: bool = True) -> DataFrame:
    """(qid, lexeme, df): a query's lexemes found in at most ``max_df`` of all records; if fewer than ``min_terms`` are left, its rarest ones.

    ``total`` has one row with the number of records. Lexemes of no record have df 0 and are kept. Words are stemmed and stop words left out, as in
    stored vectors; without ``stem`` they are looked up as they stand.
    """
    terms = query_stems(F.col(text)) if stem else query_words(F.col(text))
    own = queries.select(qid, F.explode_outer(terms).alias("lexeme")).filter(F.col("lexeme").isNotNull()).join(dfs, "lexeme", "left").select(qid, "lexeme", F.coalesce("df", F.lit(0)).alias("df"))
    own = own.join(F.broadcast(total.select(F.col(total.columns[0]).alias("_n")))).withColumn("_keep", F.col("df") <= max_df * F.col("_n"))
    w = Window.partitionBy(qid)
    own = own.withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(w)).withColumn("_r", F.row_number().over(w.orderBy("df", "lexeme")))
    return own.filter((F.col("_keep") & (F.col("_kept") >= min_terms)) | ((F.col("_kept") < min_terms) & (F.col("_r") <= min_terms))).select(qid, "lexeme", "df")


def keyword_search(posts: DataFrame, terms: DataFrame, k: int, key: str = "chunk_id", qid: str = "qid", allowed: Column | None = None) -> DataFrame:
    """(qid, key, score, rank): the weights of all positions a query's lexemes hold, ties by key. ``posts`` are the postings of the records that may
    be found; ``allowed`` is a condition on columns of ``posts`` and ``terms``, tested before the cut."""
    met = posts.join(terms, "lexeme")
    hits = (met if allowed is None else met.filter(allowed)).groupBy(qid, key).agg(F.sum("weight").alias("score"))
    return ranked(hits.withColumn("score", F.round("score", 6)), qid, [F.desc("score"), F.col(key)], k)


def hybrid_search(vector: DataFrame, keyword: DataFrame, k: int, key: str = "chunk_id", qid: str = "qid", pool: int = POOL, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, key, score, vector_rank, keyword_rank, rank) of two ranked lists, each cut at ``pool``. Ties keep the vector order, then the key."""
    v = vector.filter(F.col("rank") <= pool).select(qid, key, F.col("rank").alias("vector_rank"))
    w = keyword.filter(F.col("rank") <= pool).select(qid, key, F.col("rank").alias("keyword_rank"))
    one = lambda c: F.coalesce(1 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = v.join(w, [qid, key], "full_outer").withColumn("score", F.round(one("vector_rank") + one("keyword_rank"), 6))
    return ranked(fused, qid, [F.desc("score"), F.coalesce("vector_rank", F.lit(NO_RANK)), F.col(key)], k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 5, statuses=("active",), include_boilerplate: bool = False, method: str = "vector", key: str = "chunk_id", stem: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Top-k for each query (qid, text, vec) in ``corpus`` (key, status, boilerplate, tsv, embedding), with ``columns`` of the corpus; statistics
    cover the whole corpus."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    own = status_filter(corpus, statuses, include_boilerplate)
    n = POOL if method == "hybrid" else k
    vec = vector_search(own, queries, n, key) if method != "keyword" else None
    out = vec
    if method != "vector":
        every = postings(corpus, key)
        terms = keyword_terms(queries, lexeme_df(every), corpus.agg(F.count(F.lit(1)).alias("n")), stem=stem)
        kw = keyword_search(postings(own, key), terms, n, key)
        out = kw if method == "keyword" else hybrid_search(vec, kw, k, key)
    return out.join(corpus.select(key, *columns), key) if columns else out
