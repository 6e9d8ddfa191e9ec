"""Pluggable embedders, generators, judges and parsers, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from . import answering, evaluate

QUERY_PREFIX = "Find passages that answer: "
_WORD = re.compile(r"\w+")

GENERATORS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {"extractive": answering.extractive_generator}


def generator(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    if name not in GENERATORS:
        raise ValueError(f"generator must be one of {sorted(GENERATORS)}")
    return GENERATORS[name](**options)


def hashed_vector(text: str | None, dim: int) -> list[float] | None:
    """Signed hashed word counts of unit length; null for texts without words."""
    v = np.zeros(dim)
    for w in _WORD.findall((text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = float(np.sqrt((v * v).sum()))
    return (v / n).astype(np.float32).tolist() if n else None


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: hashed_vector(t, dim))

    return embed


def embed_queries(df: DataFrame, text: str = "text", embedder: Callable[[Column], Column] | None = None, prefix: str = QUERY_PREFIX) -> DataFrame:
    """``df`` with ``vec``; the instruction goes in front of queries, never of passages."""
    return df.withColumn("vec", (embedder or hashing_embedder())(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))))


def embed_delta(changes: DataFrame, text: str, vector: str, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Embeds only rows whose ``change`` is not 'reuse'; the others keep ``vector``. Split first, so no kept row reaches the embedder."""
    kept = changes.filter(F.col("change") == "reuse")
    fresh = changes.filter(F.col("change") != "reuse")
    return kept.unionByName(fresh.withColumn(vector, (embedder or hashing_embedder())(F.col(text))))


class QuotaError(RuntimeError):
    """The account has nothing left: trying again is of no use, and the run ends."""


def throttled(call: Callable[[str], str], per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls at most ``per_minute`` times a minute, evenly spaced, in each Python worker."""
    last = [float("-inf")]

    def run(x: str) -> str:
        pause = last[0] + 60 / per_minute - clock()
        if pause > 0:
            sleep(pause)
        last[0] = clock()
        return call(x)

    return run


def with_retries(call: Callable[[str], str], tries: int = 5, wait: float = 1.0, limit: float = 120.0, sleep: Callable[[float], None] = time.sleep, retry_on: tuple = (TimeoutError, ConnectionError)) -> Callable[[str], str]:
    """Calls again after growing waits with jitter; a wait above ``limit`` or the last failure is raised."""

    def run(x: str) -> str:
        rng = random.Random(x)
        for n in range(tries):
            try:
                return call(x)
            except retry_on as e:
                pause = getattr(e, "retry_after", None) or wait * 2**n * (1 + 0.1 * rng.random())
                if n == tries - 1 or pause > limit:
                    raise
                sleep(pause)
        raise AssertionError("unreachable")

    return run


def calling_generator(call: Callable[[str], str], **retries) -> Callable[[DataFrame], DataFrame]:
    """A generator from a function of the prompt; failures that last leave a null answer, but without quota the run ends."""

    @F.pandas_udf(StringType())
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = with_retries(call, **retries)

        def safe(x):
            try:
                return run(x)
            except QuotaError:
                raise
            except Exception:
                return None

        for p in parts:
            yield p.map(safe)

    return lambda df: df.withColumn("answer", answer(F.col("prompt")))


def rule_votes(df: DataFrame, facts: str = "facts", answer: str = "answer", votes: int = 3) -> DataFrame:
    """``df`` once per vote with ``vote`` and ``statuses``: a fact is present if the answer holds its wording (first vote), nearly all of its
    words in order (second) or half of its words (third and later); else missing. Native expressions."""
    own = F.lower(F.coalesce(answer, F.lit("")))
    words = lambda f: F.filter(F.split(F.lower(f), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    held = lambda f: F.size(F.filter(words(f), lambda w: own.contains(w))) / F.greatest(F.size(words(f)), F.lit(1))
    rules = [lambda f: own.contains(F.lower(f)), lambda f: held(f) >= 0.9, lambda f: held(f) >= 0.5]

    def statuses(rule):  # a second parameter of the lambda would be taken for the position
        return F.transform(F.col(facts), lambda f: F.when(rule(f), "present").otherwise("missing"))

    per = F.array(*[F.struct(F.lit(v).alias("vote"), statuses(rules[min(v, 2)]).alias("statuses")) for v in range(votes)])
    return df.withColumn("_v", F.explode(per)).select(*df.columns, F.col("_v.vote").alias("vote"), F.col("_v.statuses").alias("statuses"))


def judge(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, facts, present, agreement) of votes with one status per fact; positions a vote lacks count as missing, ties too."""
    longest = votes.groupBy(*keys).agg(F.max(F.size("statuses")).alias("_n"))
    wide = votes.join(longest, keys)
    flat = wide.select(*keys, "vote", F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))), lambda i: F.when(F.col("_n") > 0, F.coalesce(F.get("statuses", i - 1), F.lit("missing"))))).alias("n", "status"))
    per = evaluate.majority(flat, [*keys, "n"], "status", "missing")
    facts = per.groupBy(*keys).agg(F.collect_list("winner").alias("_w"), F.round(F.avg("agreement"), 6).alias("agreement"))
    out = votes.select(*keys).distinct().join(facts, keys, "left")
    w = F.coalesce("_w", F.expr("array()").cast("array<string>"))
    return out.select(*keys, evaluate.verdict_from_facts(w).alias("verdict"), F.size(w).alias("facts"), F.size(F.filter(w, lambda s: s == "present")).alias("present"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


def parse_files(files: DataFrame, parser: Callable[[str, bytes], str], done: DataFrame | None = None) -> DataFrame:
    """(doc, json, error) of binary files (path, content) by a parser of their content; ``done`` (doc) are left out. A failing file gives its error."""
    named = files.withColumn("doc", F.element_at(F.split("path", "/"), -1))
    named = named if done is None else named.join(done.select("doc"), "doc", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc"], b["content"]):
                try:
                    rows.append((doc, parser(doc, bytes(content)), None))
                except Exception as e:
                    rows.append((doc, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["doc", "json", "error"])

    return named.select("doc", "content").mapInPandas(run, "doc string, json string, error string")
