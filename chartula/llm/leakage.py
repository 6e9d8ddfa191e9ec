"""Held-out passages that leaked into a corpus.

Patterns are the runs of three words of all passages. A Wu-Manber search over word blocks finds them: the shift table is keyed by pairs
of words, so a pair that stands in no pattern moves the window on by two words at once; a pair that ends a pattern leads to its bucket, and the
bucket's patterns are compared directly. Found runs are chained in order and in one place for each passage.

The patterns are sent to the executors while they have at most ``BLOCK_WORDS`` words. A larger held-out set stays distributed: its runs meet those of
the corpus in a join by hash, in one pass whatever their number, and the same chaining decides.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

RUN = 3
SHARE = 0.5
#: Words of the document between two runs of one place, at most.
GAP = 12
#: Words of passages sent to the executors, at most; more are joined.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{0,200}>")


def words(text: str) -> list[str]:
    return _WORD.findall((_TAG.sub(" ", text) if "<" in text else text).lower())


class Patterns:
    """Shift table and buckets of the three-word runs of ``passages``, a list of (id, words)."""

    def __init__(self, passages: list[tuple[str, list[str]]]):
        self.passages = [(i, w) for i, w in passages if len(w) >= RUN]
        self.ids: dict[str, int] = {}
        for _, ws in self.passages:
            for w in ws:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.base = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)
        for p, (_, ws) in enumerate(self.passages):
            seq = [self.ids[w] for w in ws]
            for j in range(len(seq) - RUN + 1):
                a, b, c = seq[j : j + RUN]
                self.shift[b * self.base + c] = 0
                self.shift.setdefault(a * self.base + b, 1)
                self.bucket[b * self.base + c].setdefault(a, []).append((p, j))

    def occurrences(self, seq: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(place, [(passage, place in it)]) of every run of three words of ``seq`` that stands in a passage."""
        shift, bucket, base = self.shift.get, self.bucket, self.base
        at, n = RUN - 1, len(seq)
        while at < n:
            c = seq[at]
            if not c:  # a word of no passage: no run can hold it
                at += RUN
                continue
            pair = seq[at - 1] * base + c
            s = shift(pair, RUN - 1)
            if s:
                at += s
                continue
            hit = bucket[pair].get(seq[at - 2])
            if hit:
                yield at - 2, hit
            at += 1

    def found_in(self, text: str, share: float = SHARE, gap: int = GAP) -> set[str]:
        """Ids of the passages of which ``text`` holds more than ``share`` of the words, in order, in one place."""
        seq = [x or 0 for x in map(self.ids.get, words(text))]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seen: dict[int, int] = defaultdict(int)
        for i, places in self.occurrences(seq):
            for p, j in places:
                hits[p].append((i, j))
                seen[p] |= 7 << j
        out: set[str] = set()
        for p, mask in seen.items():
            name, ws = self.passages[p]
            if name not in out and mask.bit_count() > share * len(ws) and chained(hits[p], gap) > share * len(ws):
                out.add(name)
        return out


def chained(hits: list[tuple[int, int]], gap: int = GAP) -> int:
    """Most words of the passage that lie in runs of the document which follow each other in both, at most ``gap`` words apart in the document."""
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for i, j in hits:
        r = open_.get(i - j)
        if r is not None and i == r[0] + r[2] - RUN + 1:
            r[2] += 1
        else:
            open_[i - j] = r = [i, j, RUN]
            runs.append(r)
    best: list[int] = []
    first = 0
    reach = max((r[2] for r in runs), default=0) + gap
    for k, (i, j, n) in enumerate(runs):
        while runs[first][0] + reach < i:
            first += 1
        top = n
        for m in range(first, k):
            a, b, c = runs[m]
            over = max(a + c - i, b + c - j, 0)
            if over <= n - RUN and i - (a + c) <= gap and j > b and i > a:
                top = max(top, best[m] + n - over)
        best.append(top)
    return max(best, default=0)


def passages_of(questions: DataFrame, key: str = "id") -> DataFrame:
    """(key, passage, body, size): ``question`` and each ``" | "``-separated value of ``evidence_quote`` of each row, numbered, with their words
    in number, about. Null ones are left out; rows delivered again count once."""
    own = questions.select(key, "question", "evidence_quote").distinct()
    every = F.concat(F.array(F.coalesce("question", F.lit(""))), F.split(F.coalesce("evidence_quote", F.lit("")), r" \| "))
    long = own.select(key, F.explode(F.array_distinct(F.filter(every, lambda p: F.trim(p) != ""))).alias("body"))
    return long.withColumns({"passage": F.xxhash64(key, "body"), "size": F.size(F.split("body", r"\s+"))})


def _by_automaton(own: DataFrame, passages: DataFrame, doc: str, text: str, key: str, schema: str, share: float, gap: int) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast([(r[0], words(r[1])) for r in passages.select(key, "body").orderBy(key, "passage").collect()])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = Patterns(sent.value)
        for batch in batches:
            rows = [(d, q) for d, t in zip(batch[doc], batch[text]) for q in sorted(patterns.found_in(t, share, gap))]
            yield pd.DataFrame(rows, columns=[doc, key])

    return own.mapInPandas(search, schema)


def _by_join(own: DataFrame, passages: DataFrame, doc: str, text: str, key: str, schema: str, share: float, gap: int) -> DataFrame:
    """Runs of both sides meet by hash; per document and passage the runs that met are chained."""

    def runs(body: str) -> Iterator[tuple[int, int]]:
        ws = words(body)
        for i in range(len(ws) - RUN + 1):
            yield i, int.from_bytes(hashlib.blake2b(" ".join(ws[i : i + RUN]).encode(), digest_size=8).digest(), "little", signed=True)

    def cut(name: str, body: str, place: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(n, i, h) for n, t in zip(batch[name], batch[body]) for i, h in runs(t)], columns=[name, place, "run"])

        return run

    asked = written(passages.select("passage", "body").mapInPandas(cut("passage", "body", "j"), "passage bigint, j int, run bigint"))
    held = own.mapInPandas(cut(doc, text, "i"), f"{doc} {own.schema[doc].dataType.simpleString()}, i int, run bigint")
    met = held.join(asked, "run").groupBy(doc, "passage").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("hits"), F.count_distinct("j").alias("_n"))
    lengths = passages.select("passage", key, "body")

    @F.pandas_udf("boolean")
    def leaks(hits: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([chained([(x["i"], x["j"]) for x in h], gap) > share * len(words(b)) for h, b in zip(hits, bodies)], dtype=bool)

    return met.join(lengths, "passage").filter(leaks("hits", "body")).select(doc, key).distinct()


def leaked(corpus: DataFrame, questions: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "id", share: float = SHARE, gap: int = GAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, key), one row for every document and question of which a passage leaked into it.

    One pass over the corpus, without a shuffle while the passages have at most ``block_words`` words. Passages of fewer than three words
    cannot be found; null texts hold none.
    """
    passages = written(passages_of(questions, key))
    schema = f"{doc} {corpus.schema[doc].dataType.simpleString()}, {key} string"
    own = corpus.select(doc, text).filter(F.col(text).isNotNull())
    total = passages.agg(F.sum("size")).first()[0] or 0
    return (_by_automaton if total <= block_words else _by_join)(own, passages, doc, text, key, schema, share, gap)
