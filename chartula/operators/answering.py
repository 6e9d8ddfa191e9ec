"""Answer assembly: numbered source blocks, prompts, citations, routing, cached generation and cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import location, page_label, where_label
from ..plans.tables import list_names, written
from .register import SUPERSEDED, lineage, status_label

NOT_COVERED = "The supplied documents do not cover this."
SYSTEM_PROMPT = (
    "Answer from the numbered sources alone. Cite the source of every statement, such as [S1]. Keep figures, dates and conditions as they are stated. "
    f"Say that a rule is in force, amended or repealed only if a source says so. If the sources do not answer the question, reply exactly: {NOT_COVERED}"
)
COMPARE_PROMPT = " Sources marked CURRENT hold the rule in force; use the others only to say what was earlier, in the form Earlier: ... Now: ..."
SEPARATOR = "\n\n---\n\n"


def two_sides(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Hits of several ranked lists with a ``side`` (0 first), numbered on per query as ``n``."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy(qid).orderBy("side", "rank")))


def compare_hits(current: DataFrame, superseded: DataFrame, qid: str = "qid") -> DataFrame:
    """Current rules first, then superseded versions; source numbers run on."""
    return two_sides(current.withColumn("side", F.lit(0)).unionByName(superseded.withColumn("side", F.lit(1)), allowMissingColumns=True), qid)


def with_labels(chunks: DataFrame, register: DataFrame) -> DataFrame:
    """Chunks with ``label`` (status label of their document, null if it is not registered), ``place``, ``pages`` and ``header``."""
    labels = lineage(register).select(F.col("file_name").alias("doc"), status_label().alias("label"))
    out = chunks.join(labels, "doc", "left").withColumns({"place": where_label(), "pages": page_label(), "path": location()})
    return out.withColumn("header", F.concat(F.coalesce("title", F.lit("")), F.lit(" ["), F.coalesce("label", F.lit("UNKNOWN")), F.lit("] › "), F.col("path"))).drop("path")


def source_block(n: Column | str = "n") -> Column:
    """A numbered source: header, amendment note if any, trimmed text."""
    n = F.col(n) if isinstance(n, str) else n
    note = F.when(F.coalesce(F.col("amendment_note"), F.lit("")) != "", F.concat(F.lit("Amendment note: "), F.col("amendment_note")))
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.concat_ws("\n", F.concat(F.lit("[S"), n.cast("string"), F.lit("] "), F.col("header")), note, F.concat(F.lit("Text:\n"), trimmed))


def prompts(sources: DataFrame, questions: DataFrame, qid: str = "qid", question: str = "text") -> DataFrame:
    """(qid, prompt, n_sources) of sources (qid, n, header, amendment_note, text); questions without sources get a prompt without blocks."""
    blocks = sources.select(qid, "n", source_block().alias("b")).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("s"))
    text = F.concat(F.lit("Sources:\n\n"), F.array_join(F.transform("s", lambda x: x["b"]), SEPARATOR), F.lit(SEPARATOR), F.lit("Question: "), F.col(question))
    out = questions.select(qid, question).join(blocks, qid, "left").withColumn("s", F.coalesce("s", F.expr("array()").cast("array<struct<n:int,b:string>>")))
    return out.select(qid, text.alias("prompt"), F.size("s").alias("n_sources"))


def cited_numbers(text: Column, n_sources: Column) -> Column:
    """Source numbers cited as [S1], [S1, S2] or [S1; 2], in order of first use; numbers out of range are dropped."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(S\d+(?:\s*[,;]\s*S?\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= n_sources)))


def route(manual: bool = True) -> Column:
    """'compare' for questions about changes, else 'current'; with ``manual`` off always 'current'."""
    return F.when(F.lit(manual) & (F.col("type") == "change"), "compare").otherwise("current")


def routed(questions: DataFrame, records: DataFrame, manual: bool = True) -> DataFrame:
    """``questions`` (id, type, ..) with ``mode``, ``record`` and ``routing``: questions of status whose document is known get its status record as one
    more source. ``records`` is (id, file_name), one row for each question with such a document."""
    own = questions.join(records.select("id", F.col("file_name").alias("_file")), "id", "left")
    record = F.when(F.lit(manual) & (F.col("type") == "status"), F.col("_file"))
    label = F.when(record.isNotNull(), F.concat(F.lit("current+status("), record, F.lit(")"))).otherwise(route(manual))
    return own.withColumns({"mode": route(manual), "record": record, "routing": label}).drop("_file")


def with_extras(hits: DataFrame, extras: DataFrame, qid: str = "qid") -> DataFrame:
    """Sources of all questions, numbered: the hits in their order, then ``extras`` (qid, as_source columns), which have no chunk."""
    first = hits.withColumn("side", F.coalesce(F.col("side"), F.lit(0)) if "side" in hits.columns else F.lit(0))
    own = extras.withColumns({"side": F.lit(9), "rank": F.row_number().over(Window.partitionBy(qid).orderBy("doc"))})
    return two_sides(first.unionByName(own, allowMissingColumns=True), qid)


def answer_rows(answers: DataFrame, sources: DataFrame, targets: DataFrame, qid: str = "id") -> DataFrame:
    """One row per answer (keys.., id, type, answer): what it cites, by number and by chunk, and how that meets the expected places.

    ``sources`` is (id, n, chunk_id, doc, region, para, section); ``targets`` as of ``parse_targets``. The flags are null where nothing is expected;
    ``citation_match`` also for unanswerable questions.
    """
    keys = [c for c in answers.columns if c not in ("answer",)]
    t = targets.filter("parsed").select(qid, F.col("n").alias("_t"), "doc", "region", "paras", "section_contains")
    fits = (F.col("paras").isNull() | F.array_contains("paras", F.coalesce("para", F.lit("")))) & (F.col("section_contains").isNull() | F.coalesce("section", F.lit("")).contains(F.coalesce("section_contains", F.lit(""))))
    held = t.join(sources.select(qid, "n", "doc", "region", "para", "section"), [qid, "doc", "region"], "left").groupBy(qid, "_t").agg(F.array_compact(F.collect_set(F.when(fits, F.col("n")))).alias("_n"))
    places = held.groupBy(qid).agg(F.collect_list("_n").alias("_places"))
    refs = sources.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(F.col("n"), F.concat(F.lit("S"), F.col("n").cast("string"), F.lit("="), F.coalesce("chunk_id", F.concat(F.lit("status:"), "doc"))).alias("ref")))).alias("_refs"))
    out = answers.join(refs, qid, "left").join(places, qid, "left")
    n = F.coalesce(F.size("_refs"), F.lit(0))
    out = out.withColumn("_cited", F.coalesce(cited_numbers(F.col("answer"), F.when(n > 0, n).otherwise(0)), F.expr("array()").cast("array<int>")))
    text = lambda keep: F.array_join(F.transform(keep, lambda x: x["ref"]), " || ")
    some = lambda test: F.when(F.size("_places") > 0, test.cast("int"))
    return out.select(
        *keys, not_covered(F.col("answer")).cast("int").alias("exact_refusal"), F.array_join(F.col("_cited").cast("array<string>"), ",").alias("cited"),
        F.coalesce(text(F.filter("_refs", lambda x: F.array_contains("_cited", x["n"]))), F.lit("")).alias("cited_chunk_ids"), F.coalesce(text(F.col("_refs")), F.lit("")).alias("retrieved"),
        some(F.exists("_places", lambda p: F.size(p) > 0)).alias("expected_in_top5"), some(F.forall("_places", lambda p: F.size(p) > 0)).alias("all_expected_in_top5"),
        F.when(F.col("type") != "unanswerable", some(F.exists("_places", lambda p: F.arrays_overlap(p, F.col("_cited"))))).alias("citation_match"),
    )


def cache_key(cols: list[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def cached(requests: DataFrame, cache: DataFrame, generate: Callable[[DataFrame], DataFrame], cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, cache with the new ones, counts of hits and misses): only requests without an entry are generated, once per key.

    ``generate`` adds ``answer`` to a table of requests; ``cache`` is (key, answer).
    """
    keyed = requests.withColumn("key", cache_key(cols))
    missing = keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = generate(missing).select("key", "answer")
    grown = cache.select("key", "answer").unionByName(fresh)
    there = cache.select("key", F.lit(True).alias("_hit"))
    counts = keyed.join(there, "key", "left").agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    return keyed.join(grown, "key", "left"), grown, counts


class AnswerCache:
    """Answers kept under ``path`` across sessions: (key, answer), appended to. Each request is generated once, whoever asked for it first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        schema = "key string, answer string"
        if not any(n.endswith(".parquet") for n in list_names(self.spark, self.path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).groupBy("key").agg(F.min("answer").alias("answer"))

    def answers(self, requests: DataFrame, generate: Callable[[DataFrame], DataFrame], cols: list[str]) -> tuple[DataFrame, DataFrame]:
        """(requests with ``answer``, counts of hits and misses). What is missing is generated and appended before this returns; failed ones (null) are
        not kept, so they are tried again next time."""
        before = self.table()
        keyed = requests.withColumn("key", cache_key(cols))
        counts = written(keyed.join(before.select("key", F.lit(True).alias("_hit")), "key", "left").agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses")))
        missing = keyed.dropDuplicates(["key"]).join(before.select("key"), "key", "left_anti")
        generate(missing).select("key", "answer").filter(F.col("answer").isNotNull()).write.mode("append").parquet(self.path)
        return keyed.join(self.table(), "key", "left"), counts


def extractive_generator(prompt: str = "prompt") -> Callable[[DataFrame], DataFrame]:
    """Deterministic stand-in for a language model: the source sentence that shares most words with the question, cited; else the refusal."""

    def pick(text: str | None) -> str:
        if text is None:
            return NOT_COVERED
        *blocks, question = text.split(SEPARATOR)
        asked = set(question.lower().split())
        best = (0, 0, "")
        for n, b in enumerate(blocks, 1):
            for s in b.partition("Text:\n")[2].replace("\n", " ").split(". "):
                score = len(asked & set(s.lower().split()))
                if score > best[0]:
                    best = (score, n, s.strip().rstrip("."))
        return f"{best[2]}. [S{best[1]}]" if best[0] >= 2 else NOT_COVERED

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(pick)

    return lambda df: df.withColumn("answer", answer(F.col(prompt)))


def not_covered(answer: Column) -> Column:
    return F.coalesce(F.rtrim(answer) == NOT_COVERED, F.lit(False))


def estimate_cost(usage: DataFrame, prices: DataFrame, free: tuple[str, ...] = ()) -> DataFrame:
    """``usage`` (model, provider, input_tokens, output_tokens) with ``cost``: prices (model, price_in, price_out) per million tokens.

    A dated model name falls back to its undated price; free providers cost 0; models without a price have a null cost.
    """
    p = prices.select(F.col("model").alias("_m"), "price_in", "price_out")
    q = prices.select(F.col("model").alias("_m2"), F.col("price_in").alias("_in2"), F.col("price_out").alias("_out2"))
    base = F.regexp_replace("model", r"-\d{4}-\d{2}-\d{2}$", "")
    out = usage.join(p, F.col("model") == F.col("_m"), "left").join(q, base == F.col("_m2"), "left")
    cost = (F.col("input_tokens") * F.coalesce("price_in", "_in2") + F.col("output_tokens") * F.coalesce("price_out", "_out2")) / 1_000_000
    return out.withColumn("cost", F.when(F.col("provider").isin(list(free)), 0.0).otherwise(cost)).drop("_m", "price_in", "price_out", "_m2", "_in2", "_out2")


__all__ = ["SUPERSEDED", "NOT_COVERED", "SYSTEM_PROMPT", "COMPARE_PROMPT", "AnswerCache", "cached", "cache_key", "cited_numbers", "compare_hits", "estimate_cost", "extractive_generator", "not_covered", "prompts", "route", "routed", "answer_rows", "with_extras", "source_block", "two_sides", "with_labels"]
