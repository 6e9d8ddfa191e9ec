"""Evaluation of retrieval and answers, and checks of a question set, as native aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text, numbers_in, squash

SEP = r"\s*\|\s*"
VERDICTS = ("correct", "partial", "incorrect")
STALE = ("repealed", "withdrawn")
PLAIN_TYPES = ("simple", "multi_part")
KS = (1, 3, 5, 10)


# ---- expected places ---------------------------------------------------------------------------------

#: How places are written.
ANNEX_PLACE = r"\b(?:Annex(?:ure)?|Appendix)\s*[-–]?\s*([IVX]+|\d+)\b"
PARAS_PLACE = r"\bparas?\s*(\d+)\s*[-–]\s*(\d+)\b"
PARA_PLACE = r"\bpara\s*(\d+[A-Z]?)\b"
PART_PLACE = r"\b(Part\s+\w+)"
DOCUMENT_NAME = r"\.(?:pdf|html)$"


def parse_targets(questions: DataFrame) -> DataFrame:
    """(id, type, n, doc, region, paras, section_contains, parsed) of each expected place of a question.

    ``source_doc`` and ``source_section`` hold values joined by ' | ', paired by position; a single section holds for all documents. A
    place is parsed if it names a .pdf or .html document and a paragraph or an annex.
    """
    split = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    q = questions.select("id", "type", split(F.col("source_doc")).alias("_d"), split(F.col("source_section")).alias("_s"))
    sections = F.when((F.size("_s") == 1) & (F.size("_d") > 1), F.array_repeat(F.element_at("_s", 1), F.size("_d"))).otherwise(F.col("_s"))
    q = q.withColumn("_s", sections).select("id", "type", F.posexplode(F.arrays_zip("_d", "_s")).alias("n", "x"))
    q = q.select("id", "type", (F.col("n") + 1).alias("n"), F.coalesce("x._d", F.lit("")).alias("doc"), F.coalesce("x._s", F.lit("")).alias("section"))
    first = lambda p, g=1: F.nullif(F.regexp_extract("section", p, g), F.lit(""))
    annex = first(ANNEX_PLACE)
    low, high = first(PARAS_PLACE, 1).try_cast("int"), first(PARAS_PLACE, 2).try_cast("int")
    single = first(PARA_PLACE)
    paras = F.when(low.isNotNull(), F.when(low <= high, F.sequence(low, F.greatest(low, high)).cast("array<string>")).otherwise(F.expr("array()").cast("array<string>"))).when(single.isNotNull(), F.array(single))
    usable = F.col("doc").rlike(DOCUMENT_NAME) & (F.col("section") != "") & (F.lower("section") != "none") & (paras.isNotNull() | annex.isNotNull())
    return q.select(
        "id", "type", "n", "doc", "section", F.when(annex.isNotNull(), F.concat(F.lit("annex_"), annex)).otherwise("main").alias("region"), paras.alias("paras"),
        F.when(annex.isNotNull(), first(PART_PLACE)).alias("section_contains"), usable.alias("parsed"),
    )


def describe_target() -> Column:
    region = F.when(F.col("region") == "main", "").otherwise(F.concat(F.replace("region", F.lit("annex_"), F.lit("Annex ")), F.lit(" ")))
    numbers = F.transform("paras", lambda p: F.regexp_extract(p, r"^\d+", 0).try_cast("int"))
    paras = (
        F.when(F.col("paras").isNull(), F.coalesce("section_contains", F.lit("any")))
        .when(F.size("paras") == 1, F.concat(F.lit("para "), F.element_at("paras", 1)))
        .otherwise(F.concat_ws("", F.lit("paras "), F.array_min(numbers).cast("string"), F.lit("-"), F.array_max(numbers).cast("string")))
    )
    return F.concat(F.col("doc"), F.lit(" "), region, paras)


def matched(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, n, rank): for each parsed target the best rank of a hit (id, rank, doc, region, para, section) in it, null if there is none."""
    t = targets.filter("parsed").select("id", "n", "doc", "region", "paras", "section_contains")
    both = t.join(hits.select("id", "rank", "doc", "region", "para", "section"), ["id", "doc", "region"], "left")
    ok = (F.col("paras").isNull() | F.array_contains("paras", F.coalesce("para", F.lit("")))) & (F.col("section_contains").isNull() | F.coalesce("section", F.lit("")).contains(F.coalesce("section_contains", F.lit(""))))
    return both.groupBy("id", "n").agg(F.min(F.when(ok, F.col("rank"))).alias("rank"))


def retrieval_results(hits: DataFrame, targets: DataFrame, ks=KS, all_k: int | None = None) -> DataFrame:
    """(id, type, rank, hit_<k>.., all_found) per question with a parsed target; ``all_found`` looks at the first ``all_k`` hits, by default at as many
    as the greatest k."""
    far = all_k or max(ks)
    per = matched(hits, targets).groupBy("id").agg(F.min("rank").alias("rank"), F.min(F.coalesce(F.col("rank") <= far, F.lit(False)).cast("int")).alias("all_found"))
    kinds = targets.filter("parsed").select("id", "type").distinct()
    return kinds.join(per, "id").select("id", "type", "rank", *[F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks], "all_found")


def described(results: DataFrame, targets: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """``results`` with what was expected, what could not be parsed, the statuses allowed, and the first ``k`` hits (id, rank, doc, place, score) as text."""
    text = F.when(F.col("parsed"), describe_target())
    unparsed = F.when(~F.col("parsed"), F.trim(F.concat_ws(" ", "doc", "section")))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n", c.alias("t"))))), lambda x: x["t"]), "; ")
    places = targets.groupBy("id").agg(ordered(text).alias("expected"), ordered(unparsed).alias("unparsed_part"))
    shown = hits.filter(F.col("rank") <= k).select("id", "rank", F.concat("doc", F.lit(" "), "place", F.format_string(" (%.3f)", F.col("score").cast("double"))).alias("t"))
    tops = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), " || ").alias(f"top{k}"))
    out = results.join(places, "id", "left").join(tops, "id", "left").withColumn("statuses", F.when(F.col("type").isin(*PLAIN_TYPES), "active").otherwise("all"))
    return out.withColumn(f"top{k}", F.coalesce(f"top{k}", F.lit("")))


def unparseable(targets: DataFrame) -> DataFrame:
    """(id, type, unparsed): questions none of whose places can be parsed."""
    per = targets.groupBy("id", "type").agg(F.bool_or("parsed").alias("_any"), F.array_sort(F.collect_list(F.struct("n", F.trim(F.concat_ws(" ", "doc", "section")).alias("t")))).alias("_p"))
    return per.filter("not _any").select("id", "type", F.array_join(F.transform("_p", lambda x: x["t"]), "; ").alias("unparsed"))


def differing_ranks(results: DataFrame, methods: list[str], watched: tuple[str, ...] = ()) -> DataFrame:
    """(id, <method>..): questions whose rank is not the same for all methods, and those watched."""
    wide = ranks_by_method(results, methods)
    same = [F.col(m).eqNullSafe(F.col(methods[0])) for m in methods[1:]]
    return wide.filter(~reduce(lambda a, b: a & b, same, F.lit(True)) | F.col("id").isin(list(watched)))


def recall(results: DataFrame, ks=KS, by: tuple[str, ...] = ("type",)) -> DataFrame:
    """Recall at each k, per group and over the last one of its columns (null there), in one pass."""
    sets = [list(by[:-1]), list(by)]
    return results.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"hit_{k}"), 6).alias(f"recall_{k}") for k in ks])


def allowed_by_type(kind: str = "type", status: str = "status") -> Column:
    """What a question's type may use: current documents for simple and multi-part questions, all for the others. Tested before hits are cut."""
    return ~F.coalesce(F.col(kind).isin(*PLAIN_TYPES), F.lit(False)) | F.coalesce(F.col(status) == "active", F.lit(False))


def half_found(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(id): questions with several expected places of which not all were found."""
    several = targets.filter("parsed").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    return results.filter("all_found = 0").join(several, "id", "left_semi").select("id")


def resolve_document(names: DataFrame, register: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``doc``: the registered document of the same stem (the least of several), else the stem with .pdf."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    known = register.groupBy(stem(F.col("file_name")).alias("_stem")).agg(F.min("file_name").alias("_file"))
    out = names.withColumn("_stem", stem(F.col(name))).join(known, "_stem", "left")
    return out.withColumn("doc", F.coalesce("_file", F.concat("_stem", F.lit(".pdf")))).select(*names.columns, "doc")


def graded_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows with a verdict in ``column``, in one form; a value that is no verdict raises an error."""
    v = F.lower(F.trim(column))
    checked = F.when(v.isin(*VERDICTS), v).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), v)))
    return df.filter(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn(column, checked)


def encoded_sources(n: str = "n", ref: str = "chunk_id", doc: str = "doc") -> Column:
    """'S1=<chunk id>' or 'S1=status:<document>' of a source row."""
    return F.concat(F.lit("S"), F.col(n).cast("string"), F.lit("="), F.coalesce(F.col(ref), F.concat(F.lit("status:"), F.col(doc))))


def ranks_by_method(results: DataFrame, methods: list[str]) -> DataFrame:
    """(id, <method>..): the rank of each method side by side. ``results`` is (id, method, rank)."""
    return results.groupBy("id").pivot("method", methods).agg(F.min("rank"))


# ---- votes and verdicts ------------------------------------------------------------------------------

def majority(votes: DataFrame, keys: list[str], value: str, tie) -> DataFrame:
    """(keys, winner, agreement): the most frequent value, or ``tie`` if two share the first place (its agreement may then be 0). Null votes do not count."""
    counts = votes.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    top = F.max("_c").over(Window.partitionBy(*keys))
    per = counts.withColumn("_top", top).groupBy(*keys).agg(
        F.sum("_c").alias("_all"), F.count_if(F.col("_c") == F.col("_top")).alias("_first"), F.max(F.when(F.col("_c") == F.col("_top"), F.col(value))).alias("_v"),
        F.max("_top").alias("_n"), F.coalesce(F.max(F.when(F.col(value) == F.lit(tie), F.col("_c"))), F.lit(0)).alias("_tie"),
    )
    shared = F.col("_first") > 1
    return per.select(*keys, F.when(shared, F.lit(tie)).otherwise(F.col("_v")).alias("winner"), F.round(F.when(shared, F.col("_tie")).otherwise(F.col("_n")) / F.col("_all"), 6).alias("agreement"))


def verdict_from_facts(statuses: Column) -> Column:
    """Of an array of 'present', 'missing' and 'contradicted'."""
    bad = F.coalesce(F.size(statuses) < 1, F.lit(True)) | F.exists(statuses, lambda s: s == "contradicted") | ~F.exists(statuses, lambda s: s == "present")
    return F.when(F.coalesce(bad, F.lit(True)), "incorrect").when(F.forall(statuses, lambda s: s == "present"), "correct").otherwise("partial")


def split_facts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def diagnosis() -> Column:
    """Of verdict, type and all_expected_found."""
    return F.when(F.col("verdict") == "correct", "").when((F.col("type") == "unanswerable") | F.coalesce(F.col("all_expected_found") == 1, F.lit(False)), "generation_error").otherwise("retrieval_miss")


def refusal_verdict() -> Column:
    """Verdict of answers settled without a judge: an exact refusal is right for unanswerable questions, wrong for others; else null."""
    return F.when(F.col("exact_refusal") == 1, F.when(F.col("type") == "unanswerable", "correct").otherwise("incorrect"))


def canonical_verdict(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*VERDICTS), v)


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(truth, said, n) of all pairs of verdicts, zeros included; rows with a null on either side do not count."""
    counts = df.filter(F.col(truth).isNotNull() & F.col(said).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(a, b) for a in VERDICTS for b in VERDICTS], "truth string, said string")
    return F.broadcast(spine).join(counts, ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: graded rows, equal ones and their share (null without rows)."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("equal")).withColumn("rate", F.round(F.try_divide("equal", "n"), 6))


def verdict_counts(df: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    return df.groupBy(*by).pivot(verdict, list(VERDICTS)).agg(F.count(F.lit(1))).na.fill(0, list(VERDICTS))


def share(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def answer_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: shares of verdicts, citation and refusal rates, false refusals, cost and time, each null if nothing counts.

    ``df`` has type, verdict, citation_match, refused, exact_refusal, cost and seconds.
    """
    un = F.col("type") == "unanswerable"
    rate = lambda cond, among: F.round(share(F.count_if(cond & among), F.count_if(among)), 6)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[rate(F.col("verdict") == v, F.lit(True)).alias(v) for v in VERDICTS], rate(F.col("verdict") == "correct", ~un).alias("correct_answerable"),
        rate(F.col("citation_match") == 1, ~un & F.col("citation_match").isNotNull()).alias("citation"), rate(F.col("refused") == 1, un).alias("refusal"),
        rate(F.col("exact_refusal") == 1, un).alias("exact_refusal"), rate(F.col("refused") == 1, ~un).alias("false_refusal"),
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.round(F.avg("seconds"), 6).alias("seconds"),
    )


def across_runs(values: DataFrame, runs: int) -> DataFrame:
    """(metric, mean, min, max) of (metric, run, value), for metrics with a value in every run."""
    return values.groupBy("metric").agg(F.count("value").alias("_n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")).filter(F.col("_n") == runs).drop("_n")


def unstable(df: DataFrame, run: str = "source_run", verdict: str = "verdict") -> DataFrame:
    """(id, verdicts): questions with more than one verdict, in order of the runs."""
    per = df.filter(F.col(verdict).isNotNull()).groupBy("id").agg(F.count_distinct(verdict).alias("k"), F.array_sort(F.collect_list(F.struct(F.col(run), F.col(verdict)))).alias("v"))
    return per.filter("k > 1").select("id", F.array_join(F.transform("v", lambda x: x[verdict]), " / ").alias("verdicts"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after) of questions in both runs whose verdict changed."""
    a, b = before.select("id", F.col("verdict").alias("before")), after.select("id", F.col("verdict").alias("after"))
    return a.join(b, "id").filter(~F.col("before").eqNullSafe(F.col("after")))


def cited_records(df: DataFrame, key: list[str], cited: str = "cited_chunk_ids") -> DataFrame:
    """(key, source, ref, kind) of texts such as 'S1=<chunk id> || S6=status:<file>'."""
    one = df.select(*key, F.explode(F.split(F.col(cited), r"\s*\|\|\s*")).alias("x")).filter(F.trim("x") != "")
    ref = F.regexp_extract("x", r"^\s*[^=]*=\s*(.*?)\s*$", 1)
    return one.select(*key, F.regexp_extract("x", r"^\s*([^=]*?)\s*=", 1).alias("source"), F.regexp_replace(ref, "^status:", "").alias("ref"), F.when(ref.startswith("status:"), "status").otherwise("chunk").alias("kind"))


def reused(fresh: DataFrame, earlier: DataFrame, key: str = "id") -> DataFrame:
    """Fresh rows, and earlier ones for the keys that were not answered again."""
    return fresh.unionByName(earlier.join(fresh.select(key), key, "left_anti"), allowMissingColumns=True)


def to_answer(routed: DataFrame, earlier: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(questions to be answered, rows copied from an earlier run): only plain 'current' routes are copied, of questions that run has answered."""
    there = earlier.select(key).distinct().withColumn("_there", F.lit(True))
    split = routed.join(there, key, "left").withColumn("_copy", (F.col("routing") == "current") & F.coalesce("_there", F.lit(False)))
    copies = earlier.join(split.filter("_copy").select(key), key, "left_semi")
    return split.filter("not _copy").select(*routed.columns), copies


def parsed_judgement(reply: Column, n_facts: Column) -> Column:
    """struct<statuses, reason> of a judge's reply in JSON ({"facts": [{"status": ..}, ..], "reason": ..}) with one status per fact: positions it
    lacks, and statuses that are none of the three, count as missing, surplus ones are left out; a reply that is no JSON gives null."""
    got = F.from_json(reply, "facts array<struct<status:string>>, reason string", {"mode": "PERMISSIVE"})
    known = lambda i: F.coalesce(F.get(got["facts"], i - 1)["status"], F.lit("missing"))
    filled = F.when(n_facts > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_facts, F.lit(1))), lambda i: F.when(known(i).isin("present", "missing", "contradicted"), known(i)).otherwise("missing"))).otherwise(F.expr("array()").cast("array<string>"))
    return F.when(got["facts"].isNotNull() | got["reason"].isNotNull(), F.struct(filled.alias("statuses"), got["reason"].alias("reason")))


def judged_cost(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by.., calls, input_tokens, output_tokens, cost) of judge calls; a cost that is not known counts 0."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")], F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 8).alias("cost"))


# ---- checks of a question set ----------------------------------------------------------------------

def quote_pages(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, n, doc, pages): where each quote of a question stands in its source document, in normal form.

    ``pages`` is (doc, page, text). A quote found on no page may span two: it then counts for the first of them, unless it lies wholly in the second.
    """
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r" \| ")
    q = questions.select("id", F.posexplode(F.arrays_zip(split("source_doc").alias("d"), split("evidence_quote").alias("q"))).alias("n", "x")).select("id", (F.col("n") + 1).alias("n"), F.col("x.d").alias("doc"), squash(F.col("x.q")).alias("quote"))
    p = pages.select("doc", "page", squash(F.col("text")).alias("body"))
    p = p.withColumn("next", F.lead("body").over(Window.partitionBy("doc").orderBy("page")))
    own, two = F.col("body").contains(F.col("quote")), F.concat("body", "next").contains(F.col("quote")) & ~F.col("next").contains(F.col("quote"))
    j = q.filter(F.col("quote") != "").join(p, "doc")
    per = j.groupBy("id", "n", "doc").agg(F.array_sort(F.collect_set(F.when(own, F.col("page")))).alias("one"), F.array_sort(F.collect_set(F.when(F.coalesce(two, F.lit(False)), F.col("page")))).alias("two"))
    return per.select("id", "n", "doc", F.when(F.size("one") > 0, F.col("one")).otherwise(F.col("two")).alias("pages"))


def missing_numbers(answer: Column, quotes: Column) -> Column:
    """Numbers of an answer that its quotes do not hold."""
    return F.array_except(numbers_in(F.coalesce(answer, F.lit(""))), numbers_in(F.coalesce(quotes, F.lit(""))))


def check_questions(questions: DataFrame, register: DataFrame, found: DataFrame) -> DataFrame:
    """(id, type, outcome, problems): part counts; then per part an unknown document, a quote not found or on another page than stated; numbers
    without evidence; unknown or stale sources of plain questions.

    ``found`` is ``quote_pages`` of the same questions. A page given as 'none' is not checked where the document has no pages. Unanswerable
    questions are skipped. Nulls count as blank texts.
    """
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r" \| ")
    none = F.expr("array()").cast("array<string>")
    sizes = [F.size(split(c)) for c in ("source_doc", "page", "evidence_quote")]
    parts = questions.select("id", "type", F.posexplode(F.arrays_zip(split("source_doc").alias("d"), split("page").alias("p"))).alias("n", "x")).select("id", "type", (F.col("n") + 1).alias("n"), F.coalesce("x.d", F.lit("")).alias("doc"), F.coalesce("x.p", F.lit("")).alias("stated"))
    parts = parts.join(register.select(F.col("file_name").alias("doc"), F.col("status").alias("_status"), F.lit(True).alias("_known")), "doc", "left").join(found.select("id", "n", "pages"), ["id", "n"], "left")
    pages = F.coalesce("pages", F.expr("array()").cast("array<int>"))
    listed = F.array_join(pages.cast("array<string>"), ",")
    place = (
        F.when(F.col("_known").isNull(), F.concat("doc", F.lit(" not among the documents")))
        .when(F.size(pages) == 0, F.concat(F.lit("quote not found in "), "doc"))
        .when(~F.array_contains(pages.cast("array<string>"), F.col("stated")), F.concat(F.lit("quote on p"), listed, F.lit(" of "), "doc", F.lit(", not p"), "stated"))
    )
    plain = F.col("type").isin(*PLAIN_TYPES)
    source = F.when(plain & F.col("_known").isNull(), F.concat("doc", F.lit(" not in register"))).when(plain & F.col("_status").isin(*STALE), F.concat("type", F.lit(" question sourced from "), "_status", F.lit(" doc "), "doc"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n", c.alias("t"))))), lambda x: x["t"])
    per = parts.groupBy("id").agg(in_order(place).alias("_places"), in_order(source).alias("_sources"))
    gap = F.array_sort(missing_numbers(F.col("expected_answer"), F.col("evidence_quote")))
    numbers = F.when(F.size(gap) > 0, F.array(F.concat(F.lit("answer numbers not in quote: "), F.array_join(F.transform(gap, number_text), ", ")))).otherwise(none)
    even = (sizes[0] == sizes[1]) & (sizes[1] == sizes[2])
    uneven = F.array(F.concat(F.lit("parts "), F.concat_ws("/", *[n.cast("string") for n in sizes])))
    skip = F.coalesce(F.col("type") == "unanswerable", F.lit(False))
    problems = F.when(skip, none).when(even, F.concat("_places", numbers, "_sources")).otherwise(uneven)
    out = questions.join(per, "id").select("id", "type", problems.alias("_p"), skip.alias("_skip"))
    return out.select("id", "type", F.when(F.col("_skip"), "skipped").when(F.size("_p") > 0, "fail").otherwise("pass").alias("outcome"), F.array_join("_p", "; ").alias("problems"))
