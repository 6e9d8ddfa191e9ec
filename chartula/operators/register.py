"""Document register: lineage, status labels, best matching document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..plans.tables import spread

SUPERSEDED = ("repealed", "withdrawn", "incorporated")
MIN_SCORE = 0.35
#: Queries compared with the register at once.
BLOCK_QUERIES = 10_000
#: Words without weight, aliases and months of the matcher.
STOPWORDS = ["the", "of", "on", "for", "and", "a", "an", "in", "to", "is", "are", "still", "force", "rbi", "reserve", "bank", "india", "directions", "direction", "what", "which", "where", "now", "it"]
ALIASES = {"md": "master", "nbfcs": "nbfc", "non": "nbfc", "banking": "nbfc", "companies": "nbfc", "know": "kyc", "customer": "kyc", "2nd": "second"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def one_per_file(register: DataFrame) -> DataFrame:
    """One row per ``file_name`` of a register delivered more than once: the greatest of its rows."""
    cols = [c for c in register.columns if c != "file_name"]
    won = register.groupBy("file_name").agg(F.max(F.struct(*cols)).alias("_w"))
    return won.select(*[F.col("file_name") if c == "file_name" else F.col("_w")[c].alias(c) for c in register.columns])


def lineage(register: DataFrame) -> DataFrame:
    """The register with what its ``replaced_by`` and ``amends`` point to (null where they lead nowhere)."""
    rep = register.select(F.col("file_name").alias("_rf"), F.col("title").alias("replaced_by_title"), F.col("issue_date").alias("replaced_by_issue_date"), F.col("entity").alias("_re"))
    par = register.select(F.col("file_name").alias("_af"), F.col("title").alias("amends_title"), F.col("status").alias("amends_status"))
    stated = F.regexp_extract(F.coalesce(F.col("notes"), F.lit("")), r"(?i)\b(?:repealed|withdrawn)\s+on\s+(\d{4}-\d{2}-\d{2})", 1)
    return (
        register.join(rep, F.col("replaced_by") == F.col("_rf"), "left").join(par, F.col("amends") == F.col("_af"), "left")
        .withColumn("status_date", F.when(stated != "", stated))
        .withColumn("replaced_for", F.when(F.col("_rf").isNotNull() & (F.col("_re") == "nbfc") & ~F.col("entity").eqNullSafe(F.lit("nbfc")), "NBFCs"))
        .drop("_rf", "_re", "_af")
    )


def status_label() -> Column:
    """Label of a row of ``lineage``. The wordings."""
    s = F.col("status")
    date = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("None"))
    gone = F.concat(
        F.upper(s), F.coalesce(F.concat(F.lit(" on "), F.col("status_date")), F.lit("")),
        F.when(F.col("replaced_by_title").isNotNull(), F.concat(F.lit(", replaced"), F.coalesce(F.concat(F.lit(" for "), F.col("replaced_for")), F.lit("")), F.lit(" by "), F.col("replaced_by_title"), F.lit(" (issued "), date("replaced_by_issue_date"), F.lit(")")))
        .when(F.col("amends_title").isNotNull() & F.col("amends_status").eqNullSafe(s), F.concat(F.lit(" (amendment to "), F.col("amends_title"), F.lit(", which is also "), s, F.lit(")"))).otherwise(""),
        F.lit(" - NOT in force"),
    )
    return (
        F.when(s == "active", "CURRENT")
        .when(s == "incorporated", F.concat(F.lit("INCORPORATED: its changes are already part of "), F.coalesce("amends_title", F.lit("the current direction"))))
        .when(s.isin("repealed", "withdrawn"), gone)
        .when(s == "reference", "REFERENCE: FAQ page, not a direction; check against current rules")
        .otherwise(F.upper(s))
    )


def status_text() -> Column:
    """The record of a row of ``lineage`` with ``status_label`` as lines of text; absent facts are skipped. The wordings."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    has = lambda c, text: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), text)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("file_name"), F.lit(")")),
        F.concat(F.lit("Status: "), F.col("status")),
        F.concat(F.lit("Status label: "), F.col("status_label")),
        has("status_date", F.concat(F.lit("Status date: "), F.col("status_date"))),
        F.concat(F.lit("Issue date: "), F.coalesce(iso("issue_date"), F.lit("not recorded"))),
        has("updated_as_on", F.concat(F.lit("Updated as on: "), iso("updated_as_on"))),
        has("replaced_by", F.concat(F.lit("Replaced by: "), F.coalesce("replaced_by_title", F.lit("None")), F.lit(" ("), F.col("replaced_by"), F.lit("), issued "), F.coalesce(iso("replaced_by_issue_date"), F.lit("None")))),
        has("amends", F.concat(F.lit("Amends: "), F.coalesce("amends_title", F.lit("None")), F.lit(" ("), F.col("amends"), F.lit(")"))),
        has("notes", F.concat(F.lit("Notes: "), F.col("notes"))),
    )


def match_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), F.lit(0))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(STOPWORDS)), lambda w: F.coalesce(F.try_element_at(alias, w), w)))


def document_tokens() -> Column:
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    dated = F.when(F.col("issue_date").isNotNull(), F.array(F.year("issue_date").cast("string"), F.lower(F.date_format("issue_date", "MMMM")))).otherwise(F.expr("array()").cast("array<string>"))
    return F.array_union(match_tokens(F.concat_ws(" ", "title", stem, "doc_type")), dated)


def as_source(row_text: Column | None = None) -> Column:
    """A document's record as one more source of an answer: (doc, header, amendment_note, text, score), with the greatest score."""
    return F.struct(
        F.col("file_name").alias("doc"), F.concat(F.coalesce("title", F.lit("")), F.lit(" ["), F.col("status_label"), F.lit("] › status record")).alias("header"),
        F.lit(None).cast("string").alias("amendment_note"), (status_text() if row_text is None else row_text).alias("text"), F.lit(1.0).alias("score"),
    )


def best_documents(register: DataFrame, queries: DataFrame, qid: str = "qid", text: str = "text", keep: int = 4) -> DataFrame:
    """(qid, file_name, score, rank, matched): the best documents for each query, ties by file name descending.

    Score: 0.75 of the query's tokens found, 0.25 of the similarity with the title, less 0.3 for each year or month the document lacks and
    0.1 for an amendment nobody asked for. ``matched`` marks a first rank of at least 0.35. An empty register gives no row. The queries are a stated
    set and go in blocks. The similarity, which has no index, adds 0.25 at most: documents that cannot reach the ``keep``-th best without it are
    left out first, exactly.
    """
    docs = spread(register.select("file_name", "title", "doc_type", document_tokens().alias("_d")), "file_name")
    q = queries.select(F.col(qid), F.col(text).alias("_q"), match_tokens(F.col(text)).alias("_t"))
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))  # a stated set of queries, sent in blocks of bounded size
    parts = [docs.join(F.broadcast(q.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b))) for b in range(blocks)]
    missing = F.array_except("_t", "_d")
    misses = F.size(F.filter(missing, lambda w: w.rlike(r"^(19|20)\d\d$") | w.isin(MONTHS)))
    unasked = (F.coalesce(F.col("doc_type"), F.lit("")) == "amendment") & ~F.array_contains("_t", "amendment")
    sure = 0.75 * F.size(F.array_intersect("_t", "_d")) / F.size("_t") - 0.3 * misses - 0.1 * unasked.cast("int")
    pairs = reduce(DataFrame.unionByName, parts).select(qid, "file_name", "title", "_q", F.size("_t").alias("_n"), F.when(F.size("_t") > 0, sure).otherwise(0.0).alias("_sure"))
    # with ties in the rounded score the file name decides, so the bound is taken a rounding step lower
    near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("_sure")))).filter(F.col("_r") <= keep)
    bound = near.groupBy(qid).agg(F.min(F.when(F.col("_r") == keep, F.col("_sure"))).alias("_least"))
    left = pairs.join(bound, qid).filter(F.col("_least").isNull() | (F.col("_n") == 0) | (F.col("_sure") + 0.2515 >= F.col("_least")))
    raw = F.col("_sure") + 0.25 * similarity(F.coalesce("_q", F.lit("")), F.coalesce("title", F.lit("")))
    scored = left.withColumn("score", F.when(F.col("_n") > 0, F.bround(raw, 3)).otherwise(0.0))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.desc("file_name"))
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return top.select(qid, "file_name", "score", "rank", ((F.col("rank") == 1) & (F.col("score") >= MIN_SCORE)).alias("matched"))
