"""Lines repeated across the records of one source.

Three passes over a written table of line keys: mergeable heavy-hitter summaries per source propose candidates, an exact count verifies
them, and the confirmed ones are removed. A key is a hash of (source, wording); the wording leaves out case, spacing, punctuation,
decoration and numbers and folds characters that are mistaken for each other when a page is read by machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import current_chunks, small, written

MIN_RECORDS = 10
#: Lines per summary. A summary tracks 6144 items with an error of at most 3.5 n / 8192, here under ``MIN_RECORDS``.
SHARD_LINES, SUMMARY_ITEMS = 20_000, 8192

#: Characters mistaken for each other, folded to the first of each group.
MISREAD = ["ec", "oa0", "il1|", "nu"]
#: Names of months, which with a number beside them are dates filled in.
MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r"|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|januar|februar|märz|juni|juli|oktober|dezember"
    r"|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
)


def wording(line: Column) -> Column:
    """The letters of a line in one normal form; empty if it has none. Null gives null.

    Numbers and dates go (digits not part of a word); a single 0 or 1 next to a letter is a misread letter.
    """
    s = F.lower(line)
    word = r"(?<![\p{L}\p{N}_])" + MONTH + r"(?![\p{L}\p{N}_])"
    dates = rf"{word}\.?(?=,?[\s-]+(?:de\s+)?\d)|(?<=\d)(?:st|nd|rd|th|er|\.)?[\s-]+(?:de\s+)?{word}"
    s = F.when(s.rlike(r"\d"), F.regexp_replace(s, dates, " ")).otherwise(s)  # only lines with numbers hold dates
    s = F.regexp_replace(s, r"(?<![\p{L}0-9])([01])(?=\p{L}{1,})|(?<=\p{L})([01])(?![0-9])", "$1$2\u0001")
    s = F.regexp_replace(s, r"0\u0001", "o")
    s = F.regexp_replace(s, r"1\u0001", "l")
    s = F.regexp_replace(s, r"[^\p{L}]+", "")
    return F.translate(s, "".join(g[1:] for g in MISREAD), "".join(g[0] * (len(g) - 1) for g in MISREAD))


def line_keys(df: DataFrame, record: str, source: str, text: str) -> DataFrame:
    """(record, source, text, keys): one key per line of ``text`` split at newlines, null for lines without letters.

    Rows with a null text have null keys; a null source counts as a source of its own.
    """
    def key(line: Column) -> Column:
        w = wording(line)
        return F.when(w != "", F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit("\u0000")), w))

    return df.select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(text).alias("text"), F.transform(F.split(F.col(text), "\n", -1), key).alias("keys"))


def repeated(keyed: DataFrame, min_records: int = MIN_RECORDS) -> DataFrame:
    """(key, records): the lines that stand in at least ``min_records`` distinct records of one source. ``keyed`` should be a written table.

    Summaries are held per source and, for sources with more than ``SHARD_LINES`` lines, per hash shard of the key, so that no group
    grows with the input; rows are merged map-side first. A summary never misses a key of that count, and the exact count of the candidates
    decides.
    """
    own = keyed.select("record", "source", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys")).filter(F.size("keys") > 0)
    large = (
        own.groupBy("source").agg(F.sum(F.size("keys")).alias("lines")).filter(F.col("lines") > SHARD_LINES)
        .select(F.col("source").alias("_s"), F.ceil(F.col("lines") / SHARD_LINES).cast("int").alias("_shards"))
    )
    lines = own.join(small(written(large)), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("_shards", F.lit(1)).alias("shards"), F.explode("keys").alias("key"))
    summaries = lines.groupBy("source", F.pmod("key", "shards").alias("shard")).agg(F.expr(f"approx_top_k_accumulate(key, {SUMMARY_ITEMS})").alias("summary"))
    found = summaries.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {SUMMARY_ITEMS * 3 // 4})")).alias("x"))
    candidates = small(written(found.filter(F.col("x.count") >= min_records).select(F.col("x.item").alias("key"))))
    return (
        own.select(F.explode("keys").alias("key")).join(candidates, "key", "left_semi")
        .groupBy("key").agg(F.count(F.lit(1)).alias("records")).filter(F.col("records") >= min_records)
    )


def repeated_lines(df: DataFrame, record: str, source: str, text: str, min_records: int = MIN_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(keyed, found): the written table of ``line_keys``, and (record, line_no, records) of every line to be removed. ``record`` must be unique."""
    keyed = written(line_keys(df, record, source, text))
    confirmed = small(written(repeated(keyed, min_records)))
    found = keyed.select("record", F.posexplode("keys").alias("line_no", "key")).join(confirmed, "key").select("record", F.col("line_no").cast("bigint").alias("line_no"), "records")
    return keyed, found


def without_repeated(df: DataFrame, record: str, source: str, text: str, min_records: int = MIN_RECORDS) -> DataFrame:
    """(record, source, text, removed): every record's text without its repeated lines, and how many were removed. A null text stays null."""
    keyed, found = repeated_lines(df, record, source, text, min_records)
    gone = found.groupBy("record").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("gone"), i.cast("bigint")))
    return keyed.join(gone, "record", "left").select(
        F.col("record").alias(record), F.col("source").alias(source),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("removed"),
    )


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_chunks(spark, sf_dir, ["chunk_id", "doc", "text"])
