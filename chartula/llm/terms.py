"""Frequency of every term, kept up to date by signed deltas.

A store holds runs of persistent counts ``(bucket, term, occurrences, records)``, partitioned by a hash bucket of the term, and a manifest that
names the current runs and the number of records. A change feed has one row per record that was added, changed or deleted, with the old and
the new search vector; an unchanged record yields nothing. Each change becomes ``-1`` for the terms of the old vector and ``+1`` for those of the
new one, is aggregated map-side first, and the sums are written as a run of their own, so that a small change writes little. Runs that are no
longer small beside the one before them are merged with it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import drop_path, list_names, read, read_text, shared_dir, write_text, written

RARE_MAX = 2
COMMON_SHARE = 0.15
#: Terms a bucket of a run should hold.
BUCKET_TERMS = 500_000
#: A run is merged into the one before it if that is less than so many times as long.
MERGE_AT = 4

#: One lexeme of a search vector: quoted, quotes doubled, with positions or without.
LEXEME = r"'([^']*+(?:''[^']*+)*+)'(?::([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*))?"


def lexemes(tsv: Column) -> Column:
    """array<struct<term, occurrences, records>> of a search vector written as text; null gives null.

    A lexeme without positions occurs once. A lexeme listed twice in one vector adds its occurrences and counts as
    one record (only its first entry carries ``records = 1``). An empty text gives an empty array.
    """
    terms = F.transform(F.regexp_extract_all(tsv, F.lit(LEXEME), F.lit(1)), lambda t: F.replace(t, F.lit("''"), F.lit("'")))
    places = F.transform(
        F.regexp_extract_all(tsv, F.lit(LEXEME), F.lit(2)),
        lambda p: F.when(p == "", 1).otherwise(F.size(F.split(p, ","))).cast("bigint"),
    )
    once = F.size(F.array_distinct(terms)) == F.size(terms)
    first = F.when(once, F.transform(terms, lambda _: F.lit(1))).otherwise(
        F.transform(terms, lambda t, i: F.when(F.array_position(terms, t) == i + 1, 1).otherwise(0))
    )
    return F.transform(
        F.arrays_zip(terms.alias("t"), places.alias("o"), first.alias("r")),
        lambda x: F.struct(x["t"].alias("term"), x["o"].alias("occurrences"), x["r"].cast("bigint").alias("records")),
    )


def signed_deltas(changes: DataFrame, old: str = "old_tsv", new: str = "new_tsv") -> DataFrame:
    """(term, occurrences, records) changes of a feed with the old and new vector of each record.

    Added records have a null old vector, deleted ones a null new vector; records whose vectors are equal are skipped.
    Other columns of the feed are ignored. Terms whose changes cancel out are left out.
    """
    feed = changes.select(F.col(old).alias("_old"), F.col(new).alias("_new")).filter(~F.col("_old").eqNullSafe(F.col("_new")))
    minus = F.transform(lexemes(F.col("_old")), lambda x: F.struct(x["term"].alias("term"), (-x["occurrences"]).alias("occurrences"), (-x["records"]).alias("records")))
    none = F.expr("array()").cast("array<struct<term:string,occurrences:bigint,records:bigint>>")
    both = F.concat(F.coalesce(minus, none), F.coalesce(lexemes(F.col("_new")), none))
    return (
        feed.select(F.explode_outer(both).alias("x"))  # not explode, which adds a filter that parses every vector twice
        .filter(F.col("x").isNotNull())
        .groupBy(F.col("x.term").alias("term"))
        .agg(F.sum("x.occurrences").alias("occurrences"), F.sum("x.records").alias("records"))
        .filter((F.col("occurrences") != 0) | (F.col("records") != 0))
    )


def summed(rows: DataFrame, keep_negative: bool = False) -> DataFrame:
    """One row per term; terms that fall to zero are left out, ``keep_negative`` keeps what is still to be taken from an earlier run."""
    out = rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return out.filter((F.col("records") != 0) | (F.col("occurrences") != 0)) if keep_negative else out.filter((F.col("records") > 0) | (F.col("occurrences") > 0))


class TermStore:
    """Persistent counts under ``path``. A store opened again goes on where it was; readers keep the runs they opened.

    ``m<version>.json`` tells the runs (name, rows) and the number of records; it is written under another name and renamed, and the greatest one
    counts. A run that is no longer named is dropped one version later, so a reader of the version before can end.
    """

    SCHEMA = "term string, occurrences bigint, records bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, bucket_terms: int = BUCKET_TERMS):
        self.spark, self.path, self.bucket_terms = spark, path.rstrip("/"), bucket_terms
        known = [int(n[1:-5]) for n in list_names(spark, self.path) if n.startswith("m") and n.endswith(".json")]
        self.version = max(known, default=0)
        self.state = json.loads(read_text(spark, f"{self.path}/m{self.version}.json")) if known else {"runs": [], "records": 0, "dropped": []}

    @property
    def records(self) -> int:
        """Number of records counted, those without a vector included."""
        return self.state["records"]

    def _runs(self, runs: list) -> DataFrame:
        none = self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*[f"{self.path}/{name}" for name, _ in runs]) if runs else none

    def counts(self) -> DataFrame:
        return self._merged(self.state["runs"])

    def _merged(self, runs: list) -> DataFrame:
        own = self._runs(runs).select("term", "occurrences", "records")
        return own if len(runs) < 2 else summed(own)

    def _write(self, rows: DataFrame, name: str, size: int) -> int:
        """Writes a run with as many buckets as its size asks for; returns its rows."""
        buckets = max(1, -(-size // self.bucket_terms))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return self._runs([(name, 0)]).count()

    def apply(self, changes: DataFrame, old: str = "old_tsv", new: str = "new_tsv", was: str | None = None, now: str | None = None) -> TermStore:
        """Writes one change feed as a run and publishes the next version; an empty feed changes nothing but the version.

        ``was`` and ``now`` name boolean columns that tell whether the record existed before and exists now; without them a null vector is no record.
        """
        version = self.version + 1
        there = lambda flag, vector: F.col(flag) if flag else F.col(vector).isNotNull()
        more = changes.agg(F.sum(there(now, new).cast("bigint") - there(was, old).cast("bigint"))).first()[0] or 0
        deltas = written(signed_deltas(changes, old, new))
        runs = list(self.state["runs"])
        rows = deltas.count()
        if rows:
            merged = [("", rows)]
            while runs and runs[-1][1] < MERGE_AT * sum(n for _, n in merged):
                merged.insert(0, runs.pop())
            gone = self._runs(merged[:-1]).select("term", "occurrences", "records").unionByName(deltas.select("term", "occurrences", "records"))
            body = summed(gone, keep_negative=bool(runs)) if len(merged) > 1 else deltas
            name = f"run={version}"
            runs.append([name, self._write(body, name, sum(n for _, n in merged))])
        names = {n for n, _ in runs}
        state = {"runs": runs, "records": self.records + more, "dropped": [n for n, _ in self.state["runs"] if n not in names]}
        write_text(self.spark, f"{self.path}/m{version}.json", json.dumps(state))
        for name in self.state["dropped"]:
            drop_path(self.spark, f"{self.path}/{name}")
        self.version, self.state = version, state
        return self


def mark(counts: DataFrame, total: int, rare_max: int = RARE_MAX, common_share: float = COMMON_SHARE) -> DataFrame:
    """Counts with ``term_mark``: 'rare', 'common' or null, ``total`` being the number of records."""
    own = F.when(F.col("occurrences") <= rare_max, "rare").when(F.col("records") > common_share * F.lit(total), "common")
    return counts.select("term", "occurrences", "records", own.alias("term_mark"))


def versions(chunks: DataFrame, cut) -> DataFrame:
    """Per chunk_id whether it was there at ``cut`` (``was``), the vector current then and, if that is another one, the vector current at the end.

    One shuffle with map-side aggregation. Rows with a null ``loaded_at`` count as the oldest.
    """
    at = F.col("loaded_at")
    row = F.struct(at, F.col("tsv"))
    early = at.isNull() | (at <= F.lit(cut).cast(chunks.schema["loaded_at"].dataType))
    both = chunks.groupBy("chunk_id").agg(F.max(F.when(early, row)).alias("old"), F.max(row).alias("new"))
    changed = ~F.col("old.tsv").eqNullSafe(F.col("new.tsv"))
    return both.select(F.col("old").isNotNull().alias("was"), F.col("old.tsv").alias("old_tsv"), changed.alias("changed"), F.when(changed, F.col("new.tsv")).alias("new_tsv"))


def chunk_terms(spark: SparkSession, sf_dir: str, cut: str = "2020-01-01 00:00:00") -> tuple[DataFrame, int]:
    """(counts, number of current chunks) of the chunks table, loaded in two steps.

    The first step holds what had arrived by ``cut``; the second one only what was added or changed after it. ``cut`` has
    no influence on the result.
    """
    chunks = read(spark, sf_dir, "chunks").select("chunk_id", "loaded_at", "tsv")
    both = written(versions(chunks, cut))
    store = TermStore(spark, shared_dir(spark))
    no, none = F.lit(False), F.lit(None).cast("string")
    store.apply(both.filter("was").select(no.alias("before"), none.alias("old_tsv"), F.col("old_tsv").alias("new_tsv"), F.lit(True).alias("after")), was="before", now="after")
    store.apply(both.filter("changed or not was").select(F.col("was").alias("before"), "old_tsv", "new_tsv", F.lit(True).alias("after")), was="before", now="after")
    return store.counts(), store.records
