"""Table maintenance: upsert, change detection, stale delete, load report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``; of ties any (they should be identical)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))).filter("_r = 1").drop("_r")


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` replace those of ``target`` with the same key; the rest is kept. ``batch`` must be unique in ``key``."""
    return target.join(batch.select(key), key, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def upsert_keeping(target: DataFrame, batch: DataFrame, key: str, kept: str) -> DataFrame:
    """Like ``upsert``, but the column ``kept`` stays as stored (null for new rows)."""
    own = batch.drop(kept).join(target.select(key, kept), key, "left").select(*target.columns)
    return target.join(batch.select(key), key, "left_anti").select(*target.columns).unionByName(own)


def delta(target: DataFrame, batch: DataFrame, key: str, compared: str, vector: str, redo: bool = False) -> DataFrame:
    """``batch`` with ``change``: 'reuse' if the stored row has a vector and the same compared text, else 'new' or 'changed'."""
    stored = target.select(key, F.col(compared).alias("_was"), F.col(vector).isNotNull().alias("_has"), F.lit(True).alias("_there"))
    reuse = F.lit(not redo) & F.coalesce(F.col("_has"), F.lit(False)) & F.col("_was").eqNullSafe(F.col(compared))
    change = F.when(F.col("_there").isNull(), "new").when(reuse, "reuse").otherwise("changed")
    return batch.join(stored, key, "left").withColumn("change", change).drop("_was", "_has", "_there")


def stale(target: DataFrame, batch: DataFrame, key: str, doc: str) -> DataFrame:
    """Stored rows whose document is in the batch while they are not; other documents are untouched."""
    return target.join(batch.select(doc).distinct(), doc, "left_semi").join(batch.select(key), key, "left_anti")


def load_report(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per (doc, status): rows, rows with a vector, boilerplate rows; and one row of totals with null doc and status."""
    own = chunks.select("doc", F.col("embedding").isNotNull().alias("has"), F.coalesce(F.col("boilerplate"), F.lit(False)).alias("boiler"))
    per = own.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("has").cast("bigint")).alias("embedded"), F.sum(F.col("boiler").cast("bigint")).alias("boilerplate"))
    rows = per.join(documents.select(F.col("file_name").alias("doc"), "status"), "doc").select("doc", "status", "rows", "embedded", "boilerplate")
    sums = rows.agg(*[F.sum(c).alias(c) for c in ("rows", "embedded", "boilerplate")]).filter(F.col("rows").isNotNull())
    return rows.unionByName(sums.select(F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("status"), "rows", "embedded", "boilerplate"))
