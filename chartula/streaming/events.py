"""Structured Streaming: windowed counts of events, and chunk loads that arrive as files. An extension; the batch engine does not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import last_wins, upsert
from ..plans.tables import drop_path, list_names, shared_dir


def event_windows(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling window; the same plan for a table and, with a watermark, for a stream."""
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    own = own.withWatermark("ts", late) if late else own
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of all event files under ``path`` by a stream that ends when it has read them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    one_file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    source = source.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString()) if one_file else source.parquet(path)
    stream = event_windows(source, width, late)
    out = shared_dir(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    # updates, not only closed windows: those still open when the files end are given too, each as it stood last
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"{n} {t}" for n, t in stream.dtypes)
    rows = spark.read.schema(f"{schema}, batch int").parquet(f"{out}/rows")
    return last_wins(rows, ["start", "event_type"], "batch").drop("batch")


class ChunkLoader:
    """Upserts micro-batches of chunks into numbered versions of a table under ``path``; a batch that is run again changes nothing.

    A loader opened again, as after a restart of its stream, goes on from the last version that was written completely.
    """

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        known = [int(n[1:]) for n in list_names(spark, path) if n[:1] == "v" and n[1:].isdigit() and "_SUCCESS" in list_names(spark, f"{path}/{n}")]
        self.version = max(known, default=0)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], self.schema)

    def __call__(self, batch: DataFrame, _id: int) -> None:
        both = last_wins(upsert(self.table(), last_wins(batch, ["chunk_id"], "loaded_at"), "chunk_id"), ["chunk_id"], "loaded_at")
        both.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        if self.version > 1:
            drop_path(self.spark, f"{self.path}/v{self.version - 1}")
        self.version += 1

    def run(self, source: str) -> DataFrame:
        stream = self.spark.readStream.schema(self.schema).parquet(source)
        stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()
        return self.table()
