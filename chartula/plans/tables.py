"""Reading tables, current rows, size-checked broadcasts and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many (narrow) rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file is one partition, and costly work per row would use one core.

    Tables of more partitions, as all large ones are, are left alone, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order``.

    One partially aggregated shuffle; a key delivered any number of times leaves each map task as one row. Rows
    that tie on ``order`` are told apart by ``cols`` (nulls first), so the result does not depend on the input's order.
    A null ``order`` loses against any value.
    """
    own = [c for c in cols if c not in keys]
    won = df.groupBy(*keys).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in own if c != order])).alias("_won"))
    return won.select(*[F.col(c) if c in keys else F.col("_won")[c].alias(c) for c in cols])


def current_chunks(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    """Per ``chunk_id`` the row with the greatest ``loaded_at``, reduced to ``cols``."""
    return latest(read(spark, sf_dir, "chunks"), ["chunk_id"], "loaded_at", cols)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (the join then shuffles both sides).

    ``df`` should be a written table, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only where that is unset and the session runs in one process (tests) a local one is made;
    on a cluster a machine's own folder would be lost with it, so there an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chartula-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get()
    path = f"{base.rstrip('/')}/chartula/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def move_path(spark: SparkSession, source: str, to: str) -> None:
    """Puts ``source`` in the place of ``to``."""
    a, fs = _file_system(spark, source)
    b, _ = _file_system(spark, to)
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it does not exist."""
    p, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete as soon as it can be seen: written beside its place and renamed."""
    p, fs = _file_system(spark, path)
    beside, _ = _file_system(spark, f"{p.getParent()}/_{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(text.encode())
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone
            pass


_kept: dict[tuple, str] = {}


def kept(name: str, df: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """``df`` written once per session and state of the files behind ``sources``, and read again after that: a change of any file makes it anew."""
    spark = df.sparkSession
    state = []
    for f in sorted(sources.inputFiles()):
        p, fs = _file_system(spark, f)
        status = fs.getFileStatus(p)
        state.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, hash(tuple(state)))
    if key not in _kept:
        path = shared_dir(spark)
        written(df, path, **options)
        _kept[key] = path
    return spark.read.schema(df.schema).parquet(_kept[key])


def written(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)
