"""Schemas, readers and writers of the engine's tables, and maintenance of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from ..functions.text import blank_to_null
from ..plans.tables import move_path

_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "array<float>": ArrayType(FloatType())}


def schema_of(text: str) -> StructType:
    """A schema from 'name type, ...' that needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


REGISTER = schema_of("file_name string, title string, doc_type string, topic string, entity string, issue_date date, updated_as_on date, status string, replaced_by string, amends string, in_scope string, notes string")
CHUNKS = schema_of(
    "chunk_id string, doc string, title string, status string, updated_as_on date, region string, chapter string, section string, para string, para_title string, part int, parts int, "
    "page_start int, page_end int, amendment_note string, boilerplate boolean, text string, embed_text string, embedding array<float>"
)
QUESTIONS = schema_of(", ".join(f"{c} string" for c in "id question expected_answer key_facts source_doc source_section page evidence_quote type verified auto_check".split()))
ITEMS = schema_of("doc string, seq int, label string, text string, page int, top double, marker string, in_picture boolean")
COUNTERS = ("refused", "exact_refusal", "citation_match", "expected_in_top5", "all_expected_in_top5")
AMOUNTS = ("answer_cost_usd", "judge_cost_usd", "answer_seconds")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header, quoted cells that may span lines, all values as text unless a schema is given; dates must be ISO, else null."""
    names = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    if schema is None:
        return names
    return names.select(*[normalised(F.col(f.name), f.dataType.simpleString()).alias(f.name) if f.name in names.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def normalised(c: Column, kind: str = "string") -> Column:
    """Trimmed, blank as null, and cast; values that cannot be cast are null."""
    t = blank_to_null(c.cast("string"))
    return t if kind == "string" else t.try_cast(kind)


def normalise_register(df: DataFrame) -> DataFrame:
    return df.select(*[(normalised(F.col(f.name), f.dataType.simpleString())).alias(f.name) for f in REGISTER.fields])


def in_scope(df: DataFrame) -> DataFrame:
    return df.filter(F.lower(F.trim(F.coalesce("in_scope", F.lit("")))).isin("yes", "partial"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunk records; blank lines are skipped, unknown keys ignored, missing ones null."""
    return spark.read.schema(CHUNKS).json(path).filter(F.col("chunk_id").isNotNull())


def write_chunks(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per document."""
    df.repartition("doc").write.mode("overwrite").partitionBy("doc").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, without columns whose names start with '_'; arrays and structs as JSON."""
    cols = [c for c in df.columns if not c.startswith("_")]
    kinds = dict(df.dtypes)
    df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in cols]).write.mode("overwrite").csv(path, header=True, escape='"')


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows with all columns in first-seen order; a column a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def typed_results(df: DataFrame) -> DataFrame:
    """Results read back from CSV: flags stay null where blank, amounts become 0; ``exact_refusal`` defaults to ``refused`` in older files."""
    if "exact_refusal" not in df.columns:
        df = df.withColumn("exact_refusal", F.col("refused") if "refused" in df.columns else F.lit(None).cast("string"))
    for c in COUNTERS:
        if c in df.columns:
            df = df.withColumn(c, normalised(F.col(c), "int"))
    for c in df.columns:
        if c in AMOUNTS:
            df = df.withColumn(c, F.coalesce(normalised(F.col(c), "double"), F.lit(0.0)))
        elif c.endswith("_tokens"):
            df = df.withColumn(c, F.coalesce(normalised(F.col(c), "bigint"), F.lit(0)))
    return df


def update_column(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` replaced where ``updates`` has the key; order of columns and other values are kept."""
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_set"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).select(*df.columns)


def replace_csv(df: DataFrame, path: str) -> None:
    """A CSV folder replaced by ``df``, which may have been read from it: written beside it, then swapped."""
    beside = f"{path.rstrip('/')}_new"
    write_csv(df, beside)
    move_path(df.sparkSession, beside, path)


def chosen(df: DataFrame, key: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the listed keys (all without a list), of these the first ``limit`` in order of the key."""
    own = df if not ids else df.filter(F.col(key).isin(list(ids)))
    return own if limit is None else own.orderBy(key).limit(limit)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, schema in (("register", REGISTER), ("chunks", CHUNKS)):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({cols}) USING parquet")


def column_counts(spark: SparkSession, database: str = "default") -> dict[str, int]:
    return {t.name: len(spark.catalog.listColumns(f"{database}.{t.name}")) for t in spark.catalog.listTables(database)}


def point_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; without one the query fails when it is run, naming the key."""
    found = df.filter(F.col(key) == value)
    missing = F.raise_error(F.lit(f"no row with {key} {value}")).cast("boolean")
    least = found.agg(F.count(F.lit(1)).alias("_n")).filter(F.when(F.col("_n") == 0, missing).otherwise(True))
    return found.join(F.broadcast(least)).drop("_n")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; refuses results of more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write the table instead")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])
