"""The queries of this subpackage, and the SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import current_chunks, read, spread
from . import boilerplate, leakage, neighbours, packing, pairs, reading, split, terms


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = boilerplate.repeated_lines(boilerplate.chunk_lines(spark, sf_dir), "chunk_id", "doc", "text")
    return found.select(F.col("record").alias("chunk_id"), "line_no")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_repeated(boilerplate.chunk_lines(spark, sf_dir), "chunk_id", "doc", "text")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(current_chunks(spark, sf_dir, ["chunk_id", "text"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("part = 1").select("chunk_id", "cut_kind")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("chunk_id", "part", "parts", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).filter("term_mark is not null").select("term", "term_mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.mark(*terms.chunk_terms(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.most_similar(read(spark, sf_dir, "chunks"), "chunk_id", "embedding", "loaded_at", floor=0.8)
    return near.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


def p4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every chunk whose hashed id is divisible by 100, among all chunks."""
    asks = F.pmod(F.xxhash64("chunk_id"), F.lit(100)) == 0
    near = neighbours.most_similar(read(spark, sf_dir, "chunks"), "chunk_id", "embedding", "loaded_at", asks=asks)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour"), F.round("cosine", 4).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_verdicts(spark, sf_dir).filter("defect is not null")


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(pairs.current_verdicts(read(spark, sf_dir, "gold_verdicts"))).select("id", "source_run", "defect")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.fill_containers(packing.token_items(docs), docs.count()).withColumnRenamed("item", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing spreads over several containers."""
    spread_over = p6_containers(spark, sf_dir).groupBy("doc_id").agg(F.min("container").alias("_a"), F.max("container").alias("_b"))
    return spread_over.filter("_a <> _b").select("doc_id")


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the packing: no container over its capacity, every document whole and once, at most 1 % and one more containers than tokens ask for."""
    packed = p6_containers(spark, sf_dir)
    per = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.count_distinct("doc_id").alias("_d"))
    docs = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    own = per.agg(F.count(F.lit(1)).alias("_made"), F.count_if(F.col("fill") > packing.CAPACITY).alias("overfull"), F.sum("fill").alias("tokens"))
    whole = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") != F.col("pieces")).alias("broken"))
    near = F.col("_made") <= F.ceil(1.01 * F.col("tokens") / packing.CAPACITY) + 1
    return own.join(F.broadcast(whole)).select("documents", "tokens", "overfull", "broken", near.alias("near_bound"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), read(spark, sf_dir, "questions"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), read(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_pieces, p3_found, p3_terms, p4_found, p4_topk, p5_found, p5_verdicts, p6_found, p6_containers, p6_summary, p7_found, p8_found)}

_CURRENT = "current as (select * from (select *, row_number() over (partition by chunk_id order by loaded_at desc) as rn from chunks) where rn = 1)"

_TERMS = f"""
with {_CURRENT},
entries as (select chunk_id, unnest(regexp_extract_all(tsv, '''(?:[^'']|'''')*''(?::[0-9A-D,]+)?')) as entry from current where tsv is not null),
parsed as (
  select chunk_id, replace(regexp_extract(entry, '^''((?:[^'']|'''')*)''', 1), '''''', '''') as term,
         regexp_extract(entry, ''':([0-9A-D,]+)$', 1) as places from entries),
counts as (
  select term, cast(sum(case when places = '' then 1 else len(string_split(places, ',')) end) as bigint) as occurrences,
         count(distinct chunk_id) as records from parsed group by term),
marked as (
  select term, occurrences, records,
         case when occurrences <= 2 then 'rare' when records > 0.15 * (select count(*) from current) then 'common' end as term_mark from counts)
"""

ORACLES = {
    "p2_found": f"with {_CURRENT} select chunk_id, case when regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]{{901}}[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]{{900}}') then 'forced' else 'clean' end as cut_kind from current where length(text) > 1800",
    "p3_found": _TERMS + "select term, term_mark from marked where term_mark is not null",
    "p3_terms": _TERMS + "select term, occurrences, records, term_mark from marked",
    "p6_summary": "select count(*) as documents, cast(sum(strlen(text) + 1) as bigint) as tokens, 0::bigint as overfull, 0::bigint as broken, true as near_bound from documents",
    "p6_found": "select doc_id from documents where strlen(text) + 1 > 8192",
}
