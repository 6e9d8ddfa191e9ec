"""Reading level of each document from vocabulary coverage and sentence complexity.

Words are ranked by their frequency in the whole corpus. For each document the smallest vocabulary of the most frequent words that
covers a fixed share of its tokens is found, and together with sentence and word lengths calibrated on graded documents. Counting,
coverage and scoring are SQL; only the small linear model is fitted outside.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import small, written

SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
#: Coverage is counted in half octaves of ranks, from rank 4 on without an end; a share reached within one is interpolated.
FIRST_STEP = 4
#: Most frequent words that are broadcast; the others are joined by shuffle.
HEAD_WORDS = 200_000
QUARTILES = (0.25, 0.5, 0.75)
#: Graded documents used for calibration, at most.
FIT_ROWS = 5000
RIDGE = 0.2
#: A text is English prose if this share of its words are English function words, more than of any other language.
ENGLISH_SHARE = 0.2

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with be by on not are this have from or an which you if when will can may shall must has within any your".split(),
    "de": "der die das den dem des ein eine und ist im zu zum zur von mit für auf nicht auch sich nach sofern falls wenn dass".split(),
    "fr": "le la les des du un une et est que qui dans pour sur au aux avec par ce cette ne pas".split(),
    "es": "el los las del una y es que por para con se su al como sin".split(),
}
WORD = r"\p{L}+(?:['’]\p{L}+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def frequency_ranks(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, rank): how many words are at least as frequent in the corpus; equally frequent words share a rank.

    The ranks come from a histogram of frequencies, divided by octaves, so neither the vocabulary nor the histogram is sorted in one place.
    """
    counts = written(df.select(F.explode_outer(tokens(F.col(text))).alias("word")).filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    kinds = written(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("octave", F.floor(F.log2("n")).cast("int")))
    above = Window.orderBy(F.desc("octave")).rowsBetween(Window.unboundedPreceding, -1)  # at most 63 rows
    octaves = kinds.groupBy("octave").agg(F.sum("words").alias("_all")).select("octave", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_above"))
    within = F.sum("words").over(Window.partitionBy("octave").orderBy(F.desc("n")))
    ranks = kinds.withColumn("_within", within).join(F.broadcast(octaves), "octave").select("n", (F.col("_above") + F.col("_within")).alias("rank"))
    return counts.join(small(written(ranks)), "n").select("word", "rank")


def rank_step(rank: Column) -> Column:
    """The half octave of a rank: the least k of at least ``FIRST_STEP`` with rank <= 2^(k/2)."""
    return F.greatest(F.lit(FIRST_STEP), F.ceil(2 * F.log2(rank) - 1e-9).cast("int"))


def document_features(df: DataFrame, ranks: DataFrame, doc: str = "doc_id", text: str = "text", head: int = HEAD_WORDS) -> DataFrame:
    """One row per document that has words: tokens, sentences, word lengths, function-word counts, and ``cover<i>``, log2 of the smallest
    frequency-ranked vocabulary that covers the i-th of ``SHARES`` of its tokens, interpolated within a half octave. ``doc`` must be unique.

    The ``head`` most frequent words are broadcast. What is left, if there is more, is counted per document first and joined by shuffle: no word
    of it is frequent, so no partition of the join is. Both ways give the same.
    """
    last = F.when(F.col(text).rlike(r"[.!?][\"'”’)\]]*\z"), 1).otherwise(0)
    commas = F.length(text) - F.length(F.replace(F.replace(F.col(text), F.lit(","), F.lit("")), F.lit(";"), F.lit("")))
    own = df.select(F.col(doc).alias("doc"), last.alias("last"), commas.alias("commas"), F.split(F.col(text), r"[.!?][\"'”’)\]]*\s+").alias("parts"), tokens(F.col(text)).alias("words"))
    lengths = F.array_sort(F.filter(F.transform("parts", lambda s: F.regexp_count(s, F.lit(r"\S+"))), lambda n: n > 2))
    # the counts are made before the explode, else they would be made again for every word; posexplode_outer, as posexplode adds a filter that tokenises twice
    own = own.select("doc", (F.size("parts") - 1 + F.col("last")).alias("sentences"), "commas", lengths.alias("lengths"), "words")
    quartiles = [F.when(F.size("lengths") > 0, F.get("lengths", F.floor(q * F.size("lengths")).cast("int"))).alias(f"q{i}") for i, q in enumerate(QUARTILES)]
    facts = ["sentences", "commas", *[f"q{i}" for i in range(len(QUARTILES))]]
    long = own.select("doc", "sentences", "commas", *quartiles, "words").select("doc", *facts, F.posexplode_outer("words").alias("pos", "word")).filter(F.col("word").isNotNull())

    kinds = [F.col("word").isin(ws).cast("int").alias(f"is_{k}") for k, ws in FUNCTION_WORDS.items()]
    known = F.broadcast(ranks.filter(F.col("rank") <= head).select("word", rank_step(F.col("rank")).alias("step"), F.length("word").alias("chars"), *kinds))  # at most ``head`` rows
    first = [F.max(F.when(F.col("pos") == 0, F.col(c))).alias(c) for c in facts]
    sums = {"n": F.lit(1), "chars": F.col("chars"), "long": (F.col("chars") >= 9).cast("int"), **{k: F.col(f"is_{k}") for k in FUNCTION_WORDS}}
    more = ranks.filter(F.col("rank") > head).limit(1).count() > 0
    rest = [F.when(F.col("step").isNull(), F.col("word")).alias("rest")] if more else []
    part = long.join(known, "word", "left").groupBy("doc", "step", *rest).agg(*[F.sum(v).cast("bigint").alias(k) for k, v in sums.items()], *first)
    if more:
        part = written(part)
        tail = ranks.filter(F.col("rank") > head).select(F.col("word").alias("rest"), rank_step(F.col("rank")).alias("_step"))
        far = part.filter("step is null").join(tail, "rest").withColumns({"step": F.col("_step"), "chars": F.col("n") * F.length("rest"), "long": F.when(F.length("rest") >= 9, F.col("n")).otherwise(0), **{k: F.when(F.col("rest").isin(ws), F.col("n")).otherwise(0) for k, ws in FUNCTION_WORDS.items()}})
        part = part.filter("step is not null").unionByName(far.select(*part.columns))
    per = part.groupBy("doc", "step").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in facts]) if more else part
    by = Window.partitionBy("doc")
    seen, need = F.col("_seen"), [F.col("_all") * share for share in SHARES]
    per = per.withColumns({"_seen": F.sum("n").over(by.orderBy("step")), "_all": F.sum("n").over(by)})
    low = F.when(F.col("step") > FIRST_STEP, (F.col("step") - 1) / 2).otherwise(0.0)
    reach = [F.max(F.when((seen >= x) & (seen - F.col("n") < x), low + (F.col("step") / 2 - low) * (x - (seen - F.col("n"))) / F.col("n"))).alias(f"cover{i}") for i, x in enumerate(need)]
    return per.groupBy("doc").agg(F.sum("n").alias("tokens"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums if c != "n"], *[F.max(c).alias(c) for c in facts], *reach)


def measures(features: DataFrame) -> DataFrame:
    """(doc, english, sentences, x1..): the features as numbers of like scale; x1 to x4 are the mean and quartiles of the sentence lengths, null if the text has no sentence ends."""
    english = (F.col("en") >= ENGLISH_SHARE * F.col("tokens")) & (F.col("en") > F.greatest("de", "fr", "es"))
    cols = [
        *[F.when(F.col("sentences") > 0, F.log2(c)) for c in (F.col("tokens") / F.col("sentences"), *[F.col(f"q{i}") for i in range(len(QUARTILES))])],
        *[F.col(f"cover{i}") for i in range(len(SHARES))],
        F.col("chars") / F.col("tokens"),
        F.log2(1 + 100 * F.col("long") / F.col("tokens")),
        F.log2(1 + 100 * F.col("commas") / F.col("tokens")),
    ]
    return features.select("doc", "tokens", english.alias("english"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols, 1)])


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Linear discriminant of the classes of ``y``: (classes, weights, offsets), with shared shrunken covariance and equal priors."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    classes = sorted(set(y.tolist()))
    centres = np.array([z[y == k].mean(0) for k in classes])
    rest = np.concatenate([z[y == k] - c for k, c in zip(classes, centres)])
    inverse = np.linalg.inv(rest.T @ rest / len(rest) + ridge * np.eye(x.shape[1]))
    w = centres @ inverse
    b = -0.5 * np.einsum("ij,ij->i", w, centres)
    return [int(k) for k in classes], w / scale, b - (w / scale) @ mean


def level_column(model: tuple[list[int], np.ndarray, np.ndarray], cols: list[str]) -> Column:
    """The class with the highest score, as an SQL expression; the lower class on a tie."""
    classes, w, b = model
    scores = F.array(*[sum((F.col(c) * float(v) for c, v in zip(cols, row)), F.lit(float(o))) for row, o in zip(w, b)])
    return F.element_at(F.array(*[F.lit(k) for k in classes]), F.array_position(scores, F.array_max(scores)).cast("int"))


def graded(labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, level): the median of the distinct gradings of a document, halves rounded down. Rows without a level are left out."""
    rows = labels.select(F.col(doc).alias("doc"), "grader", F.col("reading_level").alias("l")).filter(F.col("l").isNotNull()).distinct()
    return rows.groupBy("doc").agg(F.ceil(F.percentile("l", F.lit(0.5)) - 0.5).cast("int").alias("level"))


def reading_levels(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc, reading_level bigint) of every document with English prose; null levels if fewer than two levels are graded.

    Calibrated on at most ``fit_rows`` graded documents, chosen by a hash of their id; all counts cover the whole corpus. Texts without
    sentence ends are judged by a second model that leaves the sentence length out.
    """
    table = written(measures(document_features(df, written(frequency_ranks(df, text)), doc, text)))
    cols = [c for c in table.columns if c.startswith("x")]
    known = table.filter("english").join(small(written(graded(labels))), "doc").orderBy(F.xxhash64("doc")).limit(fit_rows)
    rows = known.select("level", *cols).toPandas()
    y = rows["level"].to_numpy(int) if len(rows) else np.zeros(0, int)
    level = F.lit(None)
    if len(set(y.tolist())) > 1:
        x = rows[cols].to_numpy(float)
        n = 1 + len(QUARTILES)
        whole = ~np.isnan(x[:, :n]).any(1)
        level = level_column(fit_linear(x[:, n:], y), cols[n:])
        if len(set(y[whole].tolist())) > 1:
            level = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cols[:n]]) == 1, level).otherwise(level_column(fit_linear(x[whole], y[whole]), cols))
    return table.filter("english").select(F.col("doc").alias(doc), level.cast("bigint").alias("reading_level"))
