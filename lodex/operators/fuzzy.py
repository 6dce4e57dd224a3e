"""Typo correction of queries against a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import STOPWORDS
from ..functions.text import normalize

PIECES = r"([a-zA-ZäöüÄÖÜß0-9]+|\s+|[^\w])"


def vocabulary(spark: SparkSession, *synonyms: dict[str, list[str]]) -> DataFrame:
    """Whole normalised keys, and the words of their synonyms."""
    rows = [(k, True) for s in synonyms for k in s] + [(w, False) for s in synonyms for v in s.values() for w in v]
    table = spark.createDataFrame(rows, "text string, whole boolean").withColumn("n", normalize("text"))
    return table.select(F.explode(F.when(F.col("whole"), F.array("n")).otherwise(F.split("n", " "))).alias("word")).where("word <> ''").distinct()


def deletions(word: Column, most: int) -> Column:
    """The word and every word that up to ``most`` deletions make of it, each once."""
    def one_less(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array())

    found = [F.array(word)]
    for _ in range(most):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], one_less))))
    return F.array_distinct(F.concat(*found))


def near_words(a: DataFrame, b: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance) of distinct words at a Levenshtein distance up to ``most``. Both sides are
    indexed by what up to ``most`` deletions leave of them, and joined by equality: words as near as
    that share one such rest. The distance is then computed for the pairs that meet. Long words have
    many rests, of which only the hashes are joined; the distance settles what meets by chance."""
    left = a.select("a", F.explode(F.transform(deletions(F.col("a"), most), lambda w: F.xxhash64(w))).alias("rest"))
    right = b.select("b", F.explode(F.transform(deletions(F.col("b"), most), lambda w: F.xxhash64(w))).alias("rest"))
    met = left.join(right, "rest").where(F.abs(F.length("a") - F.length("b")) <= most).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def nearest_words(words: DataFrame, vocab: DataFrame, most: int = 2) -> DataFrame:
    """T4, T5: for each word the vocabulary word at the smallest distance up to ``most``, ties by
    the word."""
    near = near_words(words.select(F.col("w").alias("a")).distinct(), vocab.select(F.col("word").alias("b")).distinct(), most)
    return near.groupBy(F.col("a").alias("w")).agg(F.min(F.struct("distance", F.col("b").alias("fix"))).alias("m")).select("w", "m.distance", "m.fix")


def correct(queries: DataFrame, vocab: DataFrame, most: int = 2, least: int = 4) -> DataFrame:
    """T5. queries (query_id, query) with corrected and was_corrected. Separators stay, a first
    capital stays, stop words, short and known words are left alone."""
    pieces = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(PIECES), 1)).alias("pos", "piece")).withColumn("w", F.lower(F.trim("piece")))
    wanted = pieces.where((F.length("w") >= least) & ~F.col("w").isin(*STOPWORDS)).join(vocab, F.col("w") == F.col("word"), "left_anti")
    fixes = nearest_words(wanted, vocab, most)
    joined = pieces.join(fixes, "w", "left")
    fix = F.when(F.substring(F.trim("piece"), 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring("fix", 1, 1)), F.expr("substring(fix, 2)"))).otherwise(F.col("fix"))
    out = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(fix, F.col("piece")).alias("p")))).alias("ps"), F.bool_or(F.col("fix").isNotNull()).alias("was_corrected"))
    fixed = out.select("query_id", F.array_join(F.transform("ps", lambda x: x.p), "").alias("corrected"), "was_corrected")
    return queries.join(fixed, "query_id", "left").select("query_id", "query", F.coalesce("corrected", "query").alias("corrected"), F.coalesce("was_corrected", F.lit(False)).alias("was_corrected"))
