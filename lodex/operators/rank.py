"""Scoring, boosts, filters, reranking and pages over result lists.

Result rows have query_id, query, id, score, and any of url, title, text, type, source."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COLLECTION_WEIGHTS, EVIDENCE_AVG3, EVIDENCE_TOP1, INTENTS, MIN_RELEVANCE, NON_STRICT_TYPES, PAGE_SIZE, RERANK_POOL, STUDENT_BODY_SIGNALS, TIMETABLE_SIGNALS
from ..functions.text import contains_any, haystack, held, lexical_b, lexical_f, normalize, phrases, strict_match, words_of
from .retrieve import ranked


def min_max(df: DataFrame, score: str = "score", as_: str = "norm") -> DataFrame:
    """Q5: over the query's results; the divisor is 1 when all scores are equal."""
    own = Window.partitionBy("query_id")
    low, high = F.min(score).over(own), F.max(score).over(own)
    return df.withColumn(as_, (F.col(score) - low) / F.when(high > low, high - low).otherwise(1.0))


def _prepared(df: DataFrame) -> DataFrame:
    """``norm`` may be there already; else it is worked out before Python makes Spark forget how rows lie."""
    for name in ("url", "text", "title", "type", "source"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    df = df if "norm" in df.columns else min_max(df)
    return held(held(df, _q=normalize("query"), _url=normalize("url")), _tokens=words_of(F.col("_q")))


def url_boost(exact: float, partial: float, none: float) -> Column:
    """The whole query (four letters or more) in the URL, else any token of five or more."""
    whole = F.lower(F.trim("query"))
    return F.when((F.length(whole) >= 4) & F.col("_url").contains(whole), exact).when(F.exists("_tokens", lambda t: (F.length(t) >= 5) & F.col("_url").contains(t)), partial).otherwise(none)


def fuse_f(df: DataFrame) -> DataFrame:
    """Q6: 0.72 vector + 0.28 lexical + additive boosts; score is replaced, its parts are kept."""
    df = held(_prepared(df), _hay=haystack("text", "url"))
    lexical = lexical_f(F.col("_q"), F.col("_tokens"), F.col("_hay"))
    timetable = F.when((F.col("type") == "timetable") & (F.col("score") >= 0.45), 0.25).otherwise(0.0)
    df = held(df, lexical_score=lexical).withColumn("vector_score", F.col("score"))
    return df.withColumn("score", F.round(0.72 * F.col("norm") + 0.28 * F.col("lexical_score") + url_boost(0.35, 0.15, 0.0) + timetable, 9))


def strict_filter(df: DataFrame, exempt: tuple[str, ...] = NON_STRICT_TYPES) -> DataFrame:
    """Q3, Q4. Needs fuse_f's columns."""
    return df.where(F.coalesce(F.col("type"), F.lit("")).isin(*exempt) | strict_match(F.col("_tokens"), phrases("query"), F.col("_hay")))


def boost_and_rank_f(df: DataFrame, strict: bool = True, least: float = MIN_RELEVANCE) -> DataFrame:
    """Q6, Q3, Q9: fused, filtered and ranked."""
    df = fuse_f(df)
    df = strict_filter(df) if strict else df
    return ranked(df.where(F.col("score") >= least), ["query_id"], "score", "id").drop("_q", "_tokens", "_url", "_hay", "norm")


def query_key(query: Column) -> Column:
    """A short stand-in for the query of a click: long texts needn't be shuffled to be met."""
    return F.sha2(F.lower(F.trim(query)), 256)


def boost_and_rank_b(df: DataFrame, clicks: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Q7, Q8: (0.70 vector + 0.30 lexical) times boosts by intent, plus a click nudge. clicks:
    (query, url, short_clicks, long_clicks), where query is lower-cased and trimmed, or ``key`` of the row's."""
    df = held(_prepared(df).withColumn("intent", intent(F.col("query"))), _hay=haystack(F.concat_ws(" ", "text", "title"), "url"))
    title = F.lower(F.coalesce("title", F.lit("")))
    by_intent = (
        F.when(F.col("intent") == "timetable", F.when(F.col("type") == "timetable", 1.5).otherwise(0.85))
        .when(F.col("intent") == "person", F.when((F.col("source") == "campus") & (F.col("type") == "webpage"), 1.3).otherwise(1.0) * F.when(contains_any(title, ("prof", "rector", "rektor")), 1.3).otherwise(1.0))
        .when(F.col("intent") == "document", F.when(F.col("type") == "pdf", 1.5).otherwise(1.0) * F.when(contains_any(title, ("satzung", "ordnung")), 1.2).otherwise(1.0))
        .otherwise(1.0)
    )
    boost = url_boost(1.4, 1.15, 1.0) * by_intent * F.when(F.col("source").isin("campus", "asta"), 1.1).otherwise(1.0)
    df = held(df, lexical_score=lexical_b(F.col("_q"), F.col("_tokens"), F.col("_hay"))).withColumn("vector_score", F.col("norm"))
    df = df.withColumn("score", (0.70 * F.col("norm") + 0.30 * F.col("lexical_score")) * boost)
    if clicks is not None:
        df = df.withColumn("_key", F.lower(F.trim("query")) if key is None else key)
        clicked = clicks.select(F.col("query").alias("_click_query"), F.col("url").alias("_click_url"), "short_clicks", "long_clicks")
        df = df.join(clicked, (F.col("_key") == F.col("_click_query")) & (F.col("url") == F.col("_click_url")), "left")
        df = df.withColumn("score", F.col("score") + nudge(F.col("short_clicks"), F.col("long_clicks"))).drop("_key", "_click_query", "_click_url", "short_clicks", "long_clicks")
    return ranked(df.withColumn("score", F.round("score", 9)), ["query_id"], "score", "id").drop("_q", "_tokens", "_url", "_hay", "norm")


def nudge(short: Column, long: Column) -> Column:
    """Q8."""
    return F.least(0.02 * F.coalesce(short, F.lit(0)) + 0.08 * F.coalesce(long, F.lit(0)), F.lit(0.2))


def intent(query: Column) -> Column:
    """Q14: the first kind of which a word occurs."""
    lower, out = F.lower(query), None
    for name, words in INTENTS.items():
        out = F.when(contains_any(lower, words), name) if out is None else out.when(contains_any(lower, words), name)
    return out.otherwise("general")


def query_type(query: Column) -> Column:
    """R10, Q15."""
    lower = F.lower(query)
    tokens = F.regexp_extract_all(lower, F.lit("([a-zA-ZäöüÄÖÜß]{3,})"), 1)
    return F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, TIMETABLE_SIGNALS))), "timetable").when(contains_any(lower, STUDENT_BODY_SIGNALS), "asta").otherwise("general")


def collection_weight(kind: Column, collection: Column) -> Column:
    """The weight of a collection under a query type; null for unknown collections."""
    return F.coalesce(*[F.when((kind == k) & (collection == c), w) for k, own in COLLECTION_WEIGHTS.items() for c, w in own.items()])


Scorer = Callable[[DataFrame], DataFrame]


def pair_scorer(predict: Callable[[list[tuple[str, str]]], list[float]]) -> Scorer:
    """A cross-encoder: any function of (query, title and start of the text) pairs, in batches."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(query, text))), dtype="float64")

    return lambda df: df.withColumn("ce", run("query", F.concat_ws(" ", "title", F.substring("text", 1, 500))))


def rerank_f(df: DataFrame, scorer: Scorer, pool: int = RERANK_POOL) -> DataFrame:
    """Q10: the first ``pool`` by the scorer's value, the rest as before; score is untouched.
    Only the pool is scored."""
    head, tail = scorer(df.where(F.col("rank") <= pool)), df.where(F.col("rank") > pool).withColumn("ce", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > pool, F.col("ce").desc_nulls_last(), "rank")
    return head.unionByName(tail).withColumn("rank", F.row_number().over(order))


def rerank_b(df: DataFrame, scorer: Scorer, pool: int = RERANK_POOL) -> DataFrame:
    """Q11: the pool's score becomes half score, half sigmoid of the scorer's value."""
    head = scorer(df.where(F.col("rank") <= pool)).withColumn("score", F.round(0.5 * F.col("score") + 0.5 / (1 + F.exp(-F.col("ce"))), 9))
    tail = df.where(F.col("rank") > pool).withColumn("ce", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > pool, F.when(F.col("rank") <= pool, -F.col("score")), "rank")
    return head.unionByName(tail).withColumn("rank", F.row_number().over(order))


def permute(df: DataFrame, order: list[int], pool: int = 10) -> DataFrame:
    """Q12: places of the first ``pool`` as a model lists them; unlisted ones keep their order."""
    listed = [i for i in dict.fromkeys(order) if 1 <= i <= pool]
    at = F.coalesce(*[F.when(F.col("rank") == v, i) for i, v in enumerate(listed)], F.lit(len(listed)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(at, "rank")))


def strong_evidence(df: DataFrame) -> DataFrame:
    """Q13: query_id, top1, avg3, strong."""
    out = df.where("rank <= 3").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.round(F.avg("score"), 9).alias("avg3"))
    return out.withColumn("strong", (F.col("top1") >= EVIDENCE_TOP1) | (F.col("avg3") >= EVIDENCE_AVG3))


def page_f(df: DataFrame, start: int, size: int) -> DataFrame:
    """Q16: rows start .. start + size - 1, and whether more follow."""
    counted = df.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return counted.withColumn("has_more", F.col("total") > start + size).where((F.col("rank") > start) & (F.col("rank") <= start + size))


def page_b(df: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Q16: page from 1, clamped to what there is."""
    df = df.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))
    df = df.withColumn("page", F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages")))
    return df.where((F.col("rank") > (F.col("page") - 1) * size) & (F.col("rank") <= F.col("page") * size))


def type_tab(df: DataFrame, tab: str) -> DataFrame:
    """Q18."""
    pdf = (F.col("type") == "pdf") | F.lower(F.coalesce("url", F.lit(""))).contains(".pdf")
    rules = {"all": F.lit(True), "timetable": F.col("type") == "timetable", "pdf": pdf, "website": F.col("type").isin("webpage", "website", "asta") & ~pdf}
    return df.where(rules[tab])


def sources(df: DataFrame, n: int = 5) -> DataFrame:
    """Q17: the first n results numbered from 1, with the URLs of their PDFs."""
    df = df if "pdf_sources" in df.columns else df.withColumn("pdf_sources", F.array().cast("array<struct<url:string,filename:string>>"))
    urls = F.transform(F.filter("pdf_sources", lambda p: p.url.isNotNull()), lambda p: p.url)
    return df.where(F.col("rank") <= n).select("query_id", F.col("rank").alias("number"), "title", "url", urls.alias("pdf_urls"))


def summary_prompt(df: DataFrame, n: int = 5, chars: int = 350) -> DataFrame:
    """Q20: the first n texts, numbered."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    held = df.where(F.col("rank") <= n).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return held.select("query_id", F.concat(F.lit("Frage: "), F.col("query"), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p.part), "\n")).alias("prompt"))


def attribution(url: Column, names: dict[str, str] | None = None) -> Column:
    """Q23: the shown name of the first host part that occurs, else the host itself."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    out = [F.when(host.contains(part), name) for part, name in (names or {"vorlesungen": "Stundenplan", "asta": "AStA"}).items()]
    return F.coalesce(*out, host)


def suggest(history: DataFrame, defaults: DataFrame, typed: str | None = None, n: int = 15) -> DataFrame:
    """Q22: history before defaults, each value once in its first place; with ``typed`` those that
    contain it and are not it. Inputs have value and place."""
    both = history.select("value", F.lit(0).alias("source"), "place").unionByName(defaults.select("value", F.lit(1).alias("source"), "place"))
    if typed is not None:
        both = both.where(F.lower("value").contains(typed.lower()) & (F.lower("value") != typed.lower()))
    first = both.groupBy("value").agg(F.min(F.struct("source", "place")).alias("at"))
    return first.select("value", "at.source", "at.place").orderBy("source", "place", "value").limit(n)
