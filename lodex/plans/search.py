"""The two search engines as plans over collections of a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import COLLECTION_WEIGHTS, LEAST_WEIGHT, MODULE_SYNONYMS, PROGRAM_SYNONYMS
from ..functions.encode import Embed, encode_query, hashed_embedding
from ..functions.text import expand_f, variants
from ..operators import fuzzy, rank, retrieve
from ..operators.retrieve import TermIndex
from ..operators.vectors import VectorIndex
from ..sources.readers import Config
from ..sources.store import Store


class Collection:
    """Points of a store's collection with its term index; either kind of retrieval may be absent."""

    def __init__(self, points: DataFrame, terms: TermIndex | None = None, vectors: VectorIndex | None = None):
        self.points, self.terms, self.vectors = points, terms, vectors
        self.has_dense = "embedding" in points.columns

    @classmethod
    def of(cls, store: Store, name: str) -> Collection:
        points = store.read(name)
        return cls(points, store.terms(name) if "text" in points.columns else None, store.vectors(name) if "embedding" in points.columns else None)

    def hybrid(self, queries: DataFrame, limit: int, k: int = 60) -> DataFrame:
        """Both lists over-fetched to twice the limit and fused; whichever exists otherwise."""
        lists = {}
        if self.terms:
            lists["sparse"] = (self.terms.top(queries.select("query_id", "text"), 2 * limit), 1.0)
        if self.has_dense:
            asked = queries.select("query_id", "qvec")
            dense = self.points.where("embedding is not null").select("id", F.col("embedding").alias("vec"))
            lists["dense"] = (self.vectors.top(asked, 2 * limit) if self.vectors else retrieve.dense_top(dense, asked, 2 * limit), 1.0)
        if not lists:
            return self.points.select(F.lit(None).cast("string").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return retrieve.ranked(retrieve.rrf(lists, k), ["query_id"], "score", "id", limit)


class SearchEngine:
    """The configured engine: correction, expansion, retrieval by source quota, additive boosts."""

    def __init__(self, spark: SparkSession, store: Store, config: Config, embed: Embed | None = None):
        self.spark, self.config, self.embed = spark, config, embed or hashed_embedding()
        self.programs, self.modules = config.program_synonyms or PROGRAM_SYNONYMS, config.module_synonyms or MODULE_SYNONYMS
        self.sources = [s for s in config.sources if s.search_weight > 0 and store.exists(s.collection)]
        self.collections = {s.name: Collection.of(store, s.collection) for s in self.sources}

    def _queries(self, rows: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame([(i, q, encode_query(q, self.embed)) for i, q in rows], "query_id string, text string, qvec array<float>")

    def prepare(self, query: str) -> tuple[str, str]:
        """Corrected query and its expansion."""
        vocab = fuzzy.vocabulary(self.spark, self.programs, self.modules)
        row = fuzzy.correct(self.spark.createDataFrame([("q", query)], "query_id string, query string"), vocab)
        got = row.select("corrected", expand_f(F.col("corrected"), self.programs, self.modules).alias("expanded")).first()
        return got.corrected, got.expanded

    def search(self, query: str, total_limit: int = 50, expansion: bool = True, strict: bool = True, scorer: rank.Scorer | None = None) -> DataFrame:
        fixed, expanded = self.prepare(query)
        expanded = expanded if expansion else fixed
        whole = sum(s.search_weight for s in self.sources)
        parts = []
        for s in self.sources:
            limit = max(1, int(total_limit * s.search_weight / whole))
            own = self.collections[s.name]
            shown = own.points.select("id", "url", "title", "text", "type")
            hits = own.hybrid(self._queries([("q", fixed)]), limit).join(shown, "id").drop("rank")
            if s.result_type != "timetable" and expanded != fixed:
                hits = retrieve.challenge(hits, own.hybrid(self._queries([("q", expanded)]), limit).join(shown, "id").drop("rank")).drop("second")
            parts.append(hits.withColumn("source", F.lit(s.name)))
        if not parts:
            return self.spark.createDataFrame([], "query_id string, query string, id long, score double, rank int")
        found = retrieve.ranked(reduce(DataFrame.unionByName, parts), ["query_id"], "score", "id", total_limit).drop("rank").withColumn("query", F.lit(fixed))
        out = rank.boost_and_rank_f(found, strict, self.config.relevance_min_score)
        return rank.rerank_f(out, scorer) if scorer else out


class ServiceSearch:
    """The service engine: query variants over weighted collections, accumulated RRF, boosts."""

    def __init__(self, spark: SparkSession, store: Store, embed: Embed | None = None, clicks: DataFrame | None = None, weights: dict[str, dict[str, float]] | None = None):
        """weights: collection weights by query type, for stores with other names."""
        self.spark, self.store, self.embed, self.clicks = spark, store, embed or hashed_embedding(), clicks
        self.weights = weights or COLLECTION_WEIGHTS
        self._held: dict[str, Collection] = {}

    def _collection(self, name: str) -> Collection:
        if name not in self._held:
            self._held[name] = Collection.of(self.store, name)
        return self._held[name]

    def search(self, query: str, total_limit: int = 150, semester: str | None = None, scorer: rank.Scorer | None = None, legacy_url_key: bool = False) -> DataFrame:
        row = self.spark.range(1).select(F.lit(query).alias("q")).select(rank.query_type(F.col("q")).alias("kind"), variants(F.col("q")).alias("v")).first()
        weights = {c: w for c, w in self.weights[row.kind].items() if w >= LEAST_WEIGHT}
        lists = []
        queries = self.spark.createDataFrame([(str(i), v, encode_query(v, self.embed)) for i, v in enumerate(row.v)], "query_id string, text string, qvec array<float>")
        for name, w in weights.items():
            own = f"starplan_{semester}" if name == "starplan_timetable" and semester else name
            own = own if self.store.exists(own) else name
            if not self.store.exists(own):
                continue
            c = self._collection(own)
            keep = [x for x in ("url", "title", "text", "type", "source", "program", "day", "time") if x in c.points.columns]
            hits = c.hybrid(queries, max(10, total_limit)).join(c.points.select("id", *keep), "id")
            lists.append(hits.select(F.lit("q").alias("query_id"), F.col("query_id").cast("int").alias("variant"), F.lit(own).alias("collection"), "rank", F.lit(w).alias("weight"), "id", *keep))
        if not lists:
            return self.spark.createDataFrame([], "query_id string, query string, id long, score double, rank int")
        merged = retrieve.accumulate(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists), total_limit, legacy_url_key=legacy_url_key)
        found = merged.select("query_id", "score", *[F.col(f"hit.{c}").alias(c) for c in merged.schema["hit"].dataType.names if c not in ("query_id", "rank", "variant")]).withColumn("query", F.lit(query))
        out = rank.boost_and_rank_b(found, self.clicks)
        return rank.rerank_b(out, scorer) if scorer else out

    def page(self, query: str, page: int = 1, **options) -> DataFrame:
        return rank.page_b(self.search(query, **options), page)
