"""Vector and term retrieval, and rank fusion."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from ..functions.constants import BM25_B, BM25_K1, CHALLENGER_DISCOUNT, DEDUP_PREFIX, LEAST_WEIGHT, RRF_K, STOPWORDS
from ..functions.text import TOKEN, normalize, runs_of
from ..scratch import folder
from .meet import Blocks, Terms, Vectors, meet, parts_for


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def ranked(df: DataFrame, by: list[str], score: str, id_: str, k: int | None = None, as_: str = "rank") -> DataFrame:
    """Rank from 1 by score, ties to the smaller id; WindowGroupLimit prunes before the shuffle."""
    out = df.withColumn(as_, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_)))
    return out.where(F.col(as_) <= k) if k else out


#: Queries that are sent to the points at once, and terms that are pushed to the scan of the postings.
QUERY_BLOCK, PUSHED_TERMS = 4_096, 1_000
#: Groups of points, up to which each has parts of its own.
FEW_GROUPS = 64
#: Texts whose terms a task counts at once.
COUNTED = 512


def dense_scores(points: DataFrame, queries: DataFrame, decimals: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    """points (id, vec, keep), queries (query_id, qvec), one block of them -> query_id, id, score, keep."""
    norm = queries.select("query_id", doubles(F.col("qvec")).alias("qvec")).withColumn("qn", F.sqrt(dot(F.col("qvec"), F.col("qvec"))))
    rows = points.select("id", doubles(F.col("vec")).alias("vec"), *keep).withColumn("pn", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    scored = rows.crossJoin(F.broadcast(norm)).select("query_id", "id", F.round(dot(F.col("vec"), F.col("qvec")) / F.nullif(F.col("pn") * F.col("qn"), F.lit(0.0)), decimals).alias("score"), *keep)
    return scored.where("score is not null")


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """Queries by blocks of about ``block``, by a hash of their id: what is broadcast has a bound."""
    n = max(1, -(-queries.count() // block))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def dense_top(points: DataFrame, queries: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """R1. points (id, vec), queries (query_id, qvec) -> query_id, id, score, rank."""
    return ranked(dense_near(points, queries, k, decimals), ["query_id"], "score", "id", k)


def unit_rows(rows: DataFrame, id_: str, vec: str, *keep: str) -> DataFrame:
    """(id, vec, norm) of the vectors that are there and hold no null. Components are shuffled as they are stored."""
    square = F.aggregate(doubles(F.col(vec)), F.lit(0.0), lambda s, x: s + x * x)
    return rows.select(id_, F.col(vec).alias("vec"), F.sqrt(square).alias("norm"), *keep).where("norm is not null")


def dense_near(points: DataFrame, queries: DataFrame, k: int, decimals: int = 9, group: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k best points of every query (and group, a kept column) in each part of the points: query_id, id, keep,
    score. Points are shuffled once, and a part meets all queries as one product of matrices. Where groups are few,
    a part has points of one group."""
    sizes = {r[0]: r[1] for r in points.groupBy(group).count().limit(FEW_GROUPS + 1).collect()} if group else {}
    few = 0 < len(sizes) <= FEW_GROUPS
    parts = parts_for(points, sum(sizes.values()) if few else points.count())
    near = meet(unit_rows(points, "id", "vec", *keep), unit_rows(queries, "query_id", "qvec"), parts, k, decimals, Vectors, group, keep, sizes if few and len(sizes) <= parts else None)
    return near.withColumn("score", F.round("score", decimals))


def postings(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf). Stop words go after the explode, inside code generation."""
    rows = docs.select(F.col(id_).alias("id"), F.explode(runs_of(normalize(text))).alias("term"))
    return rows.where(~F.col("term").isin(*STOPWORDS)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, leave: tuple[str, ...] = STOPWORDS, name: Callable[[str], int] | None = None, unique: bool = False) -> DataFrame:
    """docs (id, text) -> (id, dl, postings [(term, tf)]) of the documents with terms, counted where a text is read:
    texts aren't shuffled, but for those of an id that several rows have, which are one document. With ``name``
    terms are counted under the number it gives them; ``unique`` ids aren't looked through for repeated ones."""
    rows = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    if not unique and docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    kind = StructType([rows.schema["id"], *_parse_datatype_string(f"dl long, postings array<struct<term {'long' if name else 'string'}, tf int>>")])
    return rows.mapInArrow(_counter(leave, name), kind)


#: All signs that no token holds as spaces; signs beyond Latin-1 are in no token.
_SPACED = bytes(i if re.fullmatch(TOKEN, chr(i) * 2) else 32 for i in range(256))


def _words(texts: list[str]) -> pa.ListArray:
    """The runs of token characters of every text, in Latin-1, and what is empty beside them."""
    plain = [(t if t.isascii() else unicodedata.normalize("NFKC", t)).encode("latin-1", "replace").translate(_SPACED) for t in texts]
    return pc.ascii_split_whitespace(pa.array(plain, pa.binary()).view(pa.string()))


def _counter(leave: tuple[str, ...], name: Callable[[str], int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """White space needn't be collapsed here: no token holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                found = _words(batch.column("text").to_pylist())
                words = found.flatten().view(pa.binary()).dictionary_encode()
                doc, term = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy()), words.indices.to_numpy()
                shown = pa.array([w.decode("latin-1") for w in words.dictionary.to_pylist()], pa.string())
                left = pc.or_(pc.is_in(shown, pa.array(leave, pa.string())), pc.less(pc.utf8_length(shown), 2))
                good = ~left.to_numpy(zero_copy_only=False)
                kept, number = good[term], np.cumsum(good) - 1
                doc, term, shown = doc[kept], number[term[kept]], shown.filter(pa.array(good))
                if name:
                    numbers, at_number = np.unique(np.array([name(w) for w in shown.to_pylist()], np.int64), return_inverse=True)
                    shown, term = pa.array(numbers), at_number[term]
                n = max(1, len(shown))
                both, tf = np.unique(doc * n + term, return_counts=True)
                held, starts = np.unique(both // n, return_index=True)
                postings = pa.StructArray.from_arrays([shown.take(pa.array(both % n)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
                dl = np.bincount(doc, minlength=len(found))[held].astype(np.int64)
                ends = pa.array(np.append(starts, len(both)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(held)), pa.array(dl), pa.ListArray.from_arrays(ends, postings)], names=["id", "dl", "postings"])

    return run


class TermIndex:
    """Stored tables of a collection. documents (id, dl, postings [(term, tf)]), which many long queries meet. blocks (term, block, most, postings [(id, tf, dl)]): a block is
    the term's postings in one small group of documents, the same group for every term; ``most`` is the
    greatest weight in it but for the term's idf. Files are cut by ranges of (term, block), so a term's
    postings are found by the files' statistics and a common term lies in many of them. frequency
    (term, df), and one row of statistics. Nothing is counted again by a query."""

    #: Documents in a block, blocks that a pruned search reads at first, terms of a query that it is made for, and
    #: postings up to which a few queries simply read them all. They decide what is read, not what is found.
    BLOCK, FIRST, SHORT, DIRECT = 128, 4, 32, 1 << 20

    def __init__(self, spark: SparkSession, path: str, idf: bool = True, blocks: bool = True):
        self.spark, self.path, self.idf = spark, path, idf
        self.blocks = spark.read.parquet(f"{path}/blocks") if blocks else None
        self.documents = spark.read.parquet(f"{path}/documents")
        self.frequency = spark.read.parquet(f"{path}/frequency")
        row = spark.read.parquet(f"{path}/statistics").first()
        self.n, self.avgdl, self.k1, self.b, self.entries = row.n, row.avgdl or 1.0, row.k1, row.b, row.entries
        self._salt = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> TermIndex:
        return cls(spark, path, **options)

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, k1: float = BM25_K1, b: float = BM25_B, **options) -> TermIndex:
        """docs (id, text). Terms are counted where the texts are read, so that no text is shuffled.
        Without a path the index lies in a folder that goes with the application."""
        spark = docs.sparkSession
        path = path or folder(spark, "terms")
        counted(docs).write.mode("overwrite").parquet(f"{path}/documents")
        stored = spark.read.parquet(f"{path}/documents")
        about = stored.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum(F.size("postings")), F.lit(0)).alias("entries"))
        about.withColumn("k1", F.lit(float(k1))).withColumn("b", F.lit(float(b))).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
        own = stored.select("id", "dl", F.inline("postings"))
        own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/frequency")
        if options.get("blocks", True):
            row = spark.read.parquet(f"{path}/statistics").first()
            block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-row.n // cls.BLOCK)))).alias("block")
            grouped = own.groupBy("term", block).agg(F.max(saturation(k1, b, row.avgdl or 1.0)).alias("most"), F.array_sort(F.collect_list(F.struct("id", F.col("tf").cast("long").alias("tf"), "dl"))).alias("postings"))
            grouped.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        return cls(spark, path, **options)

    def _postings(self, blocks: DataFrame, *keep: str) -> DataFrame:
        return blocks.select(*keep, "term", F.inline("postings"))

    def weights(self) -> DataFrame:
        """(id, term, w): BM25 weights of every posting."""
        return self.documents.select("id", "dl", F.inline("postings")).join(self.frequency, "term").select("id", "term", self.weight().alias("w"))

    def idf_of(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5)) if self.idf else F.lit(1.0)

    def weight(self) -> Column:
        return saturation(self.k1, self.b, self.avgdl) * self.idf_of(F.col("df"))

    def top(self, queries: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        """R2. queries (query_id, text) -> query_id, id, score, rank. Queries of a few words whose terms
        are common read the blocks that can hold a hit, others all postings of their terms; the rows are
        the same. The terms of few queries are looked up first and filter the scan, so one search is two
        small jobs and one over its own postings; many long ones meet the documents in parts."""
        wanted = self.wanted(queries)
        if self.blocks is None:
            return self.top_of_documents(wanted, k, decimals)
        few = wanted.limit(PUSHED_TERMS + 1).collect()
        if len(few) > PUSHED_TERMS:
            longest = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            return self.top_pruned(wanted, k, decimals) if longest <= self.SHORT else self.top_of_documents(wanted, k, decimals)
        own = F.col("term").isin(sorted({r.term for r in few}))
        df = {r.term: r.df for r in self.frequency.where(own).collect()}
        terms = self.spark.createDataFrame([(r.query_id, r.term, df[r.term]) for r in few if r.term in df], StructType([wanted.schema["query_id"], wanted.schema["term"], StructField("df", LongType())]))
        longest = max(Counter(r.query_id for r in few).values(), default=0)
        search = self._pruned if longest <= self.SHORT and sum(df.values()) > self.DIRECT else self._of_all
        return search(self.blocks.where(own), terms, k, decimals)

    @staticmethod
    def wanted(queries: DataFrame) -> DataFrame:
        return postings(queries, "query_id").select(F.col("id").alias("query_id"), "term")

    def _held(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks of the wanted terms, as far as a filter of the scan can tell, and the terms with idf."""
        few = [r.term for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        blocks, frequency = self.blocks, self.frequency
        if len(few) <= PUSHED_TERMS:
            blocks, frequency = blocks.where(F.col("term").isin(few)), frequency.where(F.col("term").isin(few))
        return blocks, wanted.join(frequency, "term").select("query_id", "term", "df")

    def _scores(self, held: DataFrame, decimals: int) -> DataFrame:
        """held (query_id, df, term, postings) -> query_id, id, score."""
        hits = self._postings(held, "query_id", "df").select("query_id", "id", self.weight().alias("w"))
        return hits.groupBy("query_id", "id").agg(F.round(F.sum("w"), decimals).alias("score"))

    def top_of_all(self, wanted: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        return self._of_all(*self._held(wanted), k, decimals)

    def top_of_documents(self, wanted: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        """All queries against all documents, in parts of the documents: only the best k of a part leave it.
        Terms go as numbers of which no two are equal."""
        return self._met(wanted, k, decimals, Terms)

    def _met(self, wanted: DataFrame, k: int, decimals: int, kind: type[Terms]) -> DataFrame:
        number = self._numbering()
        asked = wanted.join(self.frequency, "term").select("query_id", number(F.col("term")).alias("term"), self.idf_of(F.col("df")).alias("idf"))
        asked = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("p")).select("query_id", F.col("p.term").alias("terms"), F.col("p.idf").alias("counts"))
        rows = self.documents.select("id", F.transform("postings", lambda p: number(p.term)).alias("terms"), F.col("postings.tf").cast("array<double>").alias("counts"))
        k1, b, avgdl = self.k1, self.b, self.avgdl
        near = meet(rows, asked, parts_for(rows, self.n, self.entries), k, decimals, lambda t: kind(t, k1, b, avgdl))
        return ranked(near.withColumn("score", F.round("score", decimals)), ["query_id"], "score", "id", k)

    def _numbering(self) -> Callable[[Column], Column]:
        """A 64-bit hash, salted until no two terms share one."""
        if self._salt is None:
            salt = 0
            while self.frequency.select(F.xxhash64("term", F.lit(salt)).alias("h")).groupBy("h").count().where("count > 1").limit(1).count():
                salt += 1
            self._salt = salt
        salt = self._salt
        return lambda term: F.xxhash64(term, F.lit(salt))

    def _of_all(self, blocks: DataFrame, terms: DataFrame, k: int, decimals: int) -> DataFrame:
        return ranked(self._scores(blocks.join(terms, "term"), decimals), ["query_id"], "score", "id", k)

    def read_plan(self, blocks: DataFrame, terms: DataFrame, k: int, decimals: int) -> tuple[DataFrame, DataFrame]:
        """The best k rows of each query's FIRST blocks by bound, and the (query, block) pairs that can
        still hold one of the best k. A block's bound is the sum of its terms' greatest weights; all of a
        document's postings lie in one block, so scores of a block are whole. Bounds are added up as whole
        numbers: they are worked out twice, and sums of doubles by another order of rows could put equal blocks
        (copies of one text) at other places, so that one is read twice or never."""
        most = F.ceil(F.col("most") * self.idf_of(F.col("df")) * (1 << 30)).cast("long")
        bounds = blocks.select("term", "block", "most").join(terms, "term").groupBy("query_id", "block").agg((F.sum(most) / (1 << 30)).alias("bound"))
        bounds = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
        first = bounds.where(F.col("place") <= self.FIRST).select("query_id", "block")
        best = ranked(self._scores(blocks.join(terms, "term").join(first, ["query_id", "block"]), decimals), ["query_id"], "score", "id", k)
        least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        rest = bounds.where(F.col("place") > self.FIRST).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2 * 10.0**-decimals))
        return best, rest.select("query_id", "block")

    def top_pruned(self, wanted: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        """Many queries of a few words against blocks. A plan by stored blocks would shuffle the postings of every
        (query, block) pair, which grow with the square of the rows; here documents are dealt to parts once, blocks are
        made and left out inside a part, and only the best k of a part leave it."""
        return self._met(wanted, k, decimals, Blocks)

    def _pruned(self, blocks: DataFrame, terms: DataFrame, k: int, decimals: int) -> DataFrame:
        best, rest = self.read_plan(blocks, terms, k, decimals)
        more = ranked(self._scores(blocks.join(terms, "term").join(rest, ["query_id", "block"]), decimals), ["query_id"], "score", "id", k)
        return ranked(best.drop("rank").unionByName(more.drop("rank")), ["query_id"], "score", "id", k)


def saturation(k1: float, b: float, avgdl: float) -> Column:
    """BM25's part of a posting without the idf."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))


def rrf(lists: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, id, rank) lists, rank from 1."""
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in lists.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def accumulate(hits: DataFrame, limit: int | None = None, k: int = RRF_K, legacy_url_key: bool = False, one_per_url_per_list: bool = False) -> DataFrame:
    """R5. hits (query_id, variant, collection, rank, weight, url, id, ...): summed w / (k + rank)
    by URL, the first hit's row kept. Hits without URL stand for themselves unless
    ``legacy_url_key``. Every chunk of a URL adds to it unless ``one_per_url_per_list``, which counts
    the best of each list. Collections under the least weight are pruned first (R11)."""
    url = F.coalesce("url", F.lit(""))
    key = url if legacy_url_key else F.when(url == "", F.col("id").cast("string")).otherwise(url)
    hits = hits.where(F.col("weight") >= LEAST_WEIGHT).withColumn("key", key)
    if one_per_url_per_list:
        hits = ranked(hits.withColumn("_r", -F.col("rank")), ["query_id", "variant", "collection", "key"], "_r", "id", 1, "_n").drop("_r", "_n")
    row = F.struct(*[c for c in hits.columns if c not in ("weight", "key")])
    out = hits.groupBy("query_id", "key").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min_by(row, F.struct("variant", "collection", "rank", "id")).alias("hit"))
    return ranked(out, ["query_id"], "score", "key", limit)


def quota(hits: DataFrame, weights: dict[str, float], total: int) -> DataFrame:
    """R7. hits (query_id, source, id, score): each source's share of the limit, then the cut."""
    whole = sum(w for w in weights.values() if w > 0)
    limit = F.coalesce(*[F.when(F.col("source") == s, max(1, int(total * w / whole))) for s, w in weights.items() if w > 0], F.lit(0))
    held = ranked(hits, ["query_id", "source"], "score", "id", as_="in_source").where(F.col("in_source") <= limit)
    return ranked(held, ["query_id"], "score", "id", total)


def challenge(original: DataFrame, expanded: DataFrame, discount: float = CHALLENGER_DISCOUNT, prefix: int = DEDUP_PREFIX) -> DataFrame:
    """R8. Lists (query_id, url, text, id, score) merged by URL and start of the text; a row of the
    expanded query wins only with its discounted score, but keeps its own."""
    both = original.withColumn("second", F.lit(0)).unionByName(expanded.withColumn("second", F.lit(1)))
    power = F.when(F.col("second") == 1, F.col("score") * discount).otherwise(F.col("score"))
    key = [F.col("query_id"), F.coalesce("url", F.lit("")).alias("url_key"), F.substring(F.coalesce("text", F.lit("")), 1, prefix).alias("text_key")]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(power, -F.col("second"), -F.col("id"))).alias("hit"))
    return best.select("hit.*")


def dedup_max(hits: DataFrame, decimals: int = 9) -> DataFrame:
    """R9. (query_id, url, id, score, weight): weighted scores, the best row of each URL."""
    scored = hits.withColumn("score", F.round(F.col("score") * F.col("weight"), decimals))
    return scored.groupBy("query_id", "url").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("hit")).select("query_id", "url", "hit.id", "hit.score")


def siblings(first: DataFrame, lectures: DataFrame, most: int = 10) -> DataFrame:
    """R13. first (query_id, id, program, day); up to ``most`` other lectures of the same programme
    and day, in id order, as one text. Only the first most + 1 of a programme and day are joined, one
    of which may be the lecture itself; tasks cut their own before they are shuffled."""
    group = ["program", "day"]
    few = lectures.select(*group, F.struct("id", "text").alias("x")).withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("x.id"))).where(F.col("n") <= most + 1)
    held = few.groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    near = first.join(held, group).withColumn("xs", F.slice(F.filter("xs", lambda x: x.id != F.col("id")), 1, most)).where(F.size("xs") > 0)
    return near.select("query_id", "id", F.array_join(F.transform("xs", lambda x: x.text), "; ").alias("context"))
