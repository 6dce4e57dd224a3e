"""R1 over a stored vector index: k-means cells with an exact answer.

Rows lie in cells around centroids; a cell knows the greatest distance of a member from its centroid. On
unit vectors the cosine is 1 - d^2 / 2 for the distance d, and by the triangle inequality no member of a cell
is nearer to a query than the centroid's distance less the radius. So a search first ranks the rows of the
nearest cells, which gives a bound for the k-th best score, and then reads only the cells that can hold a
better row. What it returns equals the ranking of all rows by all rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import folder
from .meet import Vectors, meet_cells
from .retrieve import doubles, dot, ranked, unit_rows

#: Rows that centroids are fitted on at most (by a hash of the id; every row is indexed), cells at most,
#: and rows a file.
SAMPLE, CELLS, FILE_ROWS = 65_536, 4_096, 1 << 20
#: Cells are kept that miss the k-th best score by rounding alone.
SLACK = 1e-7


class VectorIndex:
    """Two stored tables: rows (cell, id, vec, norm) in a folder for each cell, and cells (cell, centroid,
    radius, n). Centroids are CELLS at most, so the second is small and is sent to all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells")

    @classmethod
    def build(cls, points: DataFrame, path: str | None = None, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """points (id, vec). Null and zero vectors have no cosine and are left out. The number of cells is
        the root of the number of rows, unless given."""
        spark = points.sparkSession
        path = path or folder(spark, "vectors")
        norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
        rows = points.select("id", doubles(F.col("vec")).alias("vec")).withColumn("norm", norm).where("norm > 0")
        rows = rows.withColumn("unit", F.transform("vec", lambda x: x / F.col("norm")))
        n = rows.count()
        if not n:
            rows.select("id", "vec", "norm", F.lit(0).alias("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
            spark.createDataFrame([], "cell int, centroid array<double>, radius double, n long").write.mode("overwrite").parquet(f"{path}/cells")
            return cls._of_empty(spark, path)
        cells = min(cells or math.isqrt(n), CELLS)
        share = min(1.0, SAMPLE / n)
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < math.ceil(share * 1_000_003)).select("unit").distinct()
        # copies shape no cells, and there are no more cells than distinct vectors
        cells = min(cells, sample.count())
        if cells > 1:
            model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample.select(array_to_vector("unit").alias("features")))
            centres = np.array(model.clusterCenters())
            placed = model.setPredictionCol("cell").transform(rows.withColumn("features", array_to_vector("unit"))).drop("features")
        else:
            centres = np.array([rows.select("unit").first().unit])
            placed = rows.withColumn("cell", F.lit(0))
        # a cell's rows go to files of FILE_ROWS, so that one crowded cell is many files
        sizes = F.broadcast(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")))
        spread = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / FILE_ROWS)))
        spread.repartition(spark.sparkContext.defaultParallelism * 4, "cell", "part").sortWithinPartitions("cell", "id").select("id", "vec", "norm", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
        stored = spark.read.parquet(f"{path}/rows").join(F.broadcast(at), "cell")
        far = distance(F.transform("vec", lambda x: x / F.col("norm")), F.col("centroid"))
        radii = stored.groupBy("cell").agg(F.max(far).alias("radius"), F.count(F.lit(1)).alias("n"))
        at.join(radii, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    @classmethod
    def _of_empty(cls, spark: SparkSession, path: str) -> VectorIndex:
        out = cls.__new__(cls)
        out.spark, out.path = spark, path
        out.rows = spark.createDataFrame([], "id long, vec array<double>, norm double, cell int")
        out.cells = spark.read.parquet(f"{path}/cells")
        return out

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, qvec, qnorm, cell, n, near): the greatest cosine that a member of each cell can have."""
        q = queries.select("query_id", doubles(F.col("qvec")).alias("qvec")).withColumn("qnorm", F.sqrt(dot(F.col("qvec"), F.col("qvec")))).where("qnorm > 0")
        least = F.greatest(F.lit(0.0), distance(F.transform("qvec", lambda x: x / F.col("qnorm")), F.col("centroid")) - F.col("radius") - SLACK)
        return q.crossJoin(F.broadcast(self.cells)).select("query_id", "qvec", "qnorm", "cell", "n", (1 - least * least / 2).alias("near"))

    def scored(self, pairs: DataFrame, decimals: int) -> DataFrame:
        """Scores of the rows of each (query, cell) pair. Pairs are sent to the rows, which stay where
        they are, and only their cells are read."""
        return self.rows.join(F.broadcast(pairs.select("query_id", "qvec", "qnorm", "cell")), "cell").select("query_id", "id", F.round(dot(F.col("vec"), F.col("qvec")) / (F.col("norm") * F.col("qnorm")), decimals).alias("score"))

    def plan(self, queries: DataFrame, k: int, decimals: int = 9) -> tuple[DataFrame, DataFrame]:
        """For one block of queries: the best k rows of each query's nearest cells, and the (query, cell)
        pairs that are left to read."""
        bound = self.bounds(queries)
        seen, begun = self._begun(queries, k)
        keys = ["query_id", "cell"]
        first = ranked(self.scored(bound.join(begun, keys), decimals), ["query_id"], "score", "id", k)
        return first, bound.join(self._rest(seen, first, k, decimals), keys)

    def _begun(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, cell, near, first), and the pairs of the nearest cells, which hold k rows between them."""
        bound = self.bounds(queries).select("query_id", "cell", "n", "near")
        seen = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("near"), "cell").rowsBetween(Window.unboundedPreceding, -1))
        bound = bound.withColumn("first", F.coalesce(seen, F.lit(0)) < k)
        return bound, bound.where("first").select("query_id", "cell")

    @staticmethod
    def _rest(bound: DataFrame, first: DataFrame, k: int, decimals: int) -> DataFrame:
        """(query_id, cell, least): the other pairs that can hold one of the best k."""
        least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        rest = bound.where("not first").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("near") >= F.col("least") - 10.0**-decimals))
        return rest.select("query_id", "cell", "least")

    def near(self, queries: DataFrame, pairs: DataFrame, k: int, decimals: int) -> DataFrame:
        """The best k rows of each (query_id, cell, least) pair, as products of matrices: a cell's rows meet the
        queries that want it. queries (query_id, vec, norm)."""
        cells = pairs.groupBy("query_id").agg(F.collect_list(F.struct("cell", "least")).alias("cells"))
        asked = queries.join(cells, "query_id").select("query_id", "vec", "norm", F.inline("cells"))
        return meet_cells(self.rows, asked, k, decimals, Vectors).withColumn("score", F.round("score", decimals))

    def top(self, queries: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        """R1. queries (query_id, qvec) -> query_id, id, score, rank; equal to ``dense_top``."""
        vectors = unit_rows(queries, "query_id", "qvec").where("norm > 0")
        bound, first = self._begun(queries, k)
        begun = ranked(self.near(vectors, first.withColumn("least", F.lit(None).cast("double")), k, decimals), ["query_id"], "score", "id", k)
        at = folder(self.spark, "begun")
        begun.write.mode("overwrite").parquet(at)
        begun = self.spark.read.schema(begun.schema).parquet(at)
        more = self.near(vectors, self._rest(bound, begun, k, decimals), k, decimals)
        return ranked(begun.drop("rank").unionByName(more), ["query_id"], "score", "id", k)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
