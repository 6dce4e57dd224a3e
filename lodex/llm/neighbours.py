"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length and turned by three rounds of random signs and fast Hadamard
transforms; the nearest signed axis is a hash. A bucket of a table is a pair of such hashes of two
rotations, so 64 dimensions have 16,384 buckets a table. Rows are dealt into shards of bounded size,
each with its own ``tables`` tables over all of its rows. Every query visits every shard: it probes
there the buckets of each table with the greatest joint score (the sum of its components along both
axes), and the rows collected, without repeats, are ranked by the exact distance of the original
vectors in double precision.

How many buckets a query probes follows from what it finds: it doubles them until a row as far in
angle as the farthest of its nearest rows so far would have been collected with probability ``sure``.
That probability is a property of the tables, and is measured once for each dimension on random pairs
of vectors at given angles. So neighbours that are near cost few probes, and those that hardly stand out from
the rest cost many, at last all buckets. Of the k nearest rows of all shards, one shard
holds about its share: the rule looks at that many rows, and two deviations more.

So rows are shuffled once, whatever the number of tables, no bucket is ever a group of the shuffle,
and a bucket that holds a third of all rows costs a shard no more than its own rows. A shard's rows are
in memory while its queries stream past; only k rows of a shard leave for a query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, on either side; vectors of other lengths are no candidates of each other; rows that repeat
both id and vector count once; of rows with one id but several vectors each is a candidate, the
nearest counts, and as queries the least vector is used; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, PROBES, SURE, K, SEED = 40, 4, 0.8, 10, 17
#: Rows of a shard at most; small tables are cut into shards of FEW_ROWS, FEW_SHARDS at most.
SHARD_ROWS, FEW_ROWS, FEW_SHARDS = 65_536, 4_096, 8
#: Queries that are answered together.
QUERY_BLOCK = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def pseudo_rotation(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """Rows under the pseudo-rotation, filled up with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, number, x.shape[1]]).choice([-1.0, 1.0], (3, size)).astype(np.float32)
    y = np.zeros((len(x), size), np.float32)
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


@cache
def as_matrix(number: int, dim: int) -> np.ndarray:
    return pseudo_rotation(np.eye(dim, dtype=np.float32), number)


def turned(x: np.ndarray, number: int) -> np.ndarray:
    """For few dimensions the transform of the axes, once, is the quicker way to the same numbers."""
    return x @ as_matrix(number, x.shape[1]) if x.shape[1] <= 128 else pseudo_rotation(x, number)


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis + (1 if negative)."""
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def axes_of(dim: int) -> int:
    return 2 << max(0, (dim - 1).bit_length())


def buckets(x: np.ndarray, table: int) -> np.ndarray:
    """The bucket of each unit vector: the signed axes of the table's two rotations."""
    return nearest_axis(turned(x, 2 * table)) * axes_of(x.shape[1]) + nearest_axis(turned(x, 2 * table + 1))


@cache
def staircase(axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) of two axes that can be among the ``probes`` best pairs: (i + 1)(j + 1) - 1
    pairs are at least as good."""
    i, j = np.meshgrid(np.arange(min(axes, probes)), np.arange(min(axes, probes)), indexing="ij")
    keep = (i + 1) * (j + 1) <= probes
    return i[keep], j[keep]


def probes_of(q: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets of the greatest joint score for each unit vector."""
    axes = axes_of(q.shape[1])
    i, j = staircase(axes, probes)
    best = []
    for number, most in ((2 * table, i.max() + 1), (2 * table + 1, j.max() + 1)):
        y = turned(q, number)
        near = np.stack([y, -y], axis=2).reshape(len(y), -1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :most]
        best.append((order, np.take_along_axis(near, order, axis=1)))
    (a, sa), (b, sb) = best
    found = a[:, i] * axes + b[:, j]
    if len(i) > probes:
        joint = sa[:, i] + sb[:, j]
        found = np.take_along_axis(found, np.argpartition(-joint, probes - 1, axis=1)[:, :probes], axis=1)
    return found


@cache
def reaches(dim: int, tables: int, sure: float, pairs: int = 1000) -> list[float]:
    """The cosine from which on a row is collected with probability ``sure``, for PROBES, 2 PROBES,
    4 PROBES ... buckets a table, as long as these aren't all. On pairs of random vectors of each cosine
    the other vector's bucket has a rank among all buckets; it is collected if the rank in any table
    is under the number of probes."""
    rng, every = np.random.default_rng(SEED), axes_of(dim) ** 2
    levels, cosines = [], np.linspace(0.96, 0.0, 49)
    while PROBES << len(levels) < every:
        levels.append(PROBES << len(levels))
    if dim == 1:
        return [1.0] * len(levels)
    missed = np.ones((len(cosines), len(levels)))
    for c, cosine in enumerate(cosines):
        a, b = unit(rng.normal(size=(pairs, dim))), unit(rng.normal(size=(pairs, dim)))
        b = unit(b - (a * b).sum(axis=1, keepdims=True) * a) * np.sqrt(1 - cosine**2) + cosine * a
        y, z = turned(a, 0), turned(a, 1)
        first, second = np.concatenate([y, -y], axis=1), np.sort(np.concatenate([z, -z], axis=1), axis=1)
        u, v = turned(b, 0), turned(b, 1)
        at, to = np.abs(u).argmax(axis=1), np.abs(v).argmax(axis=1)
        row = np.arange(pairs)
        score = y[row, at] * np.sign(u[row, at]) + z[row, to] * np.sign(v[row, to])
        rank = np.array([(second.shape[1] - np.searchsorted(s, t - f + 1e-6)).sum() for f, s, t in zip(first, second, score)])
        missed[c] = [(1 - (rank < p).mean()) ** tables for p in levels]
    enough = missed <= 1 - sure
    return [float(cosines[np.flatnonzero(own)[-1]]) if own.any() else 1.0 for own in np.minimum.accumulate(enough, axis=0).T]


class Shard:
    """The rows of a shard with their tables: bucket numbers in order, and the row of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tables: int = TABLES, sure: float = SURE):
        self.ids, self.x, self.tables, self.unit = ids, x, [], unit(x)
        self.reaches = reaches(x.shape[1], tables, sure)
        codes = np.empty((tables, len(x)), np.int32)
        for at in range(0, len(x), 4096):
            for t in range(tables):
                codes[t, at : at + 4096] = buckets(self.unit[at : at + 4096], t)
        for code in codes:
            order = np.argsort(code, kind="stable").astype(np.int32)
            self.tables.append((code[order], order))

    def collected(self, q: np.ndarray, probes: int) -> np.ndarray:
        """[query, row]: the rows that the probes collect for unit vectors."""
        found = np.zeros((len(q), len(self.x)), bool)
        for t, (code, order) in enumerate(self.tables):
            near = probes_of(q, t, probes).astype(np.int32)
            low = np.searchsorted(code, near)
            size = np.searchsorted(code, near, side="right") - low
            of = size.sum(axis=1)
            low, size = low.reshape(-1), size.reshape(-1)
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found[np.repeat(np.arange(len(q)), of), order[at]] = True
        return found

    def best(self, at: np.ndarray, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest of the rows ``at``, ties to the smaller id; the
        query's own id is left out, and of each id the nearest row counts."""
        at = at[self.ids[at] != qid]
        with np.errstate(over="ignore"):
            score = np.sqrt(((self.x[at] - q) ** 2).sum(axis=1))
        if len(at) > 4 * k + 64:
            some = np.flatnonzero(score <= np.partition(score, 4 * k)[4 * k])
            if len(np.unique(self.ids[at[some]])) >= k:
                at, score = at[some], score[some]
        order = np.lexsort((self.ids[at], score))
        at, score = at[order], score[order]
        first = np.sort(np.unique(self.ids[at], return_index=True)[1])[:k]
        return at[first], score[first]

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, look: int | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query: ids and distances of the k nearest rows found, and how many rows were
        ranked last. ``look``: the nearest rows whose angles decide whether to probe on."""
        u, out, open_ = unit(q), [None] * len(q), np.arange(len(q))
        look = min(k, look or k)
        for level in range(len(self.reaches) + 1):
            if not len(open_):
                break
            last = level == len(self.reaches)
            masks = None if last else self.collected(u[open_], PROBES << level)
            further = []
            for row, i in enumerate(open_.tolist()):
                some = np.arange(len(self.x)) if last else np.flatnonzero(masks[row])
                at, score = self.best(some, qid[i], q[i], k)
                if last or len(at) >= look and (self.unit[at[:look]] @ u[i]).min() >= self.reaches[level]:
                    out[i] = (self.ids[at], score, len(some))
                else:
                    further.append(i)
            open_ = np.array(further, np.int64)
        return out


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def valid(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def runs(batches):
    """(dim, shard, kind, id array, matrix) of each run of equal keys in the sorted batches."""
    for batch in batches:
        keys = [np.asarray(batch.column(i)) for i in range(3)]
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            part = batch.slice(a, b - a)
            yield int(keys[0][a]), int(keys[1][a]), int(keys[2][a]), np.asarray(part.column(3)), matrix(part.column(4))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of ``vectors`` (id, vec) to each row
    for which ``is_query`` holds, itself left out."""
    given = vectors.where("id is not null").where(valid(F.col("vec"))).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), is_query.alias("q"))
    # by the rows alone, so that a table has the same neighbours on any cluster
    n = given.count()
    shards = max(1, -(-n // SHARD_ROWS), min(FEW_SHARDS, -(-n // FEW_ROWS)))
    rows = given.select("id", "vec").distinct()
    rows = rows.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vec")
    queries = given.where("q").groupBy("id").agg(F.min("vec").alias("vec"))
    queries = queries.select(F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec")
    look = int(np.ceil(k / shards + 2 * np.sqrt(k / shards)))
    dealt = rows.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "kind")

    def run(batches):
        held, ids, xs, shard = None, [], [], None
        for dim, number, kind, own, x in runs(batches):
            if (dim, number) != held:
                held, ids, xs, shard = (dim, number), [], [], None
            if kind == 0:
                ids.append(own)
                xs.append(x)
                continue
            if not ids:
                continue
            if shard is None:
                shard = Shard(np.concatenate(ids), np.concatenate(xs), tables, sure)
                xs = []
            for at in range(0, len(own), QUERY_BLOCK):
                part = own[at : at + QUERY_BLOCK]
                found = shard.nearest(part, x[at : at + QUERY_BLOCK], k, look)
                query = np.repeat(part, [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], schema=FOUND)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
