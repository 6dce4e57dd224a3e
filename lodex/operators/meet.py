"""Every query against every row, where the queries are too many to be sent to the rows.

Rows are dealt to parts of bounded size, and every part gets all queries, which stream past it in batches.
A task holds one part as numpy arrays, scores a few queries at a time against the whole of it and gives on the
best k of each. What a task holds has a bound, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows and list entries of a part at most, as a rule, and scores that a task holds at once.
PART_ROWS, PART_ENTRIES, SCORES = 1 << 17, 1 << 23, 1 << 22
#: Rows and queries of a product in single precision, and neighbouring scores of which the greatest is looked at first.
BLOCK_ROWS, BLOCK_QUERIES, RUN = 4096, 256, 64
#: Of a cluster's documents the terms that more than HEAVY_SHARE have are kept as a dense matrix too, HEAVY of them at
#: most. It is used for those whose shares of the documents and of the queries at hand have a product over DENSE.
HEAVY_SHARE, HEAVY, DENSE = 0.03, 512, 0.01
#: Documents in a block, and blocks of which a query's scores are worked out at first.
BLOCK, FIRST = 128, 4
#: Clusters of a part's documents, told apart by the MARKS commonest terms, SAMPLE documents at once; queries that are
#: sorted by cluster at once.
CLUSTERS, MARKS, SAMPLE, MET_QUERIES = 8, 256, 4096, 2048


def parts_for(rows: DataFrame, n_rows: int, n_entries: int = 0) -> int:
    """As many parts as their bounds ask for, in whole waves of tasks: parts take about as long as one another."""
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return max(1, min(n_rows, -(-max(1, -(-n_rows // PART_ROWS), -(-n_entries // PART_ENTRIES)) // cores) * cores))


def shared_out(sizes: list[int], parts: int) -> list[int]:
    """How many parts each group of rows gets: one at least, as many as PART_ROWS asks for, the rest of ``parts``
    to the groups whose parts are largest."""
    own = [max(1, -(-n // PART_ROWS)) for n in sizes]
    for _ in range(parts - sum(own)):
        i = max(range(len(own)), key=lambda i: sizes[i] / own[i])
        own[i] += 1
    return own


def meet(rows: DataFrame, queries: DataFrame, parts: int, k: int, decimals: int, block: Callable, group: str | None = None, keep: tuple[str, ...] = (), sizes: dict | None = None) -> DataFrame:
    """rows (id, keep, columns), queries (query_id, the same columns) -> query_id, id, keep and the raw score of each
    part's best k rows of each query (and group, a kept column) by score rounded to ``decimals``, then id. With
    ``sizes``, the number of rows of every group, a part has rows of one group, and k rows of a query leave it
    instead of k for each group."""
    own = [c for c in rows.columns if c != "id" and c not in keep]
    place, at = F.pmod(F.xxhash64("id"), F.lit(parts)), 0
    if sizes:
        places = []
        for value, n in zip(sizes, shared_out(list(sizes.values()), parts)):
            places.append(F.when(F.col(group).eqNullSafe(F.lit(value)), F.pmod(F.xxhash64("id"), F.lit(n)) + at))
            at += n
        place, parts = F.coalesce(*places, F.pmod(F.xxhash64("id"), F.lit(at))), at
    dealt = rows.withColumn("_part", place.cast("int")).withColumn("_kind", F.lit(0))
    asked = queries.select("query_id", *own, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(1).alias("_kind"))
    both = dealt.unionByName(asked, allowMissingColumns=True).repartitionById(parts, "_part")
    both = both.sortWithinPartitions("_kind", *([group] if group else []), "id")
    return both.mapInArrow(_runner(block, k, decimals, group, keep), _schema(both, keep))


def meet_cells(rows: DataFrame, pairs: DataFrame, k: int, decimals: int, block: Callable) -> DataFrame:
    """rows (cell, id, columns), pairs (cell, query_id, the same columns, least): the best k rows of each pair whose
    score isn't less than ``least``."""
    both = rows.withColumn("_kind", F.lit(0)).unionByName(pairs.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4, "cell").sortWithinPartitions("cell", "_kind", "id")
    return both.mapInArrow(_runner(block, k, decimals, None, (), "cell"), _schema(both, ()))


def _schema(both: DataFrame, keep: tuple[str, ...]) -> StructType:
    fields = [StructField(both.schema[c].name, both.schema[c].dataType) for c in ("query_id", "id", *keep)]
    return StructType([*fields, StructField("score", DoubleType())])


def _runner(block: Callable, k: int, decimals: int, group: str | None, keep: tuple[str, ...], cell: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, made, now = [], None, None
        for whole in batches:
            for batch in _runs(whole, cell):
                if cell and batch.column(cell)[0].as_py() != now:
                    rows, made, now = [], None, batch.column(cell)[0].as_py()
                cut = int(np.searchsorted(batch.column("_kind").to_numpy(), 1))
                if cut:
                    rows.append(batch.slice(0, cut))
                if cut == batch.num_rows or not rows:
                    continue
                if made is None:
                    table = pa.Table.from_batches(rows).combine_chunks()
                    made, edges, shown = block(table), _edges(table, group), table.select(["id", *keep])
                    rows = [batch.slice(0, 0)]
                yield from _best(made, edges, shown, batch.slice(cut), k, decimals)

    return run


def _runs(batch: pa.RecordBatch, cell: str | None) -> list[pa.RecordBatch]:
    if not batch.num_rows or not cell:
        return [batch] if batch.num_rows else []
    at = batch.column(cell).to_numpy()
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _edges(table: pa.Table, group: str | None) -> list[tuple[int, int]]:
    """Where the groups, by which the rows are sorted, begin and end."""
    if not group:
        return [(0, table.num_rows)]
    codes = table.column(group).to_pandas().factorize(use_na_sentinel=False)[0]
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
    return list(zip(cuts, cuts[1:]))


def _best(made, edges, shown: pa.Table, queries: pa.RecordBatch, k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    least = queries.column("least").to_numpy(zero_copy_only=False).astype(float) if "least" in queries.schema.names else np.full(queries.num_rows, np.nan)
    step = BLOCK_QUERIES if isinstance(made, Vectors) else MET_QUERIES
    for at in range(0, queries.num_rows, step):
        own = queries.slice(at, step)
        asked, found, values = made.best(own, edges, k, decimals, least[at : at + step])
        values = np.where(np.isposinf(values), np.nan, values)
        if len(asked):
            for lo in range(0, len(asked), 100_000):
                to = slice(lo, lo + 100_000)
                hit = shown.take(pa.array(found[to]))
                columns = [own.column("query_id").take(pa.array(asked[to])), *(c.combine_chunks() for c in hit.columns), pa.array(values[to])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", *shown.column_names, "score"])


def _best_of(all_scores: np.ndarray, edges, k: int, decimals: int, least: np.ndarray, rows: np.ndarray | None = None, above: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and scores of the best k of every query and group, of scores over ``above``; ``rows`` are the rows
    of the columns, if they don't lie in order."""
    unit = 10.0**-decimals
    asked, found, values = [], [], []
    for i, scores in enumerate(all_scores):
        for a, b in edges:
            part = scores[a:b]
            # the k-th greatest of runs' greatest scores is a bound too, and found sooner
            of = part[: len(part) // RUN * RUN].reshape(RUN, -1).max(axis=0) if len(part) > 4 * k * RUN else part
            bound = np.partition(of, len(of) - k)[len(of) - k] if k < len(of) else -np.inf
            bound = max(bound - unit, least[i] - unit) if least[i] == least[i] else bound - unit
            some = np.flatnonzero(part >= bound) if bound > above else np.flatnonzero((part >= bound) & (part > above))
            if len(some) > k:
                some = some[np.lexsort((some if rows is None else rows[some + a], -np.round(part[some], decimals)))[:k]]
            asked.append(np.full(len(some), i))
            found.append(some + a if rows is None else rows[some + a])
            values.append(part[some])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(values)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and their entries one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


class Vectors:
    """Cosines. Rows and queries (vec, an array of numbers, and norm), no nulls in vectors. Scores are -inf where there is no
    cosine (dimensions differ, a zero vector), and inf, which comes before all, where it is not a number.

    Where all vectors have one dimension and common lengths, products of unit vectors in single precision tell which
    rows can be among the best; their margin is wider than what rounding can make, and only these are scored in double."""

    def __init__(self, table: pa.Table):
        self.n = table.num_rows
        self.norms = table.column("norm").to_numpy()
        self.by_size = self.matrices(table.column("vec"))
        self.unit = None
        if len(self.by_size) == 1 and self.common(self.norms):
            self.vectors = next(iter(self.by_size.values()))[1]
            self.unit = self.units(self.vectors, self.norms)

    @staticmethod
    def common(norms: np.ndarray) -> bool:
        return bool(((norms > 1e-100) & (norms < 1e100)).all())

    @staticmethod
    def units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.float32)
        for lo in range(0, len(out), BLOCK_ROWS):
            out[lo : lo + BLOCK_ROWS] = vectors[lo : lo + BLOCK_ROWS] / norms[lo : lo + BLOCK_ROWS, None]
        return out

    def best(self, queries: pa.RecordBatch, edges, k: int, decimals: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms, sizes = queries.column("norm").to_numpy(), self.matrices(queries.column("vec"))
        if self.unit is None or len(sizes) != 1 or self.unit.shape[1] not in sizes or not self.common(norms):
            step = max(1, SCORES // max(1, self.n))
            got = [_best_of(self.scores(queries.slice(lo, step)), edges, k, decimals, least[lo : lo + step]) for lo in range(0, queries.num_rows, step)]
            asked = np.concatenate([np.zeros(0, int), *(g[0] + i * step for i, g in enumerate(got))])
            return asked, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        q = next(iter(sizes.values()))[1]
        unit, slack = self.units(q, norms), 10.0**-decimals + (q.shape[1] + 16) * 2.0**-22
        floor = np.where(np.isnan(least), -np.inf, least - slack).astype(np.float32)
        found = [self._best_between(a, b, q, norms, unit, k, decimals, slack, floor.copy()) for a, b in edges]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _best_between(self, a: int, b: int, q, norms, unit, k: int, decimals: int, slack: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, at, values = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        held, waiting = [], 0
        for lo in range(a, b, BLOCK_ROWS):
            scores = unit @ self.unit[lo : min(b, lo + BLOCK_ROWS)].T
            if lo == a and k < scores.shape[1]:
                bound = np.maximum(bound, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - np.float32(slack))
            who, where = _reaching(scores, bound)
            if len(who) > max(scores.size // 16, 2 * k * len(q)):  # copies, of which the first by id are left
                block = slice(lo, lo + scores.shape[1])
                who, where, _ = _best_of((q @ self.vectors[block].T) / np.outer(norms, self.norms[block]), [(0, scores.shape[1])], k, decimals, bound.astype(float))
            held.append((who, where + lo))
            waiting += len(who)
            # rows that wait are scored when they are many; then the bound rises too
            if waiting > 2 * k * len(q) or lo + BLOCK_ROWS >= b:
                who, where = (np.concatenate(x) for x in zip(*held))
                held, waiting = [], 0
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[who[i : i + 4096]], self.vectors[where[i : i + 4096]]) for i in range(0, len(who), 4096))]) / (norms[who] * self.norms[where])
                asked, at, values = np.concatenate([asked, who]), np.concatenate([at, where]), np.concatenate([values, exact])
                order = np.lexsort((at, -np.round(values, decimals), asked))
                asked, at, values = asked[order], at[order], values[order]
                place = np.arange(len(asked)) - np.searchsorted(asked, asked)
                last = place == k - 1
                bound[asked[last]] = np.maximum(bound[asked[last]], (values[last] - slack).astype(np.float32))
                asked, at, values = asked[place < k], at[place < k], values[place < k]
        return asked, at, values

    @staticmethod
    def matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes, flat = _lists(column)
        row = np.repeat(sizes, sizes)
        return {int(d): (np.flatnonzero(sizes == d), flat[row == d].reshape(-1, d).astype(np.float64)) for d in np.unique(sizes)}

    def scores(self, queries: pa.RecordBatch) -> np.ndarray:
        out = np.full((queries.num_rows, self.n), -np.inf)
        norms = queries.column("norm").to_numpy()
        with np.errstate(all="ignore"):
            for size, (asked, q) in self.matrices(queries.column("vec")).items():
                if size in self.by_size:
                    at, v = self.by_size[size]
                    norm = np.outer(norms[asked], self.norms[at])
                    got = (q @ v.T) / norm
                    if not np.isfinite(got).all():
                        got = np.where(norm == 0, -np.inf, np.where(np.isfinite(got), got, np.inf))
                    if len(at) == self.n and len(asked) == queries.num_rows:
                        return got
                    out[np.ix_(asked, at)] = got
        return out


def _reaching(scores: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where scores reach their row's bound: the greatest of each run is looked at first."""
    whole = scores.shape[1] // RUN * RUN
    runs = scores[:, :whole].reshape(len(scores), -1, RUN)
    i, run = np.nonzero(runs.max(axis=2) >= bound[:, None]) if whole else (np.zeros(0, int), np.zeros(0, int))
    j, inside = np.nonzero(runs[i, run] >= bound[i, None])
    rest, more = np.nonzero(scores[:, whole:] >= bound[:, None])
    return np.concatenate([i[j], rest]), np.concatenate([run[j] * RUN + inside, more + whole])


def _by_term(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, terms: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by term and document. As one whole number each, if they fit: numbers are sorted far sooner than places."""
    most = int(tf.max()) + 1 if len(tf) else 1
    if terms * docs * most >= 1 << 63 or (tf != np.floor(tf)).any():
        order = np.argsort(term * docs + doc)
        return term[order], doc[order], tf[order]
    key = np.sort((term * docs + doc) * most + tf.astype(np.int64))
    key, tf = np.divmod(key, most)
    return *np.divmod(key, docs), tf.astype(np.float64)


class Terms:
    """Sums of weights of common terms. Rows (terms array<long>, counts array<double>), queries the same with the terms'
    idf as counts; -inf where no term is common.

    Rows lie by clusters of like terms (one language, say), and queries that are scored together are of one cluster as
    far as may be. Of a cluster's rows, terms that many of them and many of these queries have are products of matrices,
    the others are added up from lists of postings. Clusters decide how a sum is worked out, not what is in it."""

    def __init__(self, table: pa.Table, k1: float, b: float, avgdl: float):
        self.n = table.num_rows
        sizes, names = _lists(table.column("terms"))
        tf = _lists(table.column("counts"))[1]
        row = np.repeat(np.arange(self.n), sizes)
        dl = np.bincount(row, tf, self.n)
        seen = pa.array(names).dictionary_encode()
        shown = seen.dictionary.to_numpy()
        rank = np.argsort(shown)
        self.terms, code = shown[rank], np.empty(len(rank), np.int64)
        code[rank] = np.arange(len(rank))
        term = code[seen.indices.to_numpy()]
        self._clusters(row, term, sizes)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        term, self.doc, tf = _by_term(term, place[row], tf, len(self.terms), self.n)
        dl = dl[self.order][self.doc]
        self.weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        del row, dl, tf
        cluster = np.searchsorted(self.edges, self.doc, side="right") - 1
        spans = np.bincount(term * len(self.ends) + cluster, minlength=len(self.terms) * len(self.ends)).reshape(len(self.terms), len(self.ends))
        self.starts = np.zeros((len(self.terms), len(self.ends) + 1), np.int32)
        self.starts[:, 0] = np.r_[0, np.cumsum(spans.sum(axis=1))[:-1]] if len(self.terms) else 0
        self.starts[:, 1:] = self.starts[:, :1] + np.cumsum(spans, axis=1)
        self._made(spans)

    def _made(self, spans: np.ndarray) -> None:
        """What is held beside the lists of postings: matrices of the common terms of every cluster."""
        self.place = np.full(spans.shape, -1, np.int16)
        self.matrices, self.shares = [], []
        for c, (a, z) in enumerate(zip(self.edges, self.ends)):
            heavy = np.argsort(-spans[:, c], kind="stable")[:HEAVY]
            heavy = np.sort(heavy[spans[heavy, c] > HEAVY_SHARE * (z - a)])
            self.place[heavy, c] = np.arange(len(heavy))
            matrix = np.zeros((len(heavy), z - a))
            for i, t in enumerate(heavy):
                span = slice(self.starts[t, c], self.starts[t, c + 1])
                matrix[i, self.doc[span] - a] = self.weight[span]
            self.matrices.append(matrix)
            self.shares.append(spans[heavy, c] / max(1, z - a))

    def _clusters(self, row: np.ndarray, term: np.ndarray, sizes: np.ndarray) -> None:
        """Clusters by k-means over the commonest terms of the rows; ``order`` has the rows of one cluster after the other."""
        df = np.bincount(term, minlength=len(self.terms))
        marks = np.argsort(-df, kind="stable")[:MARKS]
        self.mark = np.full(len(self.terms), -1)
        self.mark[marks] = np.arange(len(marks))
        self.value = np.log(1 + self.n / np.maximum(df, 1))
        starts = np.r_[0, np.cumsum(sizes)]

        def marked(some: np.ndarray) -> np.ndarray:
            at = np.concatenate([np.arange(0), *(np.arange(starts[i], starts[i + 1]) for i in some)])
            return self._marked(np.repeat(np.arange(len(some)), sizes[some]), term[at], len(some))

        sample = np.arange(0, self.n, max(1, self.n // SAMPLE))
        seen = marked(sample)
        self.centres = seen[:: max(1, -(-len(seen) // CLUSTERS))].copy()
        for _ in range(8):
            nearest = (seen @ self.centres.T).argmax(axis=1)
            self.centres = np.stack([seen[nearest == c].sum(axis=0) for c in range(len(self.centres))]) if len(seen) else self.centres
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-9)
        own = np.concatenate([np.zeros(0, int), *((marked(np.arange(lo, min(self.n, lo + SAMPLE))) @ self.centres.T).argmax(axis=1) for lo in range(0, self.n, SAMPLE))])
        self.order = np.argsort(own, kind="stable")
        self.edges = np.flatnonzero(np.r_[True, np.diff(own[self.order]) > 0]) if self.n else np.zeros(1, int)
        self.ends = np.r_[self.edges[1:], self.n]

    def _marked(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out, at = np.zeros((n, (self.mark >= 0).sum()), np.float32), self.mark[term]
        out[row[at >= 0], at[at >= 0]] = self.value[term[at >= 0]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def best(self, queries: pa.RecordBatch, edges, k: int, decimals: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, at, idf = self._known(queries)
        cluster = (self._marked(asked, at, queries.num_rows) @ self.centres.T).argmax(axis=1) if len(self.centres) else np.zeros(queries.num_rows, int)
        order, step = np.argsort(cluster, kind="stable"), max(1, SCORES // max(1, self.n))
        ends = np.searchsorted(asked, np.arange(queries.num_rows + 1))
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for lo in range(0, len(order), step):
            own = order[lo : lo + step]
            entries = np.concatenate([np.arange(ends[q], ends[q + 1]) for q in own])
            scores = self._sums(np.repeat(np.arange(len(own)), ends[own + 1] - ends[own]), at[entries], idf[entries], len(own))
            if len(edges) > 1:
                scores[:, self.order] = scores.copy()
            who, where, values = _best_of(scores, edges, k, decimals, least[own], self.order if len(edges) == 1 else None, 0.0)
            found.append((own[who], where, values))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _known(self, queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, term and idf of the entries whose term a row has."""
        sizes, names = _lists(queries.column("terms"))
        idf = _lists(queries.column("counts"))[1]
        asked = np.repeat(np.arange(queries.num_rows), sizes)
        at = np.searchsorted(self.terms, names)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == names[known]
        return asked[known], at[known], idf[known]

    def scores(self, queries: pa.RecordBatch) -> np.ndarray:
        out = np.empty((queries.num_rows, self.n))
        out[:, self.order] = self._sums(*self._known(queries), queries.num_rows)
        return np.where(out > 0, out, -np.inf)

    def _sums(self, asked: np.ndarray, at: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
        """Scores of n queries, rows as they lie; entries are sorted by query."""
        out = np.zeros((n, self.n))
        among, which = np.unique(at, return_inverse=True)
        share = np.bincount(which, minlength=len(among)) / max(1, n)
        used = np.zeros((len(at), len(self.ends)), bool)
        for c, (a, z) in enumerate(zip(self.edges, self.ends)):
            place = self.place[among, c]
            dense = place >= 0
            dense[dense] = share[dense] * self.shares[c][place[dense]] > DENSE
            if dense.any():
                used[:, c] = own = dense[which]
                column = np.cumsum(dense) - 1
                weights = np.zeros((n, dense.sum()))
                weights[asked[own], column[which[own]]] = idf[own]
                np.matmul(weights, self.matrices[c][place[dense]], out=out[:, a:z])
        # a term that is in no product goes as one list, others as those of the clusters where it is in none
        whole = np.flatnonzero(~used.any(axis=1))
        rest, c = np.nonzero(~used & used.any(axis=1)[:, None])
        entry = np.concatenate([whole, rest])
        low = np.concatenate([self.starts[at[whole], 0], self.starts[at[rest], c]])
        long = np.concatenate([self.starts[at[whole], -1], self.starts[at[rest], c + 1]]) - low
        entry, low, long = entry[long > 0], low[long > 0], long[long > 0]
        order = np.argsort(asked[entry], kind="stable")
        entry, low, long = entry[order], low[order], long[order]
        ends = np.searchsorted(asked[entry], np.arange(n + 1))
        for q in range(n):
            own = slice(ends[q], ends[q + 1])
            if ends[q + 1] > ends[q]:
                last = np.cumsum(long[own])
                posting = np.arange(last[-1]) + np.repeat(low[own] - last + long[own], long[own])
                out[q] += np.bincount(self.doc[posting], self.weight[posting] * np.repeat(idf[entry[own]], long[own]), self.n)
        return out


class Blocks(Terms):
    """Sums of weights of common terms, for queries of a few words. Rows lie in blocks of neighbours, each with the
    greatest weight of every term. A query's FIRST blocks by bound, the sum of its terms' greatest weights, are scored,
    then those whose bound reaches the k-th best score; the rows are those of all blocks."""

    def _made(self, spans: np.ndarray) -> None:
        """(term, block) pairs in order: where a term's begin, their blocks, greatest weights, and first postings."""
        self.blocks = -(-self.n // BLOCK)
        pair = np.repeat(np.arange(len(self.terms)), spans.sum(axis=1)) * max(1, self.blocks) + self.doc // BLOCK
        at = np.flatnonzero(np.r_[True, np.diff(pair) > 0]) if len(pair) else np.zeros(0, int)
        term, self.block = np.divmod(pair[at], max(1, self.blocks))
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.at = np.r_[at, len(self.doc)]

    def best(self, queries: pa.RecordBatch, edges, k: int, decimals: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, at, idf = self._known(queries)
        ends = np.searchsorted(asked, np.arange(queries.num_rows + 1))
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for q in np.flatnonzero(np.diff(ends)):
            own = slice(ends[q], ends[q + 1])
            scores, where = self._reached(at[own], idf[own], k, decimals)
            rows = self.order[where]
            order = np.argsort(rows)
            _, some, values = _best_of(scores[None, order], [(0, len(order))], k, decimals, least[q : q + 1], rows[order], 0.0)
            found.append((np.full(len(some), q), some, values))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _reached(self, terms: np.ndarray, idf: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the rows of all blocks that can hold one of the best k."""
        pairs, long = _spans(self.first[terms], self.first[terms + 1])
        idf = np.repeat(idf, long)
        bound = np.bincount(self.block[pairs], self.most[pairs] * idf, self.blocks)
        order = np.argsort(-bound, kind="stable")
        scores, where = self._scored(pairs, idf, order[: FIRST])
        if len(scores) >= k:
            order = order[bound[order] >= np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * 10.0**-decimals]
        more, other = self._scored(pairs, idf, order[FIRST:])
        return np.concatenate([scores, more]), np.concatenate([where, other])

    def _scored(self, pairs: np.ndarray, idf: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        own = wanted[self.block[pairs]]
        posting, long = _spans(self.at[pairs[own]], self.at[pairs[own] + 1])
        sums = np.bincount(self.doc[posting], self.weight[posting] * np.repeat(idf[own], long), self.n)
        where = np.flatnonzero(sums)
        return sums[where], where


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all spans, one after the other, and the spans' lengths."""
    long = high - low
    last = np.cumsum(long)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(low - last + long, long), long
