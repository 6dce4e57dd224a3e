"""Source divergence audit by joint count histograms.

For each language, every source's distribution over the language's kept terms is held against that of
each other source, and against the language's own. A pair of sources is never summed term by term: the
pair's distinct (count, count) combinations are tallied, the cells with a zero on one or both sides follow
from the histograms of the single sources and the number of terms, and the divergence is evaluated once
for each combination and multiplied by its tally. All arithmetic is on whole numbers.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. A language keeps the
terms that ``LEAST_DOCS`` of its documents hold. A group (lang, source) gives a kept term that it holds c
times p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N its occurrences of kept terms, V their number. Two sides
p, q differ by f = floor((p - q)^2 / (p + q)).

Work: texts are counted slice by slice in tasks; a term's counts by source come together in one row, at
most one entry for each source of the language. Pairs of those entries are tallied inside tasks, in chunks
of ``CHUNK``, and only tallies leave a task; so pairs of sources, of which the result has one row each, are
never joined by term.

Nulls: null text, lang and source read as ''. Repeated rows are documents of their own, doc_id is not read.
Groups without terms, and languages without kept terms, have rows in part `pair` (value 0 where V is 0). A
language of one source has none there. An empty table gives an empty result. Ties: items ascend by UTF-8.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewise import numbered, parts, table, words
from .common import cut
from .tokens import slices

LEAST_DOCS, SMOOTH, UNIT, TERM_RANKS = 10, 2, 1_000_000_000, 10
#: Pairs of sources that a task lays out at once; bounds memory, not results.
CHUNK = 1 << 20

_TERMS = table([*range(0, 65), *range(91, 97), *range(123, 128)], lower=True)


def count_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, df) of each slice."""
    for batch in slices(batches, 2, 12 << 20):
        found = words(*parts(batch.column(2)), _TERMS)
        langs, sources = batch.column(0), batch.column(1)
        keys = pc.binary_join_element_wise(pc.cast(pc.binary_length(langs), pa.string()), langs, sources, "\x00")
        coded = keys.dictionary_encode()
        group, size = np.asarray(coded.indices).astype(np.int64), len(found.names)
        if not len(found.codes):
            continue
        both, n = np.unique(found.of * size + found.codes, return_counts=True)
        cell = group[both // size] * size + both % size
        cells, at = np.unique(cell, return_inverse=True)
        first = np.unique(group, return_index=True)[1]
        rows = pa.array(first[cells // size])
        yield pa.RecordBatch.from_arrays([langs.take(rows), sources.take(rows), found.names.take(pa.array(cells % size)).cast(pa.string()), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))], names=["lang", "source", "term", "n", "df"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and rows that hold the term."""
    found = docs.mapInArrow(count_slice, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cells: [(source's number, n)]) by term to (lang, a, b, ca, cb, m), a < b: how many of the
    terms have these two counts."""
    for batch in batches:
        for piece in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            lists = piece.column(1)
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            flat = lists.flatten()
            who, n = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
            level = np.unique(n, return_inverse=True)[1]
            coded = piece.column(0).dictionary_encode()
            lang = np.repeat(np.asarray(coded.indices).astype(np.int64), sizes)
            # entry i meets the later entries of its term; entries are in order of their source
            after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(who)) - 1
            edges = np.concatenate(([0], np.cumsum(after)))
            at = 0
            while at < len(who):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, side="right")) - 1)
                i = np.repeat(np.arange(at, end), after[at:end])
                j = i + 1 + np.arange(len(i)) - (edges[i] - edges[at])
                if len(i):
                    pair = numbered(numbered(lang[i], who[i]), who[j])
                    _, one, m = np.unique(numbered(pair, numbered(level[i], level[j])), return_index=True, return_counts=True)
                    i, j = i[one], j[one]
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang[i])), pa.array(who[i]), pa.array(who[j]), pa.array(n[i]), pa.array(n[j]), pa.array(m.astype(np.int64))], names=["lang", "a", "b", "ca", "cb", "m"])
                at = end


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), exactly, beyond 64 bits on the way."""
    over = ((count + SMOOTH).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")).alias("over")
    return F.call_function("div", over, (total + terms * SMOOTH).cast("decimal(28,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = given.select("lang", "source").distinct()
    # sources are numbered within their language in their order, so that a pair is a < b
    groups = cut(groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")), "divergence-groups")
    counted = counts(given).join(groups, ["lang", "source"])
    by_term = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang"), F.array_sort(F.collect_list(F.struct("g", "n"))).alias("cells"))
    kept = cut(by_term.where(F.col("df") >= LEAST_DOCS).select("lang", "term", "n_lang", "cells"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_all"))
    cells = kept.select("lang", "term", "n_lang", F.explode("cells").alias("cell")).select("lang", "term", "n_lang", "cell.g", "cell.n")
    totals = cells.groupBy("lang", "g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    sides = groups.join(langs, "lang", "left").join(totals, ["lang", "g"], "left").select("lang", "source", "g", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "n_all", "total", "held")])
    sides = cut(sides, "divergence-sides")
    return pair_part(kept, cells, sides).unionByName(term_part(cells, sides))


def histogram(kept: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): all of a language's kept terms by pair of sources, zero cells included.
    A term that both hold is taken out of the cells where it would count as held by one."""
    zero, key = F.lit(0).cast("long"), ["lang", "a", "b"]
    met = kept.select("lang", "cells").mapInArrow(tally, "lang string, a long, b long, ca long, cb long, m long")
    met = met.groupBy(*key, "ca", "cb").agg(F.sum("m").alias("m"))
    single = cells.groupBy("lang", "g", "n").agg(F.count(F.lit(1)).alias("m"))
    first = pairs.join(single.withColumnRenamed("g", "a"), ["lang", "a"]).select(*key, F.col("n").alias("ca"), zero.alias("cb"), "m")
    second = pairs.join(single.withColumnRenamed("g", "b"), ["lang", "b"]).select(*key, zero.alias("ca"), F.col("n").alias("cb"), "m")
    neither = pairs.select(*key, zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("held_a") - F.col("held_b")).alias("m"))
    taken = met.select(*key, F.explode(F.array(F.struct("ca", "cb", "m"), F.struct("ca", zero.alias("cb"), (-F.col("m")).alias("m")), F.struct(zero.alias("ca"), "cb", (-F.col("m")).alias("m")), F.struct(zero.alias("ca"), zero.alias("cb"), "m"))).alias("x")).select(*key, "x.*")
    every = taken.unionByName(first).unionByName(second).unionByName(neither)
    return every.groupBy(*key, "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def pair_part(kept: DataFrame, cells: DataFrame, sides: DataFrame) -> DataFrame:
    a = sides.select("lang", "v", F.col("g").alias("a"), F.col("source").alias("source_a"), F.col("total").alias("total_a"), F.col("held").alias("held_a"))
    b = sides.select("lang", F.col("g").alias("b"), F.col("source").alias("source_b"), F.col("total").alias("total_b"), F.col("held").alias("held_b"))
    # one row for each row of the result's part, as stated
    pairs = cut(a.join(b, "lang").where("a < b"), "divergence-pairs")
    cells_of = histogram(kept, cells, pairs).join(pairs.select("lang", "a", "b", "total_a", "total_b", "v"), ["lang", "a", "b"])
    p, q = probability(F.col("ca"), F.col("total_a"), F.col("v")), probability(F.col("cb"), F.col("total_b"), F.col("v"))
    value = cells_of.withColumn("p", p).withColumn("q", q).groupBy("lang", "a", "b").agg(F.sum(divergence(F.col("p"), F.col("q")) * F.col("m")).alias("value"))
    valued = pairs.join(value, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    both = valued.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    return ranks(both, "pair")


def term_part(cells: DataFrame, sides: DataFrame) -> DataFrame:
    held = cells.join(sides.select("lang", "g", "source", "total", "v", "n_all"), ["lang", "g"])
    held = held.withColumn("p", probability(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", probability(F.col("n_lang"), F.col("n_all"), F.col("v")))
    return ranks(held.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")), "term", TERM_RANKS)


def ranks(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = out.where(F.col("rank") <= most) if most else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
