"""Spelling variant grouping by full neighbourhood generation.

Runs of ``[A-Za-z\\u00C0-\\u00FF]`` are lower-cased (A-Z only); a fixed share of the (document, run) pairs, by
checksum, loses one letter. Words are the results of ``LEAST_LETTERS`` letters seen ``LEAST_COUNT`` times.
Every word emits all its distinct deletions, replacements and insertions over the alphabet of the words,
and these are joined by equality to the words: whatever meets differs by exactly one letter, so no distance
is computed. A word's form is its near word seen most (ties: first in code-point order), if that is seen
``FORM_TIMES`` as often; its root is the end of the chain of forms.

Neighbours are emitted as hashes from prefix and suffix sums, whole arrays at a time, and held against a
Bloom filter of the words of at most ``FILTER_BITS`` bits, which is what is broadcast, however many words
there are. Only neighbours that pass are spelled out and joined; the join is on the spelling, so a neighbour
let through by chance joins nothing and no link is lost.

Forms rise by a factor, so chains have at most log5 of the greatest count links and no cycles; roots are
found by doubling, each round over a written table.

Nulls: a null text has no runs; a null doc_id counts as the empty text before the colon. Repeated rows count
each. Texts without runs and empty tables give no words. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, DROP_ONE_IN = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter a word, and at most in all (64 MB); 8 KB of it make a page.
BITS_A_WORD, FILTER_BITS, PAGE_BITS = 16, 1 << 29, 1 << 16
PROBES = 4
#: Neighbours laid out at once; bounds memory, not results.
CHUNK = 1 << 21
#: Words that one task expands.
TASK_WORDS = 5_000

_STEP, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def lowered(run: Column) -> Column:
    """Only A-Z; runs of one byte a letter take the fast way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of documents (doc_id, text)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.split(F.col("text"), "[^A-Za-z\\u00C0-\\u00FF]+")).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LETTERS).select("doc_id", lowered(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    made = runs.select(F.when(F.col("h") % DROP_ONE_IN == 0, dropped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length as a matrix of code points, with their places in the list."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield at, points.reshape(len(at), size).astype(np.uint64)


def sums(points: np.ndarray) -> np.ndarray:
    """Sums of the letters before each place and at the end, each letter times its place's power; the
    last column is the word's hash."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    np.cumsum(points * powers(points.shape[1]), axis=1, out=out[:, 1:])
    return out


def bits_of(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The filter's bit for a hash, another for each probe."""
    x = hashes + np.uint64((probe + 1) * 0xD1B54A32D192ED03 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(bits - 1)


def filter_of(words: DataFrame, n: int) -> np.ndarray:
    """The filter as bytes. Pages are set in tasks; the driver lays them side by side."""
    bits = min(FILTER_BITS, max(PAGE_BITS, 1 << math.ceil(math.log2(max(1, n) * BITS_A_WORD))))

    def places(batches):
        for batch in batches:
            for _, points in by_length(batch.column(0).to_pylist()):
                hashes = sums(points)[:, -1]
                for probe in range(PROBES):
                    at = bits_of(hashes, bits, probe).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at // PAGE_BITS), pa.array((at % PAGE_BITS).astype(np.int32))], names=["page", "bit"])

    def pages(batches):
        for batch in batches:
            made = []
            for at in batch.column(1):
                page = np.zeros(PAGE_BITS, bool)
                page[np.asarray(at.values)] = True
                made.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page", "bits"])

    spread = words.select("word").mapInArrow(places, "page long, bit int").groupBy("page").agg(F.collect_set("bit").alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for row in spread.mapInArrow(pages, "page long, bits binary").toLocalIterator():
        out[row.page * (PAGE_BITS // 8) :][: PAGE_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def passing(hashes: np.ndarray, there: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of the neighbours that exist (``there``) and may be words."""
    at = np.flatnonzero(there.reshape(-1))
    flat = hashes.reshape(-1)
    for probe in range(PROBES):
        bit = bits_of(flat[at], len(held) * 8, probe)
        at = at[(held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return np.unravel_index(at, hashes.shape)


def neighbours(words: list[str], alphabet: str, held: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of the word, neighbour): each distinct deletion, replacement and insertion once, those that
    the filter leaves out apart. Of a run of equal letters the last is deleted, and a letter is inserted
    behind its equals."""
    letters = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for place, points in by_length(words):
        size = points.shape[1]
        rows = max(1, CHUNK // ((size + 1) * max(1, len(letters))))
        wide = max(1, CHUNK // max(1, len(letters)))
        power = powers(size + 1)
        for start in range(0, len(place), rows):
            some, at = points[start : start + rows], place[start : start + rows]
            before = sums(some)
            whole = before[:, -1:]
            after = whole - before  # of the letters from each place on
            last = np.ones(some.shape, bool)
            last[:, :-1] = some[:, :-1] != some[:, 1:]
            for k, i in zip(*passing(before[:, :-1] + after[:, 1:] * _BACK, last, held)):
                w = words[at[k]]
                yield at[k], w[:i] + w[i + 1 :]
            # very long words by stretches of places
            for low in range(0, size + 1, wide):
                here = slice(low, min(size, low + wide))
                changed = whole[:, :, None] + (letters - some[:, here, None]) * power[here][:, None]
                for k, i, c in zip(*passing(changed, letters != some[:, here, None], held)):
                    w = words[at[k]]
                    yield at[k], w[: low + i] + alphabet[c] + w[low + i + 1 :]
                here = slice(low, min(size + 1, low + wide))
                put = (before[:, here] + after[:, here] * np.uint64(_STEP))[:, :, None] + letters * power[here][:, None]
                free = np.ones(put.shape, bool)
                inner = min(size, low + wide) - low
                free[:, :inner] = letters != some[:, low : low + inner, None]
                for k, i, c in zip(*passing(put, free, held)):
                    w = words[at[k]]
                    yield at[k], w[: low + i] + alphabet[c] + w[low + i :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of near words."""
    spark, n = words.sparkSession, words.count()
    alphabet = "".join(sorted(r.letter for r in words.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()))  # at most the letters of the class
    held = spark.sparkContext.broadcast(filter_of(words, n))

    def emit(batches):
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(names), 500):
                found = list(neighbours(names[i : i + 500], alphabet, held.value))
                at = pa.array([i + int(k) for k, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), counts.take(at), pa.array([w for _, w in found], pa.string())], names=["word", "n", "near"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_WORDS))
    emitted = words.select("word", "n").repartition(tasks).mapInArrow(emit, "word string, n long, near string")
    return emitted.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    words = cut(vocabulary(docs), "variants-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = F.col("best.near_n") >= F.col("n") * FORM_TIMES
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n"))
    rows = cut(rows, "variants-forms")
    most = rows.agg(F.max("n").alias("n")).first().n or 1
    links = math.floor(math.log(max(1, most), FORM_TIMES)) + 1
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(links)) if links > 1 else 0):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"variants-roots-{k}")
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
