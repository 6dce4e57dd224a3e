"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are white-space-separated, lower-cased and stripped of everything but letters, digits and
underscores; what is then empty counts for nothing, and letters of scripts written without spaces
stand for themselves. Of a test item's ``GRAM``-grams the rare ones are its seeds: those that at most
``RARE`` different items have, or its rarest where all are commoner. One pass over the documents
finds the seeds in every whole text, opens a window around the places that they imply for the item, and
aligns window and item by local alignment (match 2, mismatch -1, gap -1). The score is the alignment's
share of the item's best possible one; edits, insertions and dropped words lower it little, a shared phrase
does not raise it far. Windows that hold too few of the item's words for the threshold in any order are
not aligned, which loses nothing. Items and document regions are joined by hash; no document leaves its task.

A copy with a score of ``THRESHOLD`` or more is meant to be found: half of the item's best, so of 20 words
up to six replaced one by one, or the half of the item copied whole. One that keeps no ``GRAM`` running words of a seed
is not; the tests measure how many that are against alignment of every item with every whole text. Items
under ``least_words`` words count only as whole word runs (score 1); those under ``GRAM`` words only
where they are a document's whole text.

The test items are broadcast in blocks of at most ``block_words`` words, however many there are; with
more than one block the results of each are written before the next is sent.

Defined results: null texts and items count as empty, and an empty item is never found; items of equal
words are all reported, rows that repeat both item_id and text once; repeated documents give repeated
results; an empty table on either side gives an empty result (and leaves the documents as they are); rows
with null doc_id or item_id are compared like others; extra columns pass through ``clean`` whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import lay_out, slices

GRAM = 3
RARE = 20
LEAST_WORDS = 6
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
SLICE_BYTES = 6 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+").findall


# Letters of Thai, Lao, Burmese, Khmer, Japanese and Chinese, written without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
PIECE = re.compile(f"[{UNSPACED}]|[^{UNSPACED}]+").findall


def normal(word: str) -> list[str]:
    """The words that a white-space-separated one stands for: mostly one, or none."""
    kept = "".join(WORD(word.lower()))
    return ([kept] if kept else []) if kept.isascii() else PIECE(kept)


@dataclass
class Items:
    """A block of test items of different words: word numbers from 1, seeds by hash, and which items
    hold them where."""

    ids: list[list]
    words: list[np.ndarray]
    need: np.ndarray  # the least score of each item
    number: dict[str, int]
    grams: np.ndarray  # sorted distinct hashes
    bounds: np.ndarray  # gram -> range in of_item and at
    of_item: np.ndarray
    at: np.ndarray
    whole: dict[tuple, int]  # items too short for a gram


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each GRAM consecutive word numbers."""
    n = len(words) - GRAM + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM):
        h = (h ^ words[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def rare(gram: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
    """Which entries (gram number, item) are seeds."""
    pair = np.unique(np.stack([gram, item], axis=1), axis=0)
    in_items = np.bincount(pair[:, 0])[gram]
    least = np.full(n_items, np.iinfo(np.int64).max)
    np.minimum.at(least, item, in_items)
    return (in_items <= RARE) | (in_items <= 2 * least[item]) & (least[item] > RARE)


def index(rows: list[tuple], threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> Items | None:
    """rows: (item ids, text)."""
    number: dict[str, int] = {}
    ids_of: dict[tuple, list] = {}
    for ids, text in rows:
        own = [w for x in (text or "").split() for w in normal(x)]
        if own:
            ids_of.setdefault(tuple(number.setdefault(w, len(number) + 1) for w in own), []).extend(ids)
    if not ids_of:
        return None
    words = [np.array(w, dtype=np.int64) for w in ids_of]
    hashes = [gram_hashes(w) for w in words]
    flat = np.concatenate(hashes)
    item = np.repeat(np.arange(len(words)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])
    if len(flat):
        seed = rare(np.unique(flat, return_inverse=True)[1], item, len(words))
        flat, item, at = flat[seed], item[seed], at[seed]
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    need = np.array([threshold if len(w) >= least_words else 1.0 for w in words])
    return Items(list(ids_of.values()), words, need, number, grams, np.concatenate((first, [len(flat)])), item[order], at[order], {w: k for k, w in enumerate(ids_of) if len(w) < GRAM})


def numbered(texts: pa.Array, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts (0: not in any item), and the texts' bounds."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    get, flat, ends = number.get, [], [0]
    for word in coded.dictionary.to_pylist():
        flat += [get(w, 0) for w in normal(word)]
        ends.append(len(flat))
    words, bounds = lay_out(np.array(flat, dtype=np.int64), np.array(ends), np.asarray(coded.indices))
    offsets = np.asarray(split.offsets)
    return words, bounds[offsets - offsets[0]]


def hits(words: np.ndarray, bounds: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``words``, gram) of every gram of the items."""
    known = words > 0
    n = len(words) - GRAM + 1
    if n <= 0 or not len(items.grams):
        return (np.empty(0, np.int64),) * 3
    whole = known[:n].copy()
    for k in range(1, GRAM):
        whole &= known[k : n + k]
    place = np.flatnonzero(whole)
    text = np.searchsorted(bounds, place, side="right") - 1
    inside = place + GRAM <= bounds[text + 1]
    place, text = place[inside], text[inside]
    h = np.zeros(len(place), np.uint64)
    for k in range(GRAM):
        h = (h ^ words[place + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    gram = np.minimum(np.searchsorted(items.grams, h), len(items.grams) - 1)
    found = items.grams[gram] == h
    return text[found], place[found], gram[found]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the end of its region part. One row for each item word;
    gaps along the row by a running maximum."""
    m = len(region)
    drop = -GAP * np.arange(m + 1)
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    for w in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(region == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + drop) - drop
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def most_matches(item: np.ndarray, region: np.ndarray) -> int:
    """How many words of the item the region holds in any order: no alignment matches more."""
    own, counts = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, region), len(own) - 1)
    return int(np.minimum(np.bincount(at[own[at] == region], minlength=len(own)), counts).sum())


def leaks(words: np.ndarray, bounds: np.ndarray, items: Items) -> list[tuple[int, int, float, int]]:
    """(text, item, score, end word) of each item that a text copies, its best place."""
    out: dict[tuple[int, int], tuple[float, int]] = {}
    if items.whole:
        size = np.diff(bounds)
        for t in np.flatnonzero((size > 0) & (size < GRAM)).tolist():
            x = items.whole.get(tuple(words[bounds[t] : bounds[t + 1]].tolist()))
            if x is not None:
                out[t, x] = (1.0, int(size[t]))
    text, place, gram = hits(words, bounds, items)
    sizes = items.bounds[gram + 1] - items.bounds[gram]
    entry = np.repeat(items.bounds[gram] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text, place = np.repeat(text, sizes), np.repeat(place, sizes)
    item, begin = items.of_item[entry], place - items.at[entry]
    order = np.lexsort((begin, item, text))
    i, text, item, begin = 0, text[order].tolist(), item[order].tolist(), begin[order].tolist()
    while i < len(text):
        t, x = text[i], item[i]
        own = items.words[x]
        slack = max(8, len(own) // 2)
        j = i + 1
        while j < len(text) and text[j] == t and item[j] == x and begin[j] - begin[j - 1] <= slack:
            j += 1
        a, b = max(int(bounds[t]), begin[i] - slack), min(int(bounds[t + 1]), begin[j - 1] + len(own) + slack)
        i, region = j, words[a:b]
        if most_matches(own, region) / len(own) < items.need[x]:
            continue
        score, end = align(own, region)
        share = score / (MATCH * len(own))
        if share >= items.need[x] and share > out.get((t, x), (0.0, 0))[0]:
            out[t, x] = (share, a + end - int(bounds[t]))
    return [(t, x, s, e) for (t, x), (s, e) in sorted(out.items())]


def prepared(benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS):
    """(items, whether they are all) block by block; one block is on the driver at a time."""
    texts = benchmark.where("text is not null").groupBy("text").agg(F.collect_set(F.struct(F.col("item_id").cast("long").alias("id"))).alias("ids"))
    total = texts.agg(F.sum(F.size(F.split("text", r"\s+")) + F.size("ids")).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        items = index([([x.id for x in r.ids], r.text) for r in sorted(rows, key=lambda r: r.text)], threshold)
        if items:
            yield items, blocks == 1


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that it copies: doc_id, item_id, score (share of
    the item's best alignment, threshold or more), last_word (where the copy ends in the document)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, last_word long"
    out = spark.createDataFrame([], schema)
    for items, all_ in prepared(benchmark, threshold, block_words):
        known = spark.sparkContext.broadcast(items)

        def run(batches, known=known):
            own = known.value
            for batch in slices(batches, 1, SLICE_BYTES):
                found = [(t, i, s, e) for t, x, s, e in leaks(*numbered(batch.column(1), own.number), own) for i in own.ids[x]]
                doc = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "score", "last_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        if all_:
            return part
        out = out.unionByName(cut(part, "leaks"))
        known.unpersist()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the documents that copy a test item."""
    at = docs.columns.index("text")
    for items, all_ in prepared(benchmark, threshold, block_words):
        known = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, known=known):
            for batch in slices(batches, at, SLICE_BYTES):
                bad = {f[0] for f in leaks(*numbered(batch.column(at), known.value.number), known.value)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not all_:
            docs = cut(docs, "clean")
            known.unpersist()
    return docs
