"""SimHash near-duplicate detection with pigeonring candidate filtering.

Fingerprints are compared only where they can be close. The 64 bits form a ring of
``segments`` consecutive segments. If two fingerprints differ in at most ``distance`` bits,
then some segment of the ring starts chains of every length l whose first l segments differ
in at most floor(l * distance / segments) bits together. With more segments than allowed
differing bits the first segment of such a chain is equal, which gives a hash-partitioned
candidate search; the longer chains are checked before the full Hamming distance.

Exact copies share a fingerprint and are one node of the search. Within a bucket only the edges
of a spanning forest leave a task, never all pairs; buckets over ``block`` fingerprints are
split into pairs of blocks, so a task holds at most two blocks of one bucket at a time.

``near_duplicates`` links 64-bit fingerprints that differ in few bits. ``deduplicated``, which keeps
one text of each group of copies, links texts whose shingle sets have a Jaccard similarity of 0.8 or
more: fingerprints of 512 bits on the same ring of segments, chains and blocks give loose groups of
candidates, and within these every link is confirmed on the whole shingle sets.

Defined results: null text counts as empty; a text without words has fingerprint zero and links
like any other; repeated rows appear as often as they come in; an empty table gives an empty
result; rows with null doc_id are kept and take the smallest non-null doc_id of their component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_at, pieces_of, remove

SHINGLE = 4
SEED = 42
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text over word shingles, repeats included. Only A-Z are
    lower-cased and only ASCII white space separates words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the whole text, fp the fingerprint as a signed integer."""

    def run(batches):
        for batch in pieces_of(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def cuts(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [i * 64 // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_masks(segments: int) -> np.ndarray:
    """[i, l-1]: the bits of the l segments of the ring that start at segment i."""
    single = [((1 << width) - 1) << low for low, width in cuts(segments)]
    return np.array([[sum(single[(i + k) % segments] for k in range(length)) for length in range(1, segments + 1)] for i in range(segments)], dtype=np.uint64)


def survives(differing: np.ndarray, start: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """Which pairs pass the chain test at their starting segment; the chain of full length is
    the Hamming check itself."""
    masks, alive = chain_masks(segments), np.arange(len(differing))
    for length in range(2, segments + 1):
        if not len(alive):
            break
        budget = length * distance // segments
        alive = alive[np.bitwise_count(differing[alive] & masks[start[alive], length - 1]) <= budget]
    return alive


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges, the smallest node of each component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def group_edges(key: np.ndarray, side: np.ndarray, close, step: int = 1 << 20):
    """Spanning edges of the close pairs among rows of equal, sorted ``key``. side is 0 where a
    row stands for both blocks, else 1 or 2: then only pairs of different sides are compared.
    close(a, b) says which of the pairs (a[i], b[i]) are close."""
    n = len(key)
    last = np.searchsorted(key, key, side="right")
    lefts, rights = [], []
    pending = 0

    def shrink():
        nonlocal lefts, rights, pending
        if lefts:
            label = forest(np.concatenate(lefts), np.concatenate(rights), n)
            kept = np.flatnonzero(label != np.arange(n))
            lefts, rights, pending = [kept], [label[kept]], len(kept)

    rows, d = np.arange(n), 1
    while len(rows := rows[rows + d < last[rows]]):
        for at in np.array_split(rows, max(1, len(rows) // step)):
            pick = at[(side[at] == 0) | (side[at] != side[at + d])]
            alive = close(pick, pick + d)
            if len(alive):
                lefts.append(pick[alive])
                rights.append(pick[alive] + d)
                pending += len(alive)
        if pending > 4 * n + step:
            shrink()
        d += 1
    shrink()
    return (lefts[0], rights[0]) if lefts else (np.empty(0, np.int64), np.empty(0, np.int64))


KEYS = ["seg", "val", "lo", "hi"]


def dealt(indexed: DataFrame, carried: list[str], block: int, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of a segment index (node, seg, val, ...) with the pair of blocks they are compared in:
    one for buckets of up to ``block`` rows; of larger ones each row goes to all pairs of its block.
    ``sizes`` (seg, val, nb) gives the number of blocks where it isn't that of the rows."""
    if sizes is None:
        sizes = indexed.groupBy("seg", "val").count().where(F.col("count") > block).select("seg", "val", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    placed = indexed.join(sizes, ["seg", "val"], "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    placed = placed.withColumn("other", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    placed = placed.select("seg", "val", lo.alias("lo"), hi.alias("hi"), F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).alias("side"), "node", *carried)
    return placed.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")


def bucket_edges(placed: DataFrame, close_of, step: int = 1 << 20) -> DataFrame:
    """(a, b): spanning edges within each bucket. close_of(columns) gives the test for pairs."""

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:4]]) if len(cols[0]) else np.empty(0, bool)
            breaks = np.flatnonzero(~same) + 1
            if not len(breaks):
                held = cols
                continue
            at = breaks[-1]
            held = [c[at:] for c in cols]
            yield from edges([c[:at] for c in cols], same[: at - 1])
        if held and len(held[0]):
            yield from edges(held, np.logical_and.reduce([c[1:] == c[:-1] for c in held[:4]]))

    def edges(cols, same):
        a, b = group_edges(np.concatenate(([0], np.cumsum(~same))), cols[4], close_of(cols), step)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(cols[5][a]), pa.array(cols[5][b])], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, distance: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints at most ``distance`` bits apart; their
    connected components are those of all such pairs. ``distinct`` has one column fp."""
    segments = segments or distance + 1
    if not distance < segments <= 64:
        raise ValueError("segments must exceed distance, so that a chain starts with an equal segment")
    values = [F.shiftrightunsigned("node", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in cuts(segments)]
    indexed = distinct.select(F.col("fp").alias("node")).select("node", F.posexplode(F.array(*values)).alias("seg", "val"))

    def close_of(cols):
        fp, start = cols[5].astype(np.int64).view(np.uint64), cols[0]
        return lambda a, b: survives(fp[a] ^ fp[b], start[a], segments, distance)

    return bucket_edges(dealt(indexed, [], block), close_of)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node of its component:
    alternating large and small stars over written tables until nothing changes."""
    now, path = cut_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else table
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    mark = None
    for _ in range(rounds):
        new, new_path = cut_at(star(star(now, True), False), "edges")
        remove(now.sparkSession, path)
        now, path = new, new_path
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, distance: int, shingle: int, segments: int | None, block: int) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row."""
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    lowest = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(lowest.select("fp"), distance, segments, block))
    linked = lowest.join(roots, lowest.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = cut(linked.join(linked.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id"), "components")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = SHINGLE, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links of at most ``distance`` bits)."""
    out = grouped(docs, distance, shingle, segments, block)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WORDS, WIDE_SHINGLE, SIMILARITY = 8, 5, 0.8
#: Bits of an indexed segment, and of a link of the chains.
WIDE_SEGMENT, LINK = 14, 16
#: Bits of an indexed segment where candidates are looked for, deviations that they may differ by
#: beyond what is expected at the similarity, and shingles of a block whose sets are compared.
CANDIDATE_SEGMENT, CANDIDATE_SLACK, BLOCK_SHINGLES = 12, 4.0, 1 << 21


def segment_values(names: list[str], width: int = WIDE_SEGMENT) -> list[Column]:
    """Consecutive segments of ``width`` bits of a fingerprint in 64-bit columns."""
    out = []
    for at in range(0, 64 * len(names) - width + 1, width):
        k, low = divmod(at, 64)
        value = F.shiftrightunsigned(names[k], low)
        if low + width > 64:
            value = value.bitwiseOR(F.shiftleft(names[k + 1], 64 - low))
        out.append(value.bitwiseAND(F.lit((1 << width) - 1)))
    return out


def shingle_hashes(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return np.array([digest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` independent 64-bit SimHashes of a set of hashes: each is mixed anew for every word."""
    counts = np.zeros(words * 64, np.int64)
    for i in range(0, len(hashes), 4096):
        z = hashes[i : i + 4096, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, words + 1, dtype=np.uint64)[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def wide_fingerprint(text: str | None, words: int = WORDS, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """``words`` independent 64-bit SimHashes of a text's distinct shingles."""
    return set_fingerprint(shingle_hashes(text, shingle), words)


def allowed_bits(similarity: float, bits: int, slack: float = 0.5) -> int:
    """Differing bits to be expected at a Jaccard similarity: two sets of one size have the cosine
    2j / (1 + j), sets of different sizes a greater one, and a SimHash bit differs with the angle's
    share of a half turn. ``slack`` deviations more: at 0.5 more than two thirds of the pairs right at
    the similarity are within, at 4 all but about three in 100,000."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(share * bits + slack * np.sqrt(bits * share * (1 - share))))


def wide_close(fp: np.ndarray, start: np.ndarray, distance: int):
    """Pair test on fingerprints [n, words]. Chains of consecutive 16-bit links from the one where the
    equal segment starts, each length with its share of the distance and three deviations of slack (so that a pair within the
    distance hardly ever fails), then the whole Hamming distance."""
    flat = np.ascontiguousarray(fp).view(np.uint16)
    ring = flat.shape[1]

    def close(a, b):
        alive = np.arange(len(a))
        for low, high in ((1, 2), (2, 4), (4, 8)):
            if high == 2:
                total = np.zeros(len(a), np.int64)
            at = (start[a[alive], None] + np.arange(low, high)[None, :]) % ring
            total = total + np.bitwise_count(flat[a[alive, None], at] ^ flat[b[alive, None], at]).sum(axis=1, dtype=np.int64)
            budget = (high - 1) * distance / ring
            ok = total <= budget + 3 * np.sqrt(budget) + 1
            alive, total = alive[ok], total[ok]
        return alive[np.bitwise_count(fp[a[alive]] ^ fp[b[alive]]).sum(axis=1) <= distance]

    return close


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.count_nonzero(big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small)) if len(small) else 0


def set_close(fp: np.ndarray, sets: list[np.ndarray], similarity: float, distance: int):
    """Pair test on the sets themselves. Pairs that earlier links join already count as not close:
    they would change no group. Sizes and fingerprints are looked at first."""
    size, parent = np.array([len(x) for x in sets]), list(range(len(sets)))
    label = np.arange(len(sets))

    def top(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def close(a, b):
        nonlocal label
        least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        maybe = np.flatnonzero((least >= similarity * most - 1e-9) & (label[a] != label[b]))
        maybe = maybe[np.bitwise_count(fp[a[maybe]] ^ fp[b[maybe]]).sum(axis=1) <= distance]
        found = []
        for k, i, j in zip(maybe.tolist(), a[maybe].tolist(), b[maybe].tolist()):
            x, y = top(i), top(j)
            if x != y:
                common = shared(sets[i], sets[j])
                if common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                    parent[max(x, y)] = min(x, y)
                    found.append(k)
        if found:
            label = np.array([top(k) for k in range(len(sets))])
        return np.array(found, np.int64)

    return close


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, shingle: int = WIDE_SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, root) for every row: groups of texts whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more, chained. Texts of equal sets are one node. Candidates have
    an equal 12-bit segment of their fingerprints, which two in a thousand pairs right at 0.8 and
    practically none at 0.85 lack, and a distance with four deviations of slack; they are chained to
    loose groups, and within each all pairs are measured by their sets."""
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        for batch in pieces_of(batches):
            node, size, found = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_hashes(text, shingle)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                found.append(set_fingerprint(own, words))
            found = np.array(found, dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), *(pa.array(found[:, k]) for k in range(words))], names=["doc_id", "th", "node", "n", *names])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    marked = cut(given.mapInArrow(run, f"doc_id long, th long, node long, n long, {', '.join(f'{n} long' for n in names)}"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")
    distinct = marked.groupBy("node", "n", *names).agg(first).select("node", "n", *names, F.col("x.doc_id").alias("kept_id"), F.col("x.th").alias("kept_th"))
    distinct = cut(distinct, "distinct")
    indexed = distinct.select("node", *names, F.posexplode(F.array(*segment_values(names, CANDIDATE_SEGMENT))).alias("seg", "val"))
    distance = allowed_bits(similarity, words * 64, CANDIDATE_SLACK)

    def bits_of(cols):
        return np.stack(cols[6 : 6 + words], axis=1).astype(np.int64).view(np.uint64)

    def candidates(cols):
        return wide_close(bits_of(cols), cols[0].astype(np.int64) * CANDIDATE_SEGMENT // LINK, distance)

    def confirmed(cols):
        return set_close(bits_of(cols), [np.frombuffer(x, np.uint64) for x in cols[6 + words]], similarity, distance)

    def sets(batches):
        for batch in pieces_of(batches):
            hashes = pa.array([shingle_hashes(t, shingle).tobytes() for t in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], hashes], names=[*batch.schema.names[1:], "hashes"])

    loose = components(bucket_edges(dealt(indexed, names, block), candidates, 1 << 17))
    loose = loose.union(loose.select(F.col("root").alias("node"), "root").distinct())
    members = cut(distinct.join(loose, "node").select("node", F.lit(0).alias("seg"), F.col("root").alias("val"), *names, "n", "kept_id", "kept_th"), "members")
    whole = given.join(members, members.kept_id.eqNullSafe(given.doc_id) & (members.kept_th == given.th)).select("text", "node", "seg", "val", *names)
    whole, path = cut_at(whole.mapInArrow(sets, f"node long, seg int, val long, {', '.join(f'{n} long' for n in names)}, hashes binary"), "shingles")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("seg", "val").agg(blocks.alias("nb")).where("nb > 1")
    roots = components(bucket_edges(dealt(whole, [*names, "hashes"], block, sizes), confirmed, 1 << 17))
    remove(docs.sparkSession, path)
    return marked.join(roots, marked.node == roots.node, "left").select("doc_id", "th", F.coalesce("root", marked.node).alias("root"))


def keep_one(docs: DataFrame, groups: DataFrame, root: str = "root") -> DataFrame:
    """``docs`` with one document of each group: the smallest (doc_id, text hash). ``groups`` has
    doc_id, th and the group's ``root`` for every row. Rows without doc_id stand after all others."""
    first = groups.groupBy(root).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.th").alias("kept_th"))
    first = cut(first.distinct(), "kept")
    out = docs.join(first, first["kept_id"].eqNullSafe(docs["doc_id"].cast("long")) & (first["kept_th"] == F.xxhash64(docs["text"])), "left_semi")
    if groups.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return out
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    number = "row_number of " + "_".join(docs.columns)
    return out.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group of exact or near copies."""
    return keep_one(docs, cut(similar_groups(docs, similarity, shingle=shingle, block=block), "groups"))
