"""Shards of near-equal bytes by a k-d tree over document metadata.

A row's point has one coordinate for each metadata dimension: language, source and size (its
logarithm). The whole set is a node that owes all shards; a node that owes more than one is split
along its widest dimension (extent against that of the whole set) at the weighted median that
gives its halves bytes in proportion to the shards they owe. All nodes of a level are split
together. Rows are ordered along a dimension by one long: the coordinate, then two hashes of the
text, a hash of the id and one of the row's place in the input, 12 bits each. A median is found in
distributed histograms of bytes, 12 bits at a time, each inside the bin that the one before chose. So
a source, a language, a text or even one repeated row that holds a third of all rows is
divided like anything else, and the driver sees histograms of bounded size only.

Equal texts are groups: they take the least language and source of their group, so that no coordinate
parts them, and a median that falls inside a bin of whole texts lies beside it instead if the bin has
at most ``SLACK`` of a shard's bytes. Only heavier groups are divided.

The tree is applied as one expression over arrays with an entry for each node, whatever their number.
Slots are numbered in sub-buckets of a shard, whose sizes are summed first; no task sorts a whole
shard.

Defined results: null text has size 8 and crc32 0; null language, source and doc_id are values of
their own; repeated rows each take a slot; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 12
DIMENSIONS = ("c_lang", "c_source", "c_size")
#: Steps after the coordinate, and how many of them part texts only.
STEPS, TEXT_STEPS = 4, 2
#: Bytes of a group of equal texts that a cut goes round, as a share of a shard.
SLACK = 0.01
SUB_ROWS = 100_000
#: Parts into which the rows of one repeated text are dealt to meet their group's coordinates.
SALTS = 32


def hashed(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, row, coordinates and ``tie``, the order among equal coordinates."""

    def named(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in docs.columns else F.lit("")
        return hashed(value).cast("int")

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("th"),
        F.monotonically_increasing_id().alias("row"), named("lang").alias("c_lang"), named("source").alias("c_source"),
    )
    tie = F.lit(0).cast("long")
    for part in (hashed(F.col("th")), hashed(F.lit(3), F.col("th")), hashed(F.lit(1), F.col("doc_id")), hashed(F.lit(2), F.col("row"))):
        tie = F.shiftleft(tie, BITS).bitwiseOR(part)
    return base.select("*", F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size")) * 96)).cast("int").alias("c_size"), tie.alias("tie"))


def together(rows: DataFrame) -> DataFrame:
    """Rows of equal texts with one language and source. Only groups that differ in them are joined,
    and each group is salted."""
    mixed = rows.groupBy("th", "size").agg(*[f(c).alias(f"{n}_{c}") for c in DIMENSIONS[:2] for n, f in (("lo", F.min), ("hi", F.max))])
    mixed = mixed.where("lo_c_lang <> hi_c_lang or lo_c_source <> hi_c_source").select("th", "size", "lo_c_lang", "lo_c_source", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(mixed, ["th", "size", "salt"], "left")
    return joined.withColumns({c: F.coalesce(f"lo_{c}", c) for c in DIMENSIONS[:2]}).select(rows.columns)


@dataclass
class Tree:
    """Nodes by number, the root first. An inner node sends rows whose key along ``dim`` is under
    ``at`` to ``left``; a leaf has left = -1. ``first`` .. ``first + owed - 1`` are a node's shards."""

    first: list[int]
    owed: list[int]
    dim: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: int = 0

    def __post_init__(self):
        self.dim, self.at, self.left, self.right = [0], [0], [-1], [-1]

    def split(self, n: int, dim: int, at: int) -> list[int]:
        self.dim[n], self.at[n], self.left[n], self.right[n] = dim, at, len(self.first), len(self.first) + 1
        half = self.owed[n] // 2
        self.first += [self.first[n], self.first[n] + half]
        self.owed += [half, self.owed[n] - half]
        for x, none in ((self.dim, 0), (self.at, 0), (self.left, -1), (self.right, -1)):
            x += [none, none]
        return [self.left[n], self.right[n]]

    def node(self) -> Column:
        """The row's leaf."""
        dim, at, left, right = (by_number(x) for x in (self.dim, self.at, self.left, self.right))

        def step(n: Column, _: Column) -> Column:
            down = F.when(key_of(F.get(dim, n)) < F.get(at, n), F.get(left, n)).otherwise(F.get(right, n))
            return F.when(F.get(left, n) < 0, n).otherwise(down.cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step) if self.depth else F.lit(0)


def by_number(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def key_of(dim: Column) -> Column:
    coordinate = F.get(F.array(*[F.col(c).cast("long") for c in DIMENSIONS]), dim.cast("int"))
    return F.shiftleft(coordinate, STEPS * BITS).bitwiseOR(F.col("tie"))


def bin_of(values: np.ndarray, weights: np.ndarray, goal: float) -> tuple[int, float, float]:
    """The value inside which the running weight reaches ``goal``, the weight before it and its own."""
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    i = min(int(np.searchsorted(total, goal, side="right")), len(total) - 1)
    return int(values[order][i]), float(total[i] - weights[order][i]), float(weights[order][i])


def table(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [np.asarray(got.column(n).to_numpy()) for n in names]


def grow(rows: DataFrame, shards: int, slack: float = SLACK) -> Tree:
    tree, widths = Tree([0], [shards]), None
    open_ = [0] if shards > 1 else []
    while open_:
        placed = rows.withColumn("node", tree.node()).where(F.get(by_number([int(n in open_) for n in range(len(tree.first))]), F.col("node")) == 1)
        dims = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("v")) for i, c in enumerate(DIMENSIONS)])).alias("x")
        node, d, v, w = table(placed.select("node", "size", dims).groupBy("node", "x.d", "x.v").agg(F.sum("size").alias("w")), "node", "d", "v", "w")
        if widths is None:
            widths = [max(1, int(np.ptp(v[d == i]))) if (d == i).any() else 1 for i in range(len(DIMENSIONS))]
        n_nodes = len(tree.first)
        dim, prefix, goal, fair, settled = [0] * n_nodes, [-1] * n_nodes, [0.0] * n_nodes, [0.0] * n_nodes, {}
        for n in open_:
            own = node == n
            if not own.any():
                settled[n] = 0
                continue
            dim[n] = int(np.argmax([np.ptp(v[own & (d == i)]) / widths[i] for i in range(len(DIMENSIONS))]))
            at = own & (d == dim[n])
            fair[n] = float(w[at].sum()) / tree.owed[n]
            prefix[n], before, _ = bin_of(v[at], w[at], fair[n] * (tree.owed[n] // 2))
            goal[n] = fair[n] * (tree.owed[n] // 2) - before
        for step in range(1, STEPS + 1):
            if all(n in settled for n in open_):
                break
            rest = (STEPS - step) * BITS
            key = key_of(F.get(by_number(dim), F.col("node")))
            inside = F.shiftright(key, rest + BITS) == F.get(by_number([-1 if n in settled else p for n, p in enumerate(prefix)]), F.col("node"))
            low = F.shiftright(key, rest).bitwiseAND(F.lit((1 << BITS) - 1))
            node_in, v, w = table(placed.where(inside).groupBy("node", low.alias("v")).agg(F.sum("size").alias("w")), "node", "v", "w")
            for n in open_:
                if n in settled:
                    continue
                own = node_in == n
                value, before, whole = bin_of(v[own], w[own], goal[n])
                goal[n] -= before
                prefix[n] = (prefix[n] << BITS) + value
                if step == STEPS or step <= TEXT_STEPS and whole <= slack * fair[n]:
                    settled[n] = (prefix[n] + (goal[n] > whole / 2)) << rest
        open_ = [x for n in open_ for x in tree.split(n, dim[n], int(settled[n])) if tree.owed[x] > 1]
        tree.depth += 1
    return tree


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` with a slot that counts from 0 in each shard."""
    sizes = rows.groupBy("shard").count().agg(F.max("count").alias("n")).first().n or 0
    subs = max(8, -(-sizes // SUB_ROWS))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(F.lit(4), "row"), F.lit(subs)).cast("int"))
    counts = rows.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("row")) - 1)
    return numbered.join(before.select("shard", "sub", F.coalesce("before", F.lit(0)).alias("before")), ["shard", "sub"]).withColumn("slot", (F.col("at") + F.col("before")).cast("long"))


def shard(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id,
    text, lang, source). Give the number of shards, or the bytes that a shard should reach."""
    rows = cut(together(cut(points(docs), "points")), "points")
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size").alias("n")).first().n or 0) // target_bytes))
    tree = grow(rows, shards)
    placed = rows.withColumn("shard", F.get(by_number(tree.first), tree.node()).cast("int"))
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
