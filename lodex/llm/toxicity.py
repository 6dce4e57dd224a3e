"""Toxicity scores by a factorization machine over hashed terms.

A text's features are its distinct lower-cased words and, for long words, their first letters
(insults take many endings), hashed to ``2**bits`` columns. The score is

    sigmoid( b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ] )

with x_i = 1 for each feature present. Only columns that tell the labels apart beyond chance carry
weights, alone or in a pair with another; so a long harmless text is not the sum of many
small noises, and words that mean something together only are learned. The factors v add pairwise interactions, such as an insult with a mention of a
group, to the additive weights w. Training is AdaGrad on a bounded sample of labelled rows
(``max_rows``, documented; chosen by a hash of doc_id and text, rows that repeat both once);
scoring runs over every whole text.

Defined results: a null text counts as empty and scores as the bias alone; rows whose label is
missing or null do not train; without labels of both classes every score is 0; repeated rows are
scored as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .tokens import lay_out, slices

BITS = 20
PREFIXES = (4, 5)
#: Bound on the labelled rows that training reads.
MAX_ROWS = 20_000
#: Texts that must have a column, share that must have a column of a pair, and the chi-squared values beyond
#: chance: of a column alone, and of one among millions of pairs.
LEAST_ROWS, PAIR_SHARE, ALONE, TOGETHER = 4, 0.01, 12, 40
#: Columns whose pairs with all others are counted at once, and texts laid out at once; they bound memory, not results.
PAIR_BLOCK, PAIR_TEXTS = 64, 512
THRESHOLD = 0.7


def of_word(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def worded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words (runs of letters) of all texts, the number of each word in turn,
    and the bounds of each text's words."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+")
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]


def hashed(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each word, and their bounds; the empty word has none."""
    mask, flat, ends = (1 << bits) - 1, [], [0]
    for word in words:
        if word:
            flat += [zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask for t in of_word(word)]
        ends.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)


def present(texts: pa.Array, bits: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every column present, once, by text and column. With ``place`` columns
    become its values, and those with a negative one are left out."""
    words, index, bounds = worded(texts)
    flat, of = hashed(words, bits)
    if place is not None:
        flat = place[flat].astype(np.int64)
        kept = np.concatenate(([0], np.cumsum(flat >= 0)))
        flat, of = flat[flat >= 0], kept[of]
    columns, ends = lay_out(flat, of, index)
    text = np.repeat(np.arange(len(texts)), np.diff(ends[bounds]))
    key = np.unique((text << bits) | columns)
    return key >> bits, key & ((1 << bits) - 1)


def columns_of(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    text, column = present(texts, bits)
    return np.split(column, np.searchsorted(text, np.arange(1, len(texts)))) if len(texts) else []


def columns(text: str | None, bits: int = BITS) -> np.ndarray:
    return columns_of(pa.array([text], pa.string()), bits)[0]


@dataclass
class Machine:
    """index: column -> position among the weighed columns, -1 for the rest."""

    bits: int
    weighed: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray) -> float:
        """``at``: positions of the weighed columns that are present."""
        if not len(self.w):
            return self.bias
        v = self.v[at]
        return float(self.bias + self.w[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def scores(self, texts) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        place = np.full(1 << self.bits, -1, np.int32)
        place[self.weighed] = np.arange(len(self.weighed))
        text, at = present(texts, self.bits, place)
        n = len(texts)
        sums = np.zeros((n, self.v.shape[1]))
        np.add.at(sums, text, self.v[at])
        z = self.bias + np.bincount(text, self.w[at], n) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(text, (self.v[at] ** 2).sum(axis=1), n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chi_squared(toxic: np.ndarray, every: np.ndarray, n: int, p: float) -> np.ndarray:
    """How far the share of label 1 among ``every`` texts is from the whole's, 0 where undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (toxic - every * p) ** 2 / (every * p * (1 - p)) * (n / np.maximum(n - every, 1))
    return np.where(np.isfinite(chi), chi, 0)


def met(texts: list[np.ndarray], low: int, high: int, n: int) -> np.ndarray:
    """How many texts have each of the columns low to high beside each of low to n."""
    out = np.zeros((high - low, n - low), np.float32)
    for i in range(0, len(texts), PAIR_TEXTS):
        x = np.zeros((len(texts[i : i + PAIR_TEXTS]), n - low), np.float32)
        for k, at in enumerate(texts[i : i + PAIR_TEXTS]):
            x[k, at[at >= low] - low] = 1
        out += x[:, : high - low].T @ x
    return out


def choose(rows: list[np.ndarray], labels: np.ndarray, bits: int, least_rows: int = LEAST_ROWS, pair_share: float = PAIR_SHARE) -> np.ndarray:
    """Columns that tell the labels apart beyond chance, alone or together with another one. Alone:
    those that ``least_rows`` texts have. In pairs: all pairs of columns that a share ``pair_share`` of
    the texts have, if they speak for label 1; as there are so many pairs, chance reaches farther there.
    Pairs are first counted among the texts of label 1, and only those frequent enough among the rest."""
    every, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    for at, y in zip(rows, labels):
        every[at] += 1
        if y:
            toxic[at] += 1
    n, p = len(rows), float(labels.mean())
    telling = (chi_squared(toxic, every, n, p) > ALONE) & (every >= least_rows)
    common = np.flatnonzero(every >= max(least_rows, pair_share * n))
    common = common[np.argsort(-every[common], kind="stable")]
    place = np.full(1 << bits, -1, np.int32)
    place[common] = np.arange(len(common))
    own = [(found := place[at])[found >= 0] for at in rows]
    toxic_texts = [at for at, y in zip(own, labels) if y]
    alone = chi_squared(toxic[common], every[common], n, p)
    texts_of = np.zeros((len(common), -(-n // 64) * 8), np.uint8)  # a bit for each text
    for i, at in enumerate(own):
        texts_of[at, i >> 3] |= np.uint8(1 << (i & 7))
    texts_of = texts_of.view(np.uint64)
    # a pair's value can't be greater than with no text of label 0
    t = np.arange(n + 1)
    least = max(least_rows, int(np.argmax(chi_squared(t, t, n, p) > TOGETHER)))
    for low in range(0, len(common), PAIR_BLOCK):
        high = min(len(common), low + PAIR_BLOCK)
        both_toxic = met(toxic_texts, low, high, len(common))
        a, c = np.nonzero(both_toxic >= least)
        a, c = a[c >= a], c[c >= a]  # each pair once, from the commoner column
        both = np.concatenate([np.empty(0), *(np.bitwise_count(texts_of[low + a[i : i + 4096]] & texts_of[low + c[i : i + 4096]]).sum(axis=1) for i in range(0, len(a), 4096))])
        both, both_toxic = both.astype(np.float64), both_toxic[a, c].astype(np.float64)
        # beyond what either of the two shows alone
        found = (chi_squared(both_toxic, both, n, p) > TOGETHER + 2 * np.maximum(alone[low + a], alone[low + c])) & (both_toxic > both * p)
        telling[common[low + a[found]]] = True
        telling[common[low + c[found]]] = True
    return np.flatnonzero(telling)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = 4, epochs: int = 15, rate: float = 0.15, l2: float = 1e-4, least_rows: int = LEAST_ROWS, keep: float = 0.8, seed: int = 7, batch: int = 256) -> Machine:
    """Mini-batch AdaGrad on the logistic loss. In each pass a text shows only a random share
    ``keep`` of its weighed columns, at least one, so that one telling term is learned to be enough
    and doesn't rely on others beside it."""
    labels = np.asarray(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    if not len(rows) or labels.min() == labels.max():
        return Machine(bits, np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, factors)))
    weighed = choose(rows, labels, bits, least_rows)
    place = np.full(1 << bits, -1, np.int32)
    place[weighed] = np.arange(len(weighed))
    rows = [(p := place[at])[p >= 0] for at in rows]
    w, v = np.zeros(len(weighed)), rng.normal(0, 0.01, (len(weighed), factors))
    gw, gv, bias, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), np.log(labels.mean() / (1 - labels.mean())), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            shown = [r[rng.random(len(r)) < keep] if len(r) > 1 else r for r in (rows[k] for k in at)]
            shown = [r if len(r) or not len(rows[k]) else rows[k][[rng.integers(len(rows[k]))]] for r, k in zip(shown, at)]
            lengths = np.fromiter(map(len, shown), np.int64, len(at))
            flat = np.concatenate(shown).astype(np.int64)
            of = np.repeat(np.arange(len(at)), lengths)
            sums = np.zeros((len(at), factors))
            np.add.at(sums, of, v[flat])
            squares = np.bincount(of, (v[flat] ** 2).sum(axis=1), len(at))
            z = bias + np.bincount(of, w[flat], len(at)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / len(at)
            bias -= rate * g.sum() / np.sqrt(gb := gb + g.sum() ** 2)
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, g[of], len(used)) + l2 * w[used]
            gw[used] += dw**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, g[of][:, None] * (sums[of] - v[flat]))
            dv += l2 * v[used]
            gv[used] += dv**2
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(bits, weighed, float(bias), w, v)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, train: Column | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed columns and labels of at most about ``max_rows`` distinct labelled rows, all if fewer."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    known = labels.where("toxic is not null and doc_id is not null").where(train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(train).withColumn("th", F.xxhash64("doc_id", "text"))
    n = texts.select("doc_id", "th").join(known, "doc_id", "left_semi").agg(F.approx_count_distinct("th").alias("n")).first().n
    if n > max_rows:  # before the join, so that only the sample's texts are shuffled
        texts = texts.where(F.pmod(F.xxhash64(F.lit(5), "th"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    texts = texts.select("doc_id", "text").distinct()

    def run(batches):
        for batch in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(np.int32) for c in columns_of(batch.column(0))], pa.list_(pa.int32())), batch.column(1)], names=["at", "toxic"])

    got = texts.join(known, "doc_id").select("text", "toxic").mapInArrow(run, "at array<int>, toxic int").toArrow()
    rows = [np.asarray(x.values) for chunk in got.column("at").chunks for x in chunk]
    return rows, np.asarray(got.column("toxic").combine_chunks(), dtype=np.float64) if got.num_rows else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    return fit(*sample(docs, labels, max_rows))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.value.scores(batch.column(2)))], names=["doc_id", "held_out", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. A null text scores as an empty
    one; repeated rows go or stay together; all columns are kept, whatever their names."""
    known, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, at):
            yield batch.filter(pa.array(known.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
