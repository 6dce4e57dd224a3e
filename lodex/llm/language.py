"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Filters of several widths run over
a window's one-hot bytes, so that a filter's response is a sum of one table entry for each byte it
covers; the largest response of each filter, rectified, feeds a softmax over the languages. A text's
probabilities are the mean over all its windows, weighted by their bytes. Training is Adam in numpy on
all windows of a bounded sample of documents (``max_docs``, documented), dealt evenly to the languages,
so that a language with few documents is learned however large the table; the error reaches the tables
only at each filter's best place. Prediction runs in batches of fixed-length windows over every whole text.

Defined results: ``und`` with score 0 for null texts, texts without letters (of any script; digits
and number signs like ``²`` are none) and when nothing was learned; rows with null lang do not train;
repeated rows are predicted as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound on the documents that training reads, and the least share of a language in it.
MAX_DOCS, LEAST_DOCS = 2_000, 20
#: Windows that are scored together.
BATCH = 512


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows_of(raw: bytes) -> np.ndarray:
    """All bytes as rows of WINDOW, the last filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: [width, 256, filters]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width, the largest response of each filter and its place."""
        got = []
        for table in self.tables:
            width = len(table)
            n = x.shape[1] - width + 1
            z = table[0][x[:, :n]]
            for j in range(1, width):
                z += table[j][x[:, j : n + j]]
            at = z.argmax(axis=1)
            got.append((np.take_along_axis(z, at[:, None], axis=1)[:, 0], at))
        return got

    def prepared(self) -> list[list[tuple[int, np.ndarray]]]:
        """For prediction: tables by pairs of bytes, half the lookups."""
        pairs = []
        for table in self.tables:
            width, own = len(table), []
            for j in range(0, width - 1, 2):
                own.append((j, (table[j][:, None] + table[j + 1][None, :]).reshape(65536, -1).astype(np.float32)))
            if width % 2:
                own.append((width - 1, None, table[width - 1].astype(np.float32)))
            pairs.append(own)
        return pairs

    def probabilities(self, x: np.ndarray, prepared) -> np.ndarray:
        both = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for table, own in zip(self.tables, prepared):
            n = x.shape[1] - len(table) + 1
            z = None
            for item in own:
                got = np.take(item[1], both[:, item[0] : item[0] + n], axis=0) if item[1] is not None else np.take(item[2], x[:, item[0] : item[0] + n], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return softmax(h @ self.out + self.out_bias)

    def predict(self, texts: list[str | None], prepared=None) -> list[tuple[str, float]]:
        prepared = prepared or self.prepared()
        result, rows, owner, last = [("und", 0.0)] * len(texts), [], [], []
        for k, text in enumerate(texts):
            if self.languages and text and has_letter(text):
                raw = text.encode("utf-8", "surrogatepass")
                rows.append(windows_of(raw))
                owner.append(k)
                last.append((len(raw) - 1) % WINDOW + 1)
        if not rows:
            return result
        counts = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        p = np.concatenate([self.probabilities(flat[i : i + BATCH], prepared) for i in range(0, len(flat), BATCH)])
        ends = np.cumsum(counts)
        size = np.full(len(flat), WINDOW)
        size[ends - 1] = last
        starts = ends - counts
        mean = np.add.reduceat(p * size[:, None], starts, axis=0) / np.add.reduceat(size, starts)[:, None]
        best = mean.argmax(axis=1)
        for k, b, m in zip(owner, best, mean):
            result[k] = (self.languages[b], float(min(1.0, m[b])))
        return result


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 128, seed: int = 3) -> Network:
    """Adam on the cross entropy of windows ``x`` with language numbers ``y``."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(f, np.float32), rng.normal(0, 0.2, (f, k)).astype(np.float32), np.zeros(k, np.float32))
    if k < 2:
        return net
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(y, minlength=k)
    weight = (len(y) / (k * np.maximum(share, 1)))[y]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            xb, n = x[at], len(at)
            got = net.responses(xb)
            h = np.concatenate([g[0] for g in got], axis=1) + net.bias
            a = np.maximum(h, 0)
            d = softmax(a @ net.out + net.out_bias)
            d[np.arange(n), y[at]] -= 1
            d *= (weight[at] / n)[:, None]
            dh = (d @ net.out.T) * (h > 0)
            grads = []
            for w, (table, (_, place)) in enumerate(zip(net.tables, got)):
                own, g = dh[:, w * FILTERS : (w + 1) * FILTERS], np.zeros_like(table)
                for j in range(len(table)):
                    np.add.at(g[j], (np.take_along_axis(xb, place + j, axis=1), np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [dh.sum(axis=0), a.T @ d, d.sum(axis=0)]
            t += 1
            for p, g, m, s in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All windows, and their labels, of at most about ``max_docs`` labelled documents, all if fewer.
    What a language leaves of its even share is not dealt again. The labels' counts come to the
    driver, as the network has an output for each."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    each = max(LEAST_DOCS, max_docs // len(counts))
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 20) * min(1.0, each / n)))])
    known = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < shares[F.col("lang")])

    def run(batches):
        for batch in pieces_of(batches):
            out = []
            for doc, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_letter(text):
                    out.append({"doc_id": doc, "lang": lang, "x": windows_of(text.encode("utf-8", "surrogatepass")).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())]))

    rows = sorted({(r["doc_id"], r["lang"], r["x"]) for r in known.mapInArrow(run, "doc_id long, lang string, x binary").toArrow().to_pylist()})
    languages = sorted({r[1] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    return x, np.repeat(np.array([number[r[1]] for r in rows], dtype=np.int64), [len(r[2]) // WINDOW for r in rows]), languages


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network:
    return fit(*sample(docs, max_docs))


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        prepared = known.value.prepared()
        for batch in pieces_of(batches, 128):
            got = known.value.predict(batch.column(2).to_pylist(), prepared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
