"""Order-preserving packing of token sequences by dynamic programming.

The tokens of all documents, in doc_id order, form a line that is cut into windows of at most
``window`` tokens. Cuts may fall at the end of a document (free), at the end of a sentence or,
inside runs of tokens without sentence ends, at fixed steps; the last two cost a truncation
penalty in tokens. A window costs its padding up to ``window``, none if its length is a power of
two from ``least_power`` on. For cut positions p and costs

    dp[j] = penalty[j] + each + min( min over i, p[j]-p[i] <= window, of dp[i]+p[i]  + window-p[j],
                                     min over powers 2^k of dp[i] with p[j]-p[i] = 2^k )

where the first minimum slides over a window, so a monotone queue gives it in constant time.

Documents are range-partitioned by doc_id, then text hash and place in the input, so that every
partition packs a run of documents on its own, one doc_id with most rows is divided too, and memory is bounded: about ``chunk`` tokens are solved at a time and the open last window
is carried into the next chunk. Only the last window of a partition is left short.

Defined results: null text counts as empty, its document is the end id alone; repeated rows are
packed as often as they come; rows of one doc_id follow in the order of a hash of their text; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_order
from .tokens import Encoder, slices, vocabulary_path

WINDOW = 2048
#: Costs in tokens: of a cut inside a document at a sentence end, of one elsewhere, of any window.
SENTENCE, ELSEWHERE, EACH = 8, 40, 24
LEAST_POWER = 256
STEP = 32
CHUNK = 1 << 19


def sentence_ends(tokenizer) -> np.ndarray:
    """Whether an id's text closes a sentence."""
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for word, i in vocab.items():
        out[i] = word.removesuffix("</w>").rstrip("\"')")[-1:] in (".", "!", "?")
    return out


def candidates(n: int, doc_ends: np.ndarray, marks: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in 0..n and their penalties. Gaps over two steps get cuts of the dearer kind."""
    strong = np.zeros(n + 1, bool)
    strong[0] = strong[n] = True
    strong[doc_ends] = True
    some = strong.copy()
    some[np.flatnonzero(marks) + 1] = True
    at = np.flatnonzero(some)
    gaps = np.flatnonzero(np.diff(at) > 2 * step)
    extra = [np.arange(at[g] + step, at[g + 1], step) for g in gaps]
    pos = np.sort(np.concatenate((at, *extra))) if extra else at
    return pos, np.where(strong[pos], 0, np.where(some[pos], SENTENCE, ELSEWHERE))


def solve(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW, least_power: int = LEAST_POWER, each: int = EACH) -> tuple[list[int], list[int]]:
    """dp and the previous cut for each cut position; gaps must be at most ``window``."""
    exact: dict[int, list[int]] = {}
    power = least_power
    while power < window:
        i = np.searchsorted(pos, pos - power)
        for j in np.flatnonzero((pos >= power) & (pos[np.minimum(i, len(pos) - 1)] == pos - power)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        power *= 2
    p, cost = pos.tolist(), (penalty + each).tolist()
    dp, prev, value = [0] * len(p), [0] * len(p), [0] * len(p)
    queue, head = [0], 0
    value[0] = p[0]
    for j in range(1, len(p)):
        here = p[j]
        low = here - window
        while p[queue[head]] < low:
            head += 1
        i = queue[head]
        best = value[i] + window - here
        if j in exact:
            for k in exact[j]:
                if dp[k] < best:
                    best, i = dp[k], k
        best += cost[j]
        dp[j], prev[j] = best, i
        v = value[j] = best + here
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return dp, prev


def best_cuts(pos: np.ndarray, dp: list[int], prev: list[int], window: int, last: bool) -> np.ndarray:
    """Ends of the windows. Unless this is the last chunk, the cheapest end in the last window's
    reach closes it and the rest stays open."""
    j = len(pos) - 1
    if not last:
        reach = int(np.searchsorted(pos, pos[-1] - window, side="right"))
        if reach > 0:
            j = min(range(reach, len(pos)), key=lambda k: (dp[k], -k))
    out = []
    while j:
        out.append(int(pos[j]))
        j = prev[j]
    return np.array(out[::-1], dtype=np.int64)


class Packer:
    """Packs one run of documents; ``add`` and ``finish`` give finished pieces as Arrow batches."""

    def __init__(self, part: int, marks: np.ndarray, window: int, chunk: int):
        self.part, self.marks, self.window, self.chunk = part, marks, window, chunk
        self.sequence = 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, tokens, position of its first token in the open line
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append((doc_id, len(ids), self.n))
        self.ids.append(ids)
        self.n += len(ids)
        if self.n >= self.chunk:
            yield self.close(False)

    def finish(self):
        while self.n:
            yield self.close(True)

    def close(self, last: bool) -> pa.RecordBatch:
        flat = np.concatenate(self.ids)
        starts = np.array([d[2] for d in self.docs], dtype=np.int64)
        sizes = np.array([d[1] for d in self.docs], dtype=np.int64)
        ends = starts + sizes
        pos, penalty = candidates(len(flat), ends[ends <= len(flat)], self.marks[flat])
        ends_of = best_cuts(pos, *solve(pos, penalty, self.window), self.window, last)
        done = int(ends_of[-1])
        edges = np.unique(np.concatenate(([0], ends_of, ends[ends <= done])))
        a, b = edges[:-1], edges[1:]
        doc, win = np.searchsorted(ends, a, side="right"), np.searchsorted(ends_of, a, side="right")
        first = np.concatenate(([0], ends_of[:-1]))
        raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()), pa.array(a - starts[doc]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array((self.part << 32) + self.sequence + win), pa.array(a - first[win])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(ends_of)
        kept = int(np.searchsorted(ends, done, side="right"))
        self.docs = [(d, m, s - done) for d, m, s in self.docs[kept:]]
        self.ids = [flat[done:]] if done < len(flat) else []
        self.n = len(flat) - done
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """One row per piece of a document (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or vocabulary_path()
    ranged = in_order(docs)

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), sentence_ends(encoder.tokenizer), window, chunk)
        tail = np.array([end_id], dtype=np.uint32)
        for batch in slices(batches, 1):
            flat, bounds = encoder.encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                yield from packer.add(doc, np.concatenate((flat[a:b], tail)))
        yield from packer.finish()

    return ranged.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
