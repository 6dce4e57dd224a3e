"""Token ids in a fixed-width bit-packed file format.

A file image is one run of documents in ascending doc_id order:

    magic ``LXBP1\\0`` | bits u16 | documents u32 | ids u64 | ids per block u32 | first id u64
    doc_id i64 for each document | end u64 for each document (ids from the image's first id)
    offset u64 for each block (32-bit words from the start of the payload)
    payload: blocks of packed 32-bit little-endian words
    a byte for each document: 1 if it has no doc_id (its place above then holds 0)

Every id takes the same number of bits, the least that holds the vocabulary's largest id. Ids are
packed in groups of 32, which fill exactly ``bits`` words, so packing and unpacking are 32 vector
operations whatever the length, and any id range is read from its block without its predecessors.

Images are written by Spark as the binary column of a Parquet table, so that the job commits them
atomically in any store, and a lost executor's part is written again. ``save`` and ``open_image``
put one image in a plain file and map it for random access.

Defined results: null text counts as empty and is the end id alone; repeated rows and doc_ids
are kept, rows of one doc_id in the order of a hash of their text; an empty table gives no images;
null doc_ids come first, as the smallest, and come back as null.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, remove_at_end, scratch
from .tokens import Encoder, slices, vocabulary_path

HEAD = struct.Struct("<6sHIQIQ")
MAGIC = b"LXBP2\0"
GROUP = 32
BLOCK_IDS = 4096
IMAGE_IDS = 1 << 20


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """32-bit words that hold ``ids`` at ``bits`` bits each, low bits first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    lanes = np.zeros((-(-len(ids) // GROUP), GROUP), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits + 2), np.uint64)
    for i in range(GROUP):
        at, shift = divmod(i * bits, 32)
        value = lanes[:, i] << np.uint64(shift)
        words[:, at] |= value & np.uint64(0xFFFFFFFF)
        words[:, at + 1] |= value >> np.uint64(32)
    return words[:, :bits].astype("<u4").reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = words.reshape(-1, bits).astype(np.uint64)
    rows = np.concatenate((rows, np.zeros((len(rows), 1), np.uint64)), axis=1)
    out, mask = np.empty((len(rows), GROUP), np.uint32), np.uint64((1 << bits) - 1)
    for i in range(GROUP):
        at, shift = divmod(i * bits, 32)
        out[:, i] = ((rows[:, at] | (rows[:, at + 1] << np.uint64(32))) >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def image(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, first: int = 0, block_ids: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    starts = range(0, len(flat), block_ids)
    blocks = [pack(flat[i : i + block_ids], bits) for i in starts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[: len(blocks)].astype("<u8")
    own, none = np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((HEAD.pack(MAGIC, bits, len(doc_ids), len(flat), block_ids, first), own.tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *(b.tobytes() for b in blocks), none.tobytes()))


class Image:
    """A file image: its documents, and any range of its ids."""

    def __init__(self, data):
        magic, self.bits, docs, self.n_ids, self.block_ids, self.first = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        n = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", n, at + 16 * docs).astype(np.int64)
        last = self.n_ids - (n - 1) * self.block_ids
        words = int(self.offsets[-1]) + -(-last // GROUP) * self.bits if n else 0
        at += 16 * docs + 8 * n
        self.words = np.frombuffer(data, "<u4", words, at)
        self.no_id = np.frombuffer(data, np.uint8, docs, at + 4 * words).astype(bool)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        word_end = self.offsets[b + 1] if b + 1 < len(self.offsets) else len(self.words)
        base = a * self.block_ids
        if self.block_ids % GROUP == 0:
            got = unpack(self.words[self.offsets[a] : word_end], self.bits, min(self.n_ids, (b + 1) * self.block_ids) - base)
        else:
            edges = [*self.offsets[a : b + 1], word_end]
            got = np.concatenate([unpack(self.words[x:y], self.bits, min(self.block_ids, self.n_ids - (a + k) * self.block_ids)) for k, (x, y) in enumerate(zip(edges, edges[1:]))])
        return got[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def save(data: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(data)


def open_image(path: str) -> Image:
    return Image(np.memmap(path, np.uint8, "r"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, image_ids: int = IMAGE_IDS) -> None:
    """Tokenise ``docs`` (doc_id, text) and write file images in ascending doc_id order as a
    table (part, seq, n_docs, n_ids, data) at ``path``; ``first`` in an image counts within its part."""
    tokenizer = tokenizer or vocabulary_path()
    ranged = in_order(docs)

    def run(batches):
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(max(end_id, encoder.tokenizer.get_vocab_size() - 1))
        tail = np.array([end_id], dtype=np.uint32)
        seq = first = n = 0
        held_docs, held = [], []

        def flush():
            nonlocal seq, first, n, held_docs, held
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(held), "n_ids": n, "data": image(held_docs, held, bits, first)}], schema=schema)
            seq, first, n, held_docs, held = seq + 1, first + n, 0, [], []
            return row

        for batch in slices(batches, 1):
            flat, bounds = encoder.encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = np.concatenate((flat[a:b], tail))
                held_docs.append(doc)
                held.append(ids)
                n += len(ids)
                if n >= image_ids:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    ranged.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def read_back(spark, path: str) -> DataFrame:
    """Per document of the images at ``path``: doc_id, start, n_tokens, ids_crc32, from the files.
    Only one number for each part goes to the driver."""
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, so_far = {}, 0
    for row in totals:
        before[row.part], so_far = so_far, so_far + row.n

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Image(data.as_buffer())
                ids = own.ids().astype("<u4")
                starts = np.concatenate(([0], own.ends[:-1])) if len(own.ends) else own.ends
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), own.ends.tolist())]
                doc = pa.array(own.doc_ids.astype(np.int64), mask=own.no_id)
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts + own.first + before[part]), pa.array(own.ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    remove_at_end(docs.sparkSession, path)
    return read_back(docs.sparkSession, path)
