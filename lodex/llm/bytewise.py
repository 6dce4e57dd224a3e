"""Work on the UTF-8 bytes of whole Arrow arrays of texts: maps of bytes, words as codes, counts by text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in turn and the bounds of each; null reads as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return flat, bounds - bounds[0] if len(texts) else np.zeros(1, np.int64)


def table(separators: list[int], lower: bool = False) -> np.ndarray:
    """A map of bytes: separators become spaces, A-Z become a-z if wanted. Only bytes under 128 may
    be separators, so characters beyond ASCII stay whole."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[separators] = 32
    return out


WHITE = [32, *range(9, 14)]


def sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks are set within each text."""
    run = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=run[1:])
    return (run[bounds[1:]] - run[bounds[:-1]]).astype(np.int64)


@dataclass
class Words:
    """Word i is ``names[codes[i]]`` of text ``of[i]``; the words of a text follow each other."""

    codes: np.ndarray
    of: np.ndarray
    names: pa.Array


def words(flat: np.ndarray, bounds: np.ndarray, mapped: np.ndarray) -> Words:
    """What lies between the spaces of the mapped bytes."""
    n = len(bounds) - 1
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(mapped[flat].tobytes()))
    cut = pc.split_pattern(texts, " ")
    coded = cut.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(np.asarray(cut.offsets)))
    names = coded.dictionary.cast(pa.large_string())
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:
        there = codes != empty
        codes, of = codes[there], of[there]
    return Words(codes, of, names)


def numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each distinct pair of numbers from 0; equal pairs get equal numbers, nothing is
    hashed. The numbers are dense only where they would grow too large otherwise."""
    if not len(first):
        return first.astype(np.int64)
    size = int(second.max()) + 1
    if (int(first.max()) + 1) * size < 1 << 40:
        return first.astype(np.int64) * size + second
    first, second = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (first, second))
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)
