"""Loop-carried text splitters, as Arrow-batched functions that give arrays of pieces, or as table
functions that give one piece at a time."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Iterator[str]:
    """Split at the coarsest separator that occurs, pieces still too long at finer ones; join
    neighbours up to ``size``, each piece starting with at most ``overlap`` of the one before."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    run: deque[str] = deque()
    length = 0
    for part in text.split(sep) if sep else text:
        if not part:
            continue
        if len(part) > size and finer:
            if joined := sep.join(run).strip():
                yield joined
            run.clear()
            length = 0
            yield from recursive(part, size, overlap, finer)
            continue
        extra = len(part) + (len(sep) if run else 0)
        if run and length + extra > size:
            if joined := sep.join(run).strip():
                yield joined
            while run and (length > overlap or length + len(part) + len(sep) > size):
                length -= len(run[0]) + (len(sep) if len(run) > 1 else 0)
                run.popleft()
            extra = len(part) + (len(sep) if run else 0)
        run.append(part)
        length += extra
    if joined := sep.join(run).strip():
        yield joined


def windows(text: str, size: int = 1500, overlap: int = 200) -> Iterator[str]:
    """Windows that end at the last space of their second half. Each starts after the one
    before it, however large the overlap."""
    text = re.sub(r"\s+", " ", text).strip()
    if len(text) <= size:
        if text:
            yield text
        return
    at = 0
    while at < len(text) and (at == 0 or at < len(text) - overlap):
        stop = at + size
        space = text.rfind(" ", at, stop) if stop < len(text) else -1
        stop = space if space > at + size // 2 else stop
        yield text[at:stop].strip()
        at = max(at + 1, stop - overlap)


SENTENCE_ENDS = (". ", "! ", "? ", "\n", " ")


def sentences(text: str, size: int = 800, overlap: int = 150) -> Iterator[str]:
    """Windows that end after the first kind of separator found in their second half. Each
    starts after the one before it, however large the overlap."""
    if len(text) <= size:
        if text.strip():
            yield text
        return
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            ends = ((text.rfind(s, at + size // 2, stop), s) for s in SENTENCE_ENDS)
            stop = next((p + len(s) for p, s in ends if p > 0), stop)
        if piece := text[at:stop].strip():
            yield piece
        at = max(at + 1, stop - overlap)


Split = Callable[..., Iterator[str]]
#: Rows of which a task holds the results at once; Arrow's batches have ten thousand, however long their texts.
SLICE = 64


def by_slices(batches: Iterator[pd.Series], one: Callable[[pd.Series], pd.Series | pd.DataFrame]) -> Iterator[pd.Series | pd.DataFrame]:
    for batch in batches:
        for at in range(0, max(1, len(batch)), SLICE):
            yield one(batch.iloc[at : at + SLICE])


def splitter(split: Split, size: int, overlap: int) -> Callable[[Column], Column]:
    """The splitter as a Column function; null gives an empty array."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from by_slices(batches, lambda texts: texts.map(lambda t: list(split(t, size, overlap)) if t else []))

    return run


def with_pieces(rows: DataFrame, text: str, split: Split, size: int, overlap: int) -> DataFrame:
    """``rows`` beside the pieces of their ``text``, as chunk_index and piece: a table function called
    for each row, which gives out one piece at a time and never holds them all. Rows without pieces go."""

    @F.udtf(returnType="chunk_index long, piece string")
    class Pieces:
        def eval(self, text: str):
            yield from enumerate(split(text, size, overlap) if text else ())

    return rows.lateralJoin(Pieces(F.col(text).outer()))
