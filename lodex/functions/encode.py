"""Dense encoders. Models are plugged in as functions of a batch of texts; the default hashes tokens
into a unit vector, the same on every run."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(dim: int = 768) -> Embed:
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w{2,}", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return run


def prefixed(model: str, kind: str) -> str:
    """V1, V2: models of the e5 family want the kind of text named."""
    return f"{kind}: " if "e5" in model.lower() else ""


def encode(text: Column, embed: Embed, model: str = "", kind: str = "passage", batch: int = 64) -> Column:
    """V1: passages in batches; the function is set up once for each task."""
    prefix = prefixed(model, kind)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        held = [prefix + (t or "") for t in texts]
        return pd.Series([v for i in range(0, len(held), batch) for v in embed(held[i : i + batch])])

    return run(text)


def encode_query(query: str, embed: Embed, model: str = "") -> list[float]:
    """V2: on the driver."""
    return [float(x) for x in embed([prefixed(model, "query") + query])[0]]
