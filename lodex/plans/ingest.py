"""Sources to collections: load, chunk, encode, store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.encode import Embed, encode, hashed_embedding
from ..functions.text import point_id
from ..operators.chunk import chunk_documents
from ..sources.readers import Config, load
from ..sources.store import Store, with_hashed_sparse


class Pipeline:
    def __init__(self, spark: SparkSession, store: Store, config: Config, embed: Embed | None = None, dim: int = 768):
        self.spark, self.store, self.config, self.dim = spark, store, config, dim
        self.embed = embed or hashed_embedding(dim)

    def run(self, names: list[str] | None = None) -> dict[str, int]:
        """Points written by source, of all sources or the named ones."""
        done: dict[str, int] = {}
        for s in self.config.sources:
            if names and s.name not in names:
                continue
            size, overlap = s.chunk_size or 800, s.chunk_overlap if s.chunk_overlap is not None else 120
            docs = load(self.spark, s)
            chunks = chunk_documents(docs, size, overlap)
            key = F.concat_ws("|", "url", F.col("section_index").cast("string"), F.col("chunk_index").cast("string"), F.md5("text"))
            points = chunks.withColumn("id", point_id(key)).dropDuplicates(["id"]).withColumn("type", F.lit(s.result_type)).withColumn("source", F.lit(s.name)).withColumn("embedding", encode(F.col("text"), self.embed))
            done[s.name] = self.store.recreate(s.collection, with_hashed_sparse(points), self.dim)
        return done
