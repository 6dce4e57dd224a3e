"""Collections of points as Parquet folders under one root, and the small keyed tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions.constants import HASH_BUCKETS
from ..functions.encode import Embed, encode
from ..functions.text import point_id
from ..operators.retrieve import TermIndex, counted
from ..operators.vectors import VectorIndex
from ..scratch import delete, planned_bytes


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


class Store:
    """K1-K5. A collection is a folder. Its versions are small files named by a rising number alone, each
    stating the folders that make up the version: base folders by bucket of the key, and deltas, which
    hold upserted rows and tombstones. A commit moves a finished file to the next number and fails if
    that number is there, so of two writers that read one state the second gets ``Conflict`` and no
    write is lost; readers never see half a version, and a crash leaves the old one.

    Upserts and deletes write their own rows only. Reads lay the deltas over the base, the newest row
    of a key counts; ``compact`` rewrites the buckets that deltas touch, and runs when there are
    ``MOST_DELTAS``. The version before stays for readers that have it open; older folders go."""

    MOST_DELTAS, BUCKET_BYTES, MOST_BUCKETS = 8, 128 << 20, 4096

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _pointers(self, name: str) -> list[str]:
        """Names of the versions, the current one last."""
        p, fs = self._fs(f"{self.root}/{name}/_versions")
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def names(self) -> list[str]:
        p, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self.exists(s.getPath().getName())) if fs.exists(p) else []

    def _manifest(self, name: str, number: str) -> dict:
        p, fs = self._fs(f"{self.root}/{name}/_versions/{number}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self, name: str) -> tuple[int, dict]:
        """The current version's number and manifest; what is based on it is committed with this number."""
        found = self._pointers(name)
        return (int(found[-1]), self._manifest(name, found[-1])) if found else (-1, {})

    def _commit(self, name: str, number: int, manifest: dict) -> None:
        """Write beside, then rename without overwriting."""
        jvm = self.spark.sparkContext._jvm
        beside, fs = self._fs(f"{self.root}/{name}/_versions/_{uuid.uuid4().hex}")
        stream = fs.create(beside)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        to, _ = self._fs(f"{self.root}/{name}/_versions/{number:012d}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(beside).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(beside), fs.makeQualified(to), none)
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} of {name} was written by another at the same time") from None
            raise
        self._clean(name)

    def _folders(self, manifest: dict) -> set[str]:
        return {f for f, _ in manifest["base"]} | set(manifest["deltas"])

    def _clean(self, name: str) -> None:
        """Drop what the two latest versions don't name."""
        found = self._pointers(name)
        old, last = found[:-2], found[-2:]
        if not old:
            return
        held = set().union(*(self._folders(self._manifest(name, n)) for n in last))
        for n in old:
            for path in [*(self._folders(self._manifest(name, n)) - held), f"v{int(n)}-terms", f"v{int(n)}-vectors", f"_versions/{n}"]:
                q, fs = self._fs(f"{self.root}/{name}/{path}")
                fs.delete(q, True)

    def _version(self, name: str) -> str:
        return f"v{self.state(name)[0]}"

    # reading

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.state(name)[1])

    def _read(self, name: str, manifest: dict) -> DataFrame:
        base = self._base(name, manifest["base"], manifest["schema"])
        if not manifest["deltas"]:
            return base
        keys, columns = manifest["key"], StructType.fromJson(manifest["schema"]).names
        newest = self._newest(name, manifest)
        kept = base.join(newest.select(*keys), keys, "left_anti").select(*columns)
        return kept.unionByName(newest.where("not _gone").select(*columns))

    def _base(self, name: str, base: list, schema: dict) -> DataFrame:
        """The rows of the base; columns that came later are null in older folders."""
        schema = StructType.fromJson(schema)
        paths = [f"{self.root}/{name}/{folder}/_bucket={b}" for folder, buckets in base for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, name: str, manifest: dict) -> DataFrame:
        """The last row of each key that deltas name, and whether it is a tombstone."""
        schema = StructType.fromJson(manifest["schema"]).add("_gone", BooleanType()).add("_bucket", IntegerType())
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{d}").withColumn("_seq", F.lit(i)) for i, d in enumerate(manifest["deltas"])]
        rows = reduce(DataFrame.unionByName, parts)
        last = Window.partitionBy(*manifest["key"]).orderBy(F.desc("_seq"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_seq")

    def terms(self, name: str) -> TermIndex:
        """The collection's term index, stored beside its version when first asked for."""
        path = f"{self.root}/{name}/{self._version(name)}-terms"
        p, fs = self._fs(f"{path}/frequency/_SUCCESS")
        return TermIndex.open(self.spark, path) if fs.exists(p) else TermIndex.build(self.read(name).select("id", "text"), path)

    def vectors(self, name: str, build: bool = False) -> VectorIndex | None:
        """The collection's vector index, stored beside its version: if it was built, or builds it."""
        path = f"{self.root}/{name}/{self._version(name)}-vectors"
        p, fs = self._fs(f"{path}/cells/_SUCCESS")
        if fs.exists(p):
            return VectorIndex(self.spark, path)
        return VectorIndex.build(self.read(name).where("embedding is not null").select("id", F.col("embedding").alias("vec")), path) if build else None

    def dimension(self, name: str) -> int | None:
        """V7: the length of the collection's vectors; null without any."""
        points = self.read(name)
        row = points.where("embedding is not null").select(F.size("embedding").alias("n")).first() if "embedding" in points.columns else None
        return row.n if row else None

    # writing

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int") if keys else F.lit(0)

    def _write(self, name: str, rows: DataFrame, keys: list[str], buckets: int) -> tuple[str, list[int]]:
        """Rows by bucket to a new folder; a task has one bucket, a hash would give it several."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/{name}/{folder}"
        placed = rows.withColumn("_bucket", self._bucket(keys, buckets))
        (placed.repartitionById(buckets, "_bucket") if keys else placed).write.partitionBy("_bucket").parquet(path)
        p, fs = self._fs(path)
        return folder, sorted(int(n.partition("=")[2]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("_bucket="))

    def recreate(self, name: str, points: DataFrame, dim: int | None = None, key: str | list[str] | None = None, meta: dict | None = None, base: int | None = None, least: int = 4) -> int:
        """K1, K2: replace the collection; with ``dim`` every vector must have this length. key: what
        upserts go by, ``id`` if there; base: the version that the rows were made from, the current one
        if not given; least: buckets at least, for rows whose size can't be told."""
        if dim is not None and "embedding" in points.columns:
            checked = F.when(F.col("embedding").isNull() | (F.size("embedding") == dim), F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {name} must have {dim} components")))
            points = points.withColumn("embedding", checked)
        number = self.state(name)[0] if base is None else base
        keys = [key] if isinstance(key, str) else key or (["id"] if "id" in points.columns else [])
        size = planned_bytes(points)
        buckets = min(self.MOST_BUCKETS, max(least, -(-size // self.BUCKET_BYTES) if size else 16)) if keys else 1
        folder = self._write(name, points, keys, buckets)
        self._commit(name, number + 1, {"key": keys, "buckets": buckets, "schema": _nullable(points.schema).jsonValue(), "base": [folder], "deltas": [], "meta": meta or {}})
        return self.read(name).count()

    def upsert(self, name: str, points: DataFrame, key: str | list[str] = "id", meta: dict | None = None, base: int | None = None) -> int:
        """K3: rows of ``points`` replace those of equal key; of equal keys within ``points`` the last by
        ``ord`` if there. Writes these rows only, as a delta; the first write makes the collection."""
        keys = [key] if isinstance(key, str) else key
        manifest = self.state(name)[1]
        if not manifest:
            return self.recreate(name, last_rows(points, keys), key=keys, meta=meta, base=base)
        if keys != manifest["key"]:
            raise ValueError(f"{name} is kept by {manifest['key']}, not {keys}")
        return self._delta(name, manifest, last_rows(points, keys).withColumn("_gone", F.lit(False)), meta, base)

    def delete(self, name: str, keys: DataFrame) -> int:
        """Tombstones for the keys."""
        manifest = self.state(name)[1]
        rows = keys.select(*manifest["key"]).distinct()
        for field in StructType.fromJson(manifest["schema"]):
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        return self._delta(name, manifest, rows.withColumn("_gone", F.lit(True)), None, None)

    def _delta(self, name: str, manifest: dict, rows: DataFrame, meta: dict | None, base: int | None) -> int:
        """Write rows and commit them on top of ``base``; without it on top of whatever is current by
        then, since a delta doesn't depend on the rows below it."""
        keys, buckets = manifest["key"], manifest["buckets"]
        folder, _ = self._write(name, rows, keys, buckets)
        for attempt in range(10):
            number, manifest = self.state(name)
            if (manifest["key"], manifest["buckets"]) != (keys, buckets):
                raise Conflict(f"{name} was made anew by another at the same time")
            schema = StructType.fromJson(manifest["schema"])
            for field in _nullable(rows.schema):
                if field.name not in schema.names and field.name != "_gone":
                    schema = schema.add(field)
            made = manifest | {"schema": schema.jsonValue(), "deltas": [*manifest["deltas"], folder], "meta": manifest["meta"] | (meta or {})}
            try:
                self._commit(name, (number if base is None else base) + 1, made)
                break
            except Conflict:
                if base is not None or attempt == 9:
                    delete(self.spark, f"{self.root}/{name}/{folder}")
                    raise
        if len(made["deltas"]) >= self.MOST_DELTAS:
            try:
                self.compact(name)
            except Conflict:
                pass  # another writer is further; the next upsert compacts
        return self.read(name).count()

    def compact(self, name: str) -> list[int]:
        """Rewrite the buckets that deltas touch; the others' folders stay as they are. Returns them."""
        number, manifest = self.state(name)
        if not manifest.get("deltas"):
            return []
        touched = set()
        for d in manifest["deltas"]:
            p, fs = self._fs(f"{self.root}/{name}/{d}")
            touched |= {int(n.partition("=")[2]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("_bucket=")}
        old = [[f, [b for b in buckets if b in touched]] for f, buckets in manifest["base"]]
        rows = self._read(name, manifest | {"base": old})
        folder, made = self._write(name, rows, manifest["key"], manifest["buckets"])
        rest = [[f, left] for f, buckets in manifest["base"] if (left := [b for b in buckets if b not in touched])]
        self._commit(name, number + 1, manifest | {"base": [*rest, [folder, made]], "deltas": []})
        return sorted(touched)

    def drop(self, name: str) -> None:
        p, fs = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def info(self) -> DataFrame:
        """Points of each collection and, with null name, of all."""
        counts = [self.read(n).agg(F.count(F.lit(1)).alias("points")).withColumn("collection", F.lit(n)) for n in self.names()]
        out = self.spark.createDataFrame([], "points long, collection string")
        for c in counts:
            out = out.unionByName(c)
        return out.rollup("collection").agg(F.sum("points").alias("points"))

    def migrate(self, old: str, new: str) -> int:
        """Copy with hashed sparse vectors made anew."""
        # the size of a join can't be told; the vectors at most double the rows
        return self.recreate(new, with_hashed_sparse(self.read(old)), least=2 * self.state(old)[1].get("buckets", 2))


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


def last_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of equal keys the last row by ``ord`` if there."""
    order = "ord" if "ord" in points.columns else keys[0]
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """K3 without a store: of equal keys the newer row."""
    last = last_rows(new, [key])
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def scroll(points: DataFrame, equal: dict[str, object], contains: dict[str, str], limit: int = 10) -> DataFrame:
    """K5: exact matches and contained texts, pushed to the scan."""
    for c, v in equal.items():
        points = points.where(F.col(c) == v)
    for c, v in contains.items():
        points = points.where(F.col(c).contains(v))
    return points.orderBy(points.columns[0]).limit(limit)


def coalesced(df: DataFrame, source: str, embed: Embed | None = None) -> DataFrame:
    """One shape from records that name their fields differently. With ``embed``, records without
    a vector of their own get that of their title and content, as do all where there is none."""
    def first(*names: str) -> Column:
        held = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*held, F.lit(None).cast("string"))

    title, content, url = F.coalesce(first("title", "modul", "lecture_info"), F.lit("Unbenannt")), F.coalesce(first("content", "text", "full_text", "description"), F.lit("")), F.coalesce(first("url"), F.lit(""))
    key = F.concat_ws("|", F.lit(source), url, title, content)
    own = [F.col("embedding").cast("array<float>").alias("embedding")] if "embedding" in df.columns else [F.lit(None).cast("array<float>").alias("embedding")] if embed else []
    out = df.select(point_id(key).alias("id"), title.alias("title"), content.alias("content"), url.alias("url"), F.lit(source).alias("source"), *own)
    return backfilled(out, embed) if embed else out


def backfilled(points: DataFrame, embed: Embed, least: int = 1) -> DataFrame:
    """Rows whose embedding is null or empty get one from title and content; the others never reach
    the encoder."""
    missing = F.col("embedding").isNull() | (F.size("embedding") < least)
    made = points.where(missing).withColumn("embedding", encode(F.concat_ws(" ", "title", "content"), embed).cast("array<float>"))
    return points.where(~missing).unionByName(made)


def _bucket(term: str) -> int:
    return int.from_bytes(hashlib.md5(term.encode()).digest(), "big") % HASH_BUCKETS


def hashed_terms(points: DataFrame, key: str = "id", text: str = "text", unique: bool = False) -> DataFrame:
    """V4: (key, index, value), the token counts of each row by md5 bucket. A task hashes the distinct terms of
    some hundred texts at once, and nothing is shuffled."""
    held = counted(points.select(F.col(key).alias("id"), F.col(text).alias("text")), (), _bucket, unique)
    return held.select(F.col("id").alias(key), F.inline("postings")).select(key, F.col("term").alias("index"), F.col("tf").cast("long").alias("value"))


def with_hashed_sparse(points: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Rows, by unique ``key``, with sparse_indices in order and sparse_values; empty without tokens."""
    pairs = hashed_terms(points, key, text, unique=True).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("_s"))
    rows = points.join(pairs, key, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<index:bigint,value:bigint>>")))
    rows = rows.withColumn("sparse_indices", F.transform("_s", lambda x: x.index)).withColumn("sparse_values", F.transform("_s", lambda x: x.value.cast("float")))
    return rows.select(*points.columns, "sparse_indices", "sparse_values")


def seed(spark: SparkSession, rows: list[tuple[str, str, str]], offset: int = 5000) -> DataFrame:
    """Hand-written rows (url, title, text) with ids from ``offset``."""
    return spark.createDataFrame([(offset + i, *r) for i, r in enumerate(rows)], "id long, url string, title string, text string")


def append_feedback(spark: SparkSession, path: str, project: str, query: str, summary: str, rating: int, model: str) -> None:
    """K7: one JSON line, with the time in ISO form."""
    from datetime import datetime

    row = [(datetime.now().isoformat(), project, query, summary, rating, model)]
    spark.createDataFrame(row, "timestamp string, project string, query string, summary string, rating int, model string").coalesce(1).write.mode("append").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """K6: UTF-8 JSON lines."""
    df.write.mode("overwrite").json(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """K8: one JSON folder for each section of a report."""
    for name, df in sections.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
