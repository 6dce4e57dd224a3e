"""Inputs: files, folders, URL lists, calendars, JSON lines, and the loader table."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom
from ..operators import timetable
from ..operators.serve import fetched

DOCUMENT = "url string, title string, h1 string, content string, sections array<struct<heading:string,text:string>>, type string, metadata map<string,string>"
PAGE = "url string, html string"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Blank lines are skipped, malformed ones too unless ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S17."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _documents(rows: DataFrame, kind: str) -> DataFrame:
    """rows (url, r) with r a page record."""
    meta = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("url", F.col("r.title").alias("title"), F.col("r.h1").alias("h1"), F.col("r.content").alias("content"), F.col("r.sections").alias("sections"), F.lit(kind).alias("type"), meta.alias("metadata"))


def pages_to_documents(pages: DataFrame, kind: str = "webpage", least: int = 50) -> DataFrame:
    """S1's extraction: stored pages (url, html) of at least ``least`` characters of content."""
    rows = pages.select("url", dom.page_record(F.col("html")).alias("r"))
    return _documents(rows, kind).where(F.length("content") >= least)


def url_list(spark: SparkSession, urls: list[str], pages: DataFrame, kind: str = "webpage") -> DataFrame:
    """The listed URLs that have a stored page, in one row each."""
    wanted = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string")
    return pages_to_documents(pages.join(F.broadcast(wanted) if len(urls) <= 100_000 else wanted, "url", "left_semi"), kind)


#: Reads a file's bytes; null or an error if it can't.
Extractor = Callable[[bytes], str | None]


def cascade(extractors: list[Extractor], least: int = 100) -> Extractor:
    """The text of the first extractor that gives more than ``least`` characters, else the longest."""

    def run(data: bytes) -> str | None:
        best = None
        for extract in extractors:
            try:
                text = (extract(data) or "").strip()
            except Exception:  # a file that one library can't read goes to the next
                continue
            if len(text) > least:
                return text
            best = max(best or "", text, key=len)
        return best

    return run


def binary_texts(spark: SparkSession, path: str, extractors: dict[str, Extractor]) -> DataFrame:
    """(url, content) of the files below ``path`` whose ending has an extractor; null content
    where it fails. One file at a time is in a worker's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extractors) + "}").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [cascade([extractors[url.rsplit(".", 1)[-1]]], 0)(data) for url, data in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"url": batch["path"], "content": texts})

    return files.select("path", "content").mapInPandas(run, "url string, content string")


def folder(spark: SparkSession, path: str, least: int = 50, pattern: str = "*.{txt,md}", extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Text files below ``path``, and files whose ending has an extractor, with more than
    ``least`` characters; the title is the file's name with _ and - as spaces."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("content"))
    if extractors:
        rows = rows.unionByName(binary_texts(spark, path, extractors))
    rows = rows.select("url", F.trim("content").alias("content")).where(F.length("content") > least)
    name = F.regexp_replace(F.regexp_extract("url", r"([^/]+)$", 1), r"\.[^.]*$", "")
    title = F.trim(F.regexp_replace(F.url_decode(name), "[_-]", " "))
    section = F.array(F.struct(F.lit("Allgemein").alias("heading"), F.col("content").alias("text")))
    meta = F.create_map(F.lit("file"), name)
    return rows.select("url", title.alias("title"), title.alias("h1"), "content", section.alias("sections"), F.lit("document").alias("type"), meta.alias("metadata"))


def calendars(ical: DataFrame, base_url: str = "") -> DataFrame:
    """iCal texts (program, pg_id, ical) to timetable documents."""
    rows = timetable.parse_ical(ical)
    url = F.concat(F.lit(f"{base_url}/ical?lan=de&puid=50&type=pg&pgid="), F.col("pg_id").cast("string"))
    meta = F.create_map(*[x for k in ("program", "title", "day", "time", "location") for x in (F.lit(k), F.col(k))])
    none = F.array().cast("array<struct<heading:string,text:string>>")
    return rows.select(url.alias("url"), F.col("title"), F.col("title").alias("h1"), F.col("full_text").alias("content"), none.alias("sections"), F.lit("timetable").alias("type"), meta.alias("metadata"))


def planning_groups(api: DataFrame) -> DataFrame:
    """API answers (org, json) with nested planning groups to (org, pg_id, name)."""
    parsed = F.from_json("json", "array<array<struct<id:int,shortname:string>>>")
    return api.select("org", F.explode(F.flatten(parsed)).alias("g")).select("org", F.col("g.id").alias("pg_id"), F.col("g.shortname").alias("name")).where("pg_id is not null")


def timetable_source(spark: SparkSession, get: Callable[[str], str], base_url: str, unit: int = 50, tries: int = 3) -> DataFrame:
    """The timetable documents of a planning service. ``get`` asks for a URL; the groups, few,
    are asked for on the driver and the calendars in tasks, one request for each planning group."""
    base = base_url.rstrip("/")

    def ask(query: str) -> str | None:
        return fetched(get, f"{base}/{query}", tries)

    organisations = json.loads(ask(f"json?m=getogs&pu={unit}") or "[]")
    answers = [(str(o["id"]), ask(f"json?m=getPgsExt&pu={unit}&og={o['id']}")) for o in organisations if isinstance(o, dict)]
    groups = planning_groups(spark.createDataFrame(answers, "org string, json string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [fetched(get, f"{base}/ical?lan=de&puid={unit}&type=pg&pgid={g}", tries) for g in batch["pg_id"]]
            yield pd.DataFrame({"program": batch["name"], "pg_id": batch["pg_id"], "ical": texts})

    asked = groups.dropDuplicates(["pg_id"]).repartition("pg_id").mapInPandas(run, "program string, pg_id int, ical string")
    return calendars(asked.where("ical is not null"), base)


@dataclass
class Source:
    name: str
    type: str
    collection: str
    result_type: str = "webpage"
    search_weight: float = 0.0
    chunk_size: int | None = None
    chunk_overlap: int | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Config:
    """A project's settings."""

    name: str
    sources: list[Source]
    relevance_min_score: float = 0.34
    program_synonyms: dict[str, list[str]] = field(default_factory=dict)
    module_synonyms: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f))

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Config:
        known = {"name", "type", "collection", "result_type", "search_weight", "chunk_size", "chunk_overlap"}
        sources = [Source(**{k: v for k, v in s.items() if k in known}, options={k: v for k, v in s.items() if k not in known}) for s in raw.get("sources", [])]
        search = raw.get("search", {})
        return cls(raw.get("name") or raw.get("project", {}).get("name", "project"), sources, search.get("relevance_min_score", 0.34), search.get("program_synonyms", {}), search.get("module_synonyms", {}))


def _website(spark: SparkSession, s: Source) -> DataFrame:
    pages = spark.read.parquet(s.options["pages"]) if "pages" in s.options else json_lines(spark, s.options["pages_jsonl"], PAGE)
    return pages_to_documents(pages.select("url", "html"), s.result_type)


def _starplan(spark: SparkSession, s: Source) -> DataFrame:
    return calendars(json_lines(spark, s.options["calendars"], "program string, pg_id int, ical string"), s.options.get("base_url", ""))


def _urls(spark: SparkSession, s: Source) -> DataFrame:
    return url_list(spark, s.options["urls"], spark.read.parquet(s.options["pages"]), s.result_type)


#: S22.
LOADERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {"website": _website, "starplan": _starplan, "folder": lambda spark, s: folder(spark, os.fspath(s.options["path"])), "urls": _urls}


def load(spark: SparkSession, source: Source) -> DataFrame:
    if source.type not in LOADERS:
        raise ValueError(f"unknown source type {source.type!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[source.type](spark, source)
