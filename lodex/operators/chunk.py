"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splitters import recursive, splitter, windows
from ..functions.text import context_header, held, point_id, stride_chunks

CHUNK = "url string, text string, title string, h1 string, section_heading string, section_index int, chunk_index int, type string, metadata map<string,string>"


def stride(size: int, overlap: int) -> Callable[[Column], Column]:
    return lambda text: stride_chunks(text, size, overlap)


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 120, split: Callable[[int, int], Callable[[Column], Column]] = lambda s, o: splitter(recursive, s, o)) -> DataFrame:
    """T29. docs (url, title, h1, content, sections, type, metadata) to CHUNK rows: a timetable is
    one chunk as it stands; else each section is split; without sections the content, at larger
    size; every piece but a timetable's starts with its context header."""
    base = docs.select("url", "title", "h1", F.coalesce("content", F.lit("")).alias("content"), F.filter(F.coalesce("sections", F.array()), lambda s: F.trim(F.coalesce(s.text, F.lit(""))) != "").alias("sections"), "type", "metadata")
    whole = F.coalesce(F.col("type"), F.lit("")) == "timetable"
    keep = ["url", "title", "h1", "type", "metadata"]
    timetable = base.where(whole & (F.trim("content") != "")).select(*keep, F.lit("Allgemein").alias("section_heading"), F.lit(0).alias("section_index"), F.lit(0).alias("chunk_index"), F.col("content").alias("text"))

    def pieces(rows: DataFrame, s: int, o: int) -> DataFrame:
        cut = rows.select(*keep, "section_heading", "section_index", F.posexplode(split(s, o)(F.col("body"))).alias("chunk_index", "piece"))
        text = F.concat_ws("\n\n", F.nullif(context_header(F.col("title"), F.col("h1"), F.col("section_heading")), F.lit("")), "piece")
        return cut.where(F.trim("piece") != "").select(*keep, "section_heading", "section_index", "chunk_index", text.alias("text"))

    sectioned = base.where(~whole & (F.size("sections") > 0)).select(*keep, F.posexplode("sections").alias("section_index", "s")).select(*keep, F.coalesce("s.heading", F.lit("Allgemein")).alias("section_heading"), "section_index", F.trim("s.text").alias("body"))
    plain = base.where(~whole & (F.size("sections") == 0) & (F.trim("content") != "")).select(*keep, F.lit("Allgemein").alias("section_heading"), F.lit(0).alias("section_index"), F.trim("content").alias("body"))
    out = timetable.unionByName(pieces(sectioned, size, overlap)).unionByName(pieces(plain, size + 100, overlap + 30))
    return out.select("url", "text", "title", "h1", "section_heading", "section_index", "chunk_index", "type", "metadata")


def window_chunks(pages: DataFrame, size: int = 1200, overlap: int = 150, least: int = 200) -> DataFrame:
    """T45. pages (url, title, text): window chunks of texts of ``least`` characters or more, with
    their place in the title when there are several, and the host's first label as source."""
    cut = pages.where(F.length(F.trim("text")) >= least).select("url", "title", splitter(windows, size, overlap)(F.col("text")).alias("parts"))
    host = F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")), r"^www\.", "")
    rows = cut.select("url", "title", F.size("parts").alias("chunk_total"), host.alias("host"), F.posexplode("parts").alias("chunk_index", "text"))
    name = F.when(F.col("chunk_total") > 1, F.concat("title", F.lit(" (Part "), (F.col("chunk_index") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.select("url", name.alias("title"), "text", "chunk_index", "chunk_total", F.substring_index("host", ".", 1).alias("source"), point_id(F.concat_ws("_", "url", F.col("chunk_index").cast("string"))).alias("id"))


def page_chunks(pages: DataFrame, split: Callable[[Column], Column], excerpt: int = 1200) -> DataFrame:
    """T30, T23. pages (url, title, content, pdfs array<struct<url,filename,text>>): content chunks,
    the first one enriched by the PDFs' excerpts, and one child row for each PDF."""
    extra = F.array_join(F.transform("pdfs", lambda p: F.concat(F.lit("[PDF: "), p.filename, F.lit("] "), F.substring(p.text, 1, excerpt))), "\n")
    # the excerpts and the pieces are made once, and only the first piece takes the excerpts along
    cut = held(pages.select("url", "title", F.when(F.size("pdfs") > 0, extra).alias("extra"), split(F.col("content")).alias("pieces")), parts=F.col("pieces"))
    cut = cut.select("url", "title", F.size("parts").alias("chunk_total"), F.posexplode(F.transform("parts", lambda p, i: F.when((i == 0) & F.col("extra").isNotNull(), F.concat_ws("\n", p, "extra")).otherwise(p))).alias("chunk_index", "text"))
    own = cut.select("url", "title", "text", "chunk_index", "chunk_total", F.lit(None).cast("string").alias("parent_url"), F.lit("website").alias("type"))
    child = pages.select(F.col("url").alias("parent_url"), F.explode("pdfs").alias("p")).select(F.col("p.url").alias("url"), F.col("p.filename").alias("title"), F.substring("p.text", 1, excerpt).alias("text"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_total"), "parent_url", F.lit("pdf").alias("type"))
    return own.unionByName(child)


def with_pdfs(pages: DataFrame, pdfs: DataFrame, excerpt: int = 400, most: int = 8) -> DataFrame:
    """T21, T22. pages (url, content, sections) with the PDFs (page_url, url, filename, text) that
    they link: text appended, a section PDF-Dokumente, pdf_count and pdf_sources (at most ``most``)."""
    one = F.concat(F.lit("[PDF: "), F.col("filename"), F.lit("] "), F.substring("text", 1, excerpt))
    of = pdfs.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_list(F.struct(F.col("url").alias("pdf_url"), "filename", one.alias("part")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x.part), "\n")
    joined = pages.join(of, "url", "left")
    has = F.col("p").isNotNull()
    return joined.select(
        "url",
        F.when(has, F.concat_ws("\n", "content", text)).otherwise(F.col("content")).alias("content"),
        F.when(has, F.concat("sections", F.array(F.struct(F.lit("PDF-Dokumente").alias("heading"), text.alias("text"))))).otherwise(F.col("sections")).alias("sections"),
        F.coalesce(F.size("p"), F.lit(0)).alias("pdf_count"),
        F.coalesce(F.slice(F.transform("p", lambda x: F.struct(x.pdf_url.alias("url"), x.filename.alias("filename"))), 1, most), F.array().cast("array<struct<url:string,filename:string>>")).alias("pdf_sources"),
    )


def pdf_snippet(section: Column, name: Column, most: int = 1200) -> Column:
    """One PDF's part of a combined section, of either marker."""
    parts = F.split(section, r"\n?\s*(?=\[(?:PDF|Dokument): )")
    own = F.filter(parts, lambda p: p.startswith(F.concat(F.lit("[PDF: "), name, F.lit("]"))) | p.startswith(F.concat(F.lit("[Dokument: "), name, F.lit("]"))))
    return F.substring(F.trim(F.regexp_replace(F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("")), r"^\[[^\]]*\]\s*", "")), 1, most)
