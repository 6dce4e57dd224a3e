"""Points of differently shaped collections as results, and texts for term indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist."""
    held = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*held, F.lit(""))


def service_results(df: DataFrame) -> DataFrame:
    """T39. Points with any payload columns to type, text and title: timetables by name, day and
    time; PDFs and student bodies by their text or content; websites by title, content (2000) and the
    PDF section (500); else the chunk, led by its section's heading unless its start has it."""
    source, kind = _c(df, "source"), _c(df, "type")
    timetable = (source == "starplan_timetable") | (kind == "timetable") | ((_c(df, "day") != "") & (_c(df, "time") != ""))
    pdf = (kind == "pdf") | (source == "campus_pdfs")
    body = source.isin("asta_website", "asta")
    site = source.isin("campus_website", "campus")
    type_ = F.when(timetable, "timetable").when(pdf, "pdf").when(body, "asta").when(site, "website").otherwise("webpage")
    slot = F.concat_ws(" — ", *[F.nullif(x, F.lit("")) for x in (_c(df, "name", "title"), _c(df, "day"), _c(df, "time"))])
    extra = F.lit("")
    if "sections" in df.columns:
        own = F.try_element_at(F.filter("sections", lambda s: s.heading == "PDF-Dokumente"), F.lit(1))
        extra = F.coalesce(F.concat(F.lit(" "), F.substring(own.text, 1, 500)), F.lit(""))
    page = F.trim(F.concat(_c(df, "title"), F.lit(": "), F.substring(_c(df, "content"), 1, 2000), extra))
    raw, heading = _c(df, "text", "content"), _c(df, "section_heading")
    chunk = F.when((heading != "") & ~F.substring(raw, 1, 50).contains(heading), F.concat(heading, F.lit(": "), raw)).otherwise(raw)
    text = F.when(timetable, slot).when(pdf, raw).when(body | site, page).otherwise(chunk)
    df = df.withColumn("_text", text).withColumn("_type", type_)
    title = F.coalesce(F.nullif(_c(df, "title"), F.lit("")), F.split(F.substring("_text", 1, 60), "\n")[0])
    return df.withColumn("title", title).withColumn("text", F.col("_text")).withColumn("type", F.col("_type")).drop("_text", "_type")


def configured_text(df: DataFrame) -> Column:
    """T38. The shown text by type; timetable fields come from the metadata first."""
    field = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")) if "metadata" in df.columns else _c(df, k)
    slot = F.concat_ws(" | ", *[F.nullif(field(k), F.lit("")) for k in ("title", "day", "time", "location")])
    return F.when(F.col("type") == "timetable", F.coalesce(F.nullif(slot, F.lit("")), _c(df, "text", "content"))).otherwise(_c(df, "text", "content"))


#: What goes into the term index, by kind of source: columns and their longest parts.
INDEXED = {
    "chunks": (("title", None), ("text", 2000)),
    "pages": (("title", None), ("content", None)),
    "timetable": (("program", None), ("day", None), ("time", None), ("info", None), ("full_text", None)),
    "semester": (("title", None), ("lecturer", None), ("day", None), ("time", None), ("room", None), ("content", None)),
}


def indexed_text(df: DataFrame, kind: str) -> Column:
    parts = [F.substring(_c(df, c), 1, n) if n else _c(df, c) for c, n in INDEXED[kind]]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def student_body_record(df: DataFrame, kind: str, most: int = 1000) -> DataFrame:
    """T35."""
    return df.select("url", "title", F.substring("content", 1, most).alias("content"), F.concat_ws(" ", "title", F.substring("content", 1, most)).alias("full_text"), F.lit(kind).alias("type"))


def template_section(url: Column, text: Column) -> Column:
    """An event's text ends before the list of further events; any other page's, a person's
    included, is one text."""
    return F.when(url.contains("/veranstaltungen/"), F.trim(F.split(text, "(?i)Weitere Veranstaltungen", 2)[0])).otherwise(text)


def relevant_pdf(url: Column, words: tuple[str, ...]) -> Column:
    """T21."""
    return F.lower(url).rlike("|".join(words))


def rendered_choice(static: Column, rendered: Column, least: int = 350) -> Column:
    """The rendered text where the static one is short and the rendered one longer."""
    return F.when((F.length(static) < least) & (F.length(rendered) > F.length(static)), rendered).otherwise(static)
