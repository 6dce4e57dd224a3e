"""Calendars and timetables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ROOM_CODES, WEEKDAYS
from ..functions.text import contains_any


def event_value(event: Column, key: str) -> Column:
    """The value of ``KEY;PARAMS:value``, empty if there is none."""
    return F.trim(F.regexp_extract(event, rf"(?m)^{key}(?:;[^:\r\n]*)?:([^\r\n]*)", 1))


def stamp(value: Column) -> Column:
    """YYYYMMDDThhmmss as a timestamp without zone."""
    return F.try_to_timestamp(F.substring(value, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))


def weekday(ts: Column) -> Column:
    """T36."""
    names = [WEEKDAYS[k] for k in ("SU", "MO", "TU", "WE", "TH", "FR", "SA")]
    return F.element_at(F.array(*map(F.lit, names)), F.dayofweek(ts))


def parse_ical(calendars: DataFrame, drop_untitled: bool = False) -> DataFrame:
    """S11-S13, T31, T36. calendars (program, pg_id, ical) to one row for each event in order, with
    day, time and the searchable text."""
    parts = F.split(F.regexp_replace("ical", r"\r?\n[ \t]", ""), "BEGIN:VEVENT")
    body = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda e: F.split(e, "END:VEVENT")[0])
    rows = calendars.select("program", "pg_id", F.posexplode(body).alias("n", "e"))
    for name, key in (("title", "SUMMARY"), ("location", "LOCATION"), ("description", "DESCRIPTION"), ("_start", "DTSTART"), ("_end", "DTEND"), ("_organizer", "ORGANIZER")):
        rows = rows.withColumn(name, event_value(F.col("e"), key))
    rows = rows.withColumn("start", stamp(F.col("_start"))).withColumn("end", stamp(F.col("_end"))).withColumn("instructor", F.regexp_replace("_organizer", r"^CN=|mailto:", ""))
    begins, ends = F.date_format("start", "HH:mm"), F.date_format("end", "HH:mm")
    rows = rows.withColumn("day", F.coalesce(weekday(F.col("start")), F.lit(""))).withColumn("time", F.coalesce(F.when(ends.isNotNull(), F.concat_ws(" - ", begins, ends)).otherwise(begins), F.lit("")))
    text = F.concat(F.lit("Studiengang: "), "program", F.lit(" | Tag: "), "day", F.lit(" | Zeit: "), "time", F.lit(" | Raum: "), "location", F.lit(" | Veranstaltung: "), "title", F.when(F.col("description") != "", F.concat(F.lit(" | "), F.substring("description", 1, 200))).otherwise(""))
    out = rows.select("program", "pg_id", "n", "title", "start", "end", "day", "time", "location", "instructor", "description", text.alias("full_text"))
    return out.where("title <> ''") if drop_untitled else out


def carry_forward(lines: DataFrame) -> DataFrame:
    """S15. lines (page, pos, line): each other line with the day and time lines above it."""
    is_day = F.col("line").isin(*list(WEEKDAYS.values()))
    time = F.regexp_extract("line", r"^(\d{1,2}:\d{2}(?: - \d{1,2}:\d{2})?)$", 1)
    above = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("day", F.last(F.when(is_day, F.col("line")), ignorenulls=True).over(above)).withColumn("time", F.last(F.nullif(time, F.lit("")), ignorenulls=True).over(above))
    return rows.where(~is_day & (time == "") & (F.trim("line") != "") & F.col("day").isNotNull())


def prefer_rows(rows: Column, text_rows: Column, least: int = 4) -> Column:
    """Table rows if there are any, else the text's lines of ``least`` characters or more."""
    return F.when(F.size(rows) > 0, rows).otherwise(F.filter(text_rows, lambda x: F.length(x) >= least))


DAYS = tuple(v for k, v in WEEKDAYS.items() if k not in ("SA", "SU"))


def slots(fragments: DataFrame) -> DataFrame:
    """T32. fragments (program_id, program, day, time, pos, info): useful fragments of each slot, in
    order; slots without day or time and small ones at 17:00 are dropped."""
    info, day, time = F.trim(F.coalesce("info", F.lit(""))), F.trim(F.coalesce("day", F.lit(""))), F.trim(F.coalesce("time", F.lit("")))
    rows = fragments.select("program_id", "program", day.alias("day"), time.alias("time"), "pos", info.alias("info"))
    rows = rows.where((F.length("info") > 5) & ~F.col("info").isin(*DAYS) & ~F.col("info").startswith("Powered by") & ~F.col("info").startswith("Letzte Änderung"))
    held = rows.groupBy("program_id", "program", "day", "time").agg(F.array_sort(F.collect_list(F.struct("pos", "info"))).alias("f"))
    held = held.select("program_id", "program", "day", "time", F.transform("f", lambda x: x.info).alias("fragments"))
    return held.where((F.col("day") != "") & (F.col("time") != "") & ~((F.col("time") == "17:00") & (F.size("fragments") <= 2)))


def fragment_kind(f: Column) -> Column:
    """Lecturer, group, room, name or other, by the first rule that holds."""
    lecturer = contains_any(f, (".", ",")) & (F.size(F.split(f, " ")) >= 2) & F.forall(F.split(f, ","), lambda p: F.length(F.trim(p)) < 30) & F.substring(f, 1, 3).rlike(r"\p{Lu}")
    group = f.rlike(r"S[1-9]$") | f.contains("S1+") | f.contains("S1_")
    room = F.split(f, " ")[0].isin(*ROOM_CODES) | ((F.length(f) <= 20) & F.substring(f, 1, 4).rlike(r"\d"))
    return F.when(lecturer, "lecturer").when(group, "group").when(room, "room").when(f.contains("(") & f.contains("-"), "name").otherwise("other")


def lectures(slots_: DataFrame) -> DataFrame:
    """Slots to lectures. The last fragment of a kind counts; a name may be the first other
    fragment of over ten characters that no name fragment precedes."""
    kinds = F.transform("fragments", lambda f: F.struct(fragment_kind(f).alias("kind"), f.alias("f")))
    rows = slots_.withColumn("k", kinds)
    last = lambda kind: F.coalesce(F.try_element_at(F.filter("k", lambda x: x.kind == kind), F.lit(-1)).f, F.lit(""))
    other = F.coalesce(F.try_element_at(F.filter("k", lambda x: (x.kind == "other") & (F.length(x.f) > 10)), F.lit(1)).f, F.lit(""))
    rows = rows.select("program", "program_id", F.coalesce(F.nullif(last("name"), F.lit("")), other).alias("name"), "day", "time", last("room").alias("room"), last("lecturer").alias("lecturer"), last("group").alias("group"))
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    text = F.concat_ws(" | ", *[part(label, c) for label, c in (("Studiengang", "program"), ("Vorlesung", "name"), ("Tag", "day"), ("Zeit", "time"), ("Raum", "room"), ("Dozent", "lecturer"), ("Gruppe", "group"))])
    return rows.where("name <> ''").withColumn("full_text", text).withColumn("type", F.lit("timetable"))


def semester_text(df: DataFrame) -> DataFrame:
    """The non-blank fields joined by spaces, ids sem_0, sem_1, ... in the order of ``ord``."""
    fields = ("name", "lecturer", "day", "time", "room")
    text = F.trim(F.concat_ws(" ", *[F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in fields]))
    rows = df.withColumn("content", text).where("content <> ''")
    return rows.withColumn("id", F.concat(F.lit("sem_"), (F.row_number().over(Window.partitionBy("semester").orderBy("ord")) - 1).cast("string")))


def programs(html: Column) -> Column:
    """Value and label of each option of the select named og."""
    inner = F.regexp_extract(html, r'(?is)<select[^>]*name="og"[^>]*>(.*?)</select>', 1)
    options = F.regexp_extract_all(inner, F.lit(r'(?is)(<option[^>]*value="[^"]*"[^>]*>[^<]*)'), 1)
    pairs = F.transform(options, lambda o: F.struct(F.regexp_extract(o, r'value="([^"]*)"', 1).alias("id"), F.trim(F.regexp_extract(o, r">([^<]*)$", 1)).alias("name")))
    return F.filter(pairs, lambda p: (p["id"] != "") & (p["name"] != ""))


def with_fallback(rows: DataFrame, wanted: str, default: str, column: str = "semester") -> DataFrame:
    """The wanted partition, or the default one where the wanted one is empty."""
    own = rows.where(F.col(column) == wanted)
    other = rows.where(F.col(column) == default).join(own.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti")
    return own.unionByName(other)
