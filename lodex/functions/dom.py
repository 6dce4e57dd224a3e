"""HTML to records. Titles, headings and links are regular expressions in code generation; sections
need a document tree, which a standard-library parser builds in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import BINARY_EXTENSIONS
from .splitters import by_slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements without content, and class words of page furniture.
DROPPED = frozenset("nav footer script style noscript aside header form".split())
NOISE_CLASS = re.compile(r"(cookie|breadcrumb|share|social|search|menu|sidebar)", re.I)


def plain(html: Column) -> Column:
    """Text of a fragment without nested markup decoding: tags to spaces, common references."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def h1(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def simple_record(html: Column, most: int = 3000, least: int = 100) -> Column:
    """Title (h1, else title) and the body's text cut to ``most`` characters; null if shorter
    than ``least``."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|noscript)\b.*?</\1>", " ")
    text = plain(F.regexp_replace(body, r"(?is)<head\b.*?</head>", " "))
    return F.when(F.length(text) >= least, F.struct(F.coalesce(F.nullif(h1(html), F.lit("")), title(html)).alias("title"), F.substring(text, 1, most).alias("text")))


def probes(html: Column) -> Column:
    """Times, weekdays and option labels of a page, each once, in order of appearance."""
    days = "Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag"
    times = F.array_distinct(F.regexp_extract_all(html, F.lit(r"\b\d{1,2}:\d{2}\b"), 0))
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(rf"\b(?:{days})\b"), 0))
    options = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?is)<option[^>]*>\s*([^<]*?)\s*</option>"), 1))
    return F.struct(times.alias("times"), found.alias("days"), options.alias("options"))


def paragraphs(html: Column) -> Column:
    """Closed paragraphs' texts, in order, empty ones dropped."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p>([^<]*)</p>"), 1)
    return F.filter(F.transform(found, plain), lambda p: p != "")


def raw_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)


def absolute(base: Column, link: Column) -> Column:
    """Links made absolute; others than pages of the same host are null; no query or fragment.
    Root-relative and absolute links, the usual ones, stay in code generation."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace(link, r"[?#].*$", "")
    full = F.when(bare.rlike("^https?://"), bare).when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), bare)).when(bare.startswith("/"), F.concat(host, bare)).when(bare != "", _join(base, bare))
    wrong = link.rlike(r"^(#|mailto:|tel:|javascript:)") | F.lower(bare).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$")
    return F.when(~wrong & (F.regexp_extract(full, r"^(https?://[^/?#]+)", 1) == host), full)


def _join(base: Column, link: Column) -> Column:
    """A relative path against the base's folder."""
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(^https?://[^/]+/(?:.*/)?|^https?://[^/]+$)[^/]*$", "$1")
    return F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link)


class Tree(HTMLParser):
    """Events of the kept part of a page: ('h', level, text) and ('t', tag, text)."""

    def __init__(self, main_only: bool):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.title = self.heading = ""
        self.events: list[list] = []
        self.ld: list[str] = []
        self.main_only, self.mains = main_only, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        given = dict(attrs)
        if tag == "p":
            while self.stack and self.stack[-1][0] in ("p", "b", "i", "span", "a", "em", "strong"):
                self.stack.pop()
        dropped = (tag in DROPPED or bool(NOISE_CLASS.search(given.get("class") or ""))) and tag not in ("body", "html")
        if tag == "script" and given.get("type") == "application/ld+json":
            tag = "ld"
        self.stack.append((tag, dropped and tag != "ld"))
        if tag in ("p", "li", "td", "th", "blockquote", "pre", "div", "section", "article", "h1", "h2", "h3"):
            self.events.append(["h" if tag[0] == "h" else "t", tag, ""])

    def handle_endtag(self, tag):
        tag = "ld" if tag == "script" and any(t == "ld" for t, _ in self.stack) else tag
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "ld" in tags and data.strip():
            self.ld.append(data)
        elif "title" in tags:
            self.title += data
        elif not any(d for _, d in self.stack):
            if not self.events:
                self.events.append(["t", "body", ""])
            self.events[-1][2] += data


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def sections_of(html: str | None, least: int = 30, empty_headings: bool = False) -> dict:
    """Title, h1, content, and sections of headings h1-h3 with the blocks below them of
    more than ``least`` characters; equal sections once; text before a heading is Allgemein. ``empty_headings`` keeps headings
    without a block as sections of their own."""
    tree = Tree(True)
    tree.feed(html or "")
    tree.close()
    found: list[list] = [["Allgemein", []]]
    first, headings = "", []
    for kind, tag, text in tree.events:
        text = squeeze(text)
        if kind == "h" and text:
            first = first or (text if tag == "h1" else "")
            headings.append(text)
            found.append([text, []])
        elif len(text) > least:
            found[-1][1].append(text)
    sections = list(dict.fromkeys((h, "\n".join(t) or h) for h, t in found if t or empty_headings and h != "Allgemein"))
    sections += [s for s in json_ld(tree.ld) if s not in sections]
    return {"title": squeeze(tree.title), "h1": first, "headings": headings, "content": "\n".join(t for _, t in sections), "sections": [{"heading": h, "text": t} for h, t in sections]}


def json_ld(blocks: list[str], least: int = 40) -> list[tuple[str, str]]:
    """The describing fields of JSON-LD objects, when together at least ``least`` long."""
    out = []
    for block in blocks:
        try:
            value = json.loads(block)
        except ValueError:
            continue
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict):
                place = item.get("location")
                fields = [item.get(k) for k in ("name", "description", "articleBody", "jobTitle", "startDate", "endDate")]
                fields.append(place.get("name") if isinstance(place, dict) else None)
                text = squeeze(" ".join(str(f) for f in fields if f))
                if len(text) >= least:
                    out.append((str(item.get("name") or "Strukturierte Daten"), text))
    return out


RECORD = "title string, h1 string, headings array<string>, content string, sections array<struct<heading:string,text:string>>"


def page_record(html: Column) -> Column:
    """The record of a page as a struct."""

    @F.pandas_udf(RECORD)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from by_slices(batches, lambda pages: pd.DataFrame([sections_of(h) for h in pages], columns=["title", "h1", "headings", "content", "sections"]))

    return run(html)


LD_FIELDS = ("name", "description", "articleBody", "jobTitle", "startDate", "endDate", "location.name")


def json_ld_items(rows: DataFrame, html: str, least: int = 40) -> DataFrame:
    """T15 as a plan: ``rows`` beside heading and text of each describing JSON-LD object of their
    ``html``; objects may stand alone, in an array or in a graph. What isn't JSON is passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    values = rows.withColumn("_v", F.explode(F.transform(blocks, lambda b: F.try_parse_json(b)))).where("_v is not null")
    graph = F.coalesce(F.try_variant_get("_v", "$['@graph']", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    items = values.select(*rows.columns, F.explode(graph).alias("_v"))
    fields = [F.nullif(F.try_variant_get("_v", f"$.{f}", "string"), F.lit("")) for f in LD_FIELDS]
    text = F.trim(F.regexp_replace(F.concat_ws(" ", *fields), r"\s+", " "))
    return items.select(*rows.columns, F.coalesce(fields[0], F.lit("Strukturierte Daten")).alias("heading"), text.alias("text")).where(F.length("text") >= least)


def pdf_links(html: Column, base: Column) -> Column:
    """Links to PDF files by href, then by data-href, absolute by the page's URL, each once.
    Steps up (..) are left as they are."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(rf"(?i)<a\b[^>]*?\s{kind}=[\"']([^\"']+?\.pdf)[\"']"), 1) for kind in ("href", "data-href")])
    scheme, origin = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*.*/|[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$)", 0)
    folder = F.when(folder.endswith("/") & (F.length(folder) > F.length(origin)), folder).otherwise(F.concat(origin, F.lit("/")))

    def absolute(link: Column) -> Column:
        return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(folder, link))

    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), absolute))


def table_rows(html: Column) -> Column:
    """The cells of a page's first table, as an array of arrays."""
    body = F.regexp_extract(html, r"(?is)<table\b.*?</table>", 0)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\z)"), 1)
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), 1)
    plain_cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(cells(r), plain_cell))


def host_label(url: str) -> str:
    return (urlsplit(url).hostname or "").removeprefix("www.").split(".")[0]
