"""Queries of the text, HTML, chunking and timetable operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as T
from ..functions.constants import MODULE_SYNONYMS, NOISE_PATTERNS, POST_PATTERNS, PROGRAM_SYNONYMS, SERVICE_SYNONYMS
from ..functions.splitters import recursive, sentences, splitter, windows, with_pieces
from ..operators import chunk, crawl, fuzzy, timetable
from . import sql as S
from .registry import query, table


@query("T1_normalize", f"SELECT doc_id, {S.norm('text')} AS norm FROM documents")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query("T2_tokenize", f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents")
def t2(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


QUOTED = "concat(text, ' \"', substr(text, 1, 12), '\" \" \"')"


@query("T3_phrases", f"SELECT conv_id, turn, array_to_string({S.phrases(QUOTED)}, '|') AS phrases FROM conversations")
def t3(spark, d):
    quoted = F.concat("text", F.lit(' "'), F.substring("text", 1, 12), F.lit('" " "'))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.phrases(quoted), "|").alias("phrases"))


@query("T40_ngrams", f"WITH t AS (SELECT doc_id, {S.tokens('text')} AS tk FROM documents) SELECT doc_id, len({S.ngrams('tk', 2)}) AS n2, len({S.ngrams('tk', 3)}) AS n3, md5(array_to_string(list_sort({S.ngrams('tk', 2)}), '|')) AS h2 FROM t")
def t40(spark, d):
    rows = T.held(table(spark, d, "documents").select("doc_id", "text"), tk=T.tokenize("text"))
    rows = rows.select("doc_id", T.ngrams(F.col("tk"), 2).alias("two"), T.ngrams(F.col("tk"), 3).alias("three"))
    two, three = F.col("two"), F.col("three")
    return rows.select("doc_id", F.size(two).cast("long").alias("n2"), F.size(three).cast("long").alias("n3"), F.md5(F.array_join(F.array_sort(two), "|")).alias("h2"))


WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part"


def _part_words(spark, d):
    return table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()


@query("T4_levenshtein_pairs", f"WITH v AS ({WORDS}) SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word) AS distance FROM v a JOIN v b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2 WHERE levenshtein(a.word, b.word) <= 2")
def t4(spark, d):
    v = _part_words(spark, d)
    a, b = v.select(F.col("word").alias("a")), v.select(F.col("word").alias("b"))
    return fuzzy.near_words(a, b).where("a < b").select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("T5_fuzzy_vocab_join", f"WITH v AS ({WORDS}), w AS (SELECT DISTINCT substr(word, 2) || 'x' AS w FROM v WHERE length(word) >= 4), c AS (SELECT w, word, levenshtein(w, word) AS distance FROM w JOIN v ON abs(length(w) - length(word)) <= 2 WHERE levenshtein(w, word) <= 2) SELECT w, distance, word AS fix FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY distance, word) AS n FROM c) WHERE n = 1")
def t5(spark, d):
    v = _part_words(spark, d)
    typed = v.where(F.length("word") >= 4).select(F.concat(F.expr("substring(word, 2)"), F.lit("x")).alias("w"))
    return fuzzy.nearest_words(typed, v).select("w", F.col("distance").cast("long").alias("distance"), "fix")


EDGE = "[^0-9a-z_À-ɏ]"
HITS_F = "list_concat(" + ", ".join([f"CASE WHEN regexp_matches(n, '(^|{EDGE}){k}($|{EDGE})') THEN {S.array(v)} ELSE []::varchar[] END" for k, v in PROGRAM_SYNONYMS.items()] + [f"CASE WHEN contains(n, {S.text(k)}) THEN {S.array(v)} ELSE []::varchar[] END" for k, v in MODULE_SYNONYMS.items()]) + ")"


@query(
    "T7_expand_f",
    f"WITH a AS (SELECT conv_id, turn, q, {S.norm('q')} AS n FROM (SELECT conv_id, turn, concat('ki ', role, ' e technik mathematik 1 ', text) AS q FROM conversations)), b AS (SELECT *, {HITS_F} AS h, {S.tokens_of('n')} AS tk FROM a), "
    f"c AS (SELECT conv_id, turn, q, list_filter({S.ordered_distinct('h')}, lambda x: NOT list_contains(tk, x)) AS terms FROM b) SELECT conv_id, turn, CASE WHEN len(terms) > 0 THEN q || ' ' || array_to_string(terms, ' ') ELSE q END AS expanded FROM c",
)
def t7(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("ki "), "role", F.lit(" e technik mathematik 1 "), "text").alias("q"))
    return rows.select("conv_id", "turn", T.expand_f("q").alias("expanded"))


EXPAND_B = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(lower(text), {S.text(k)}) THEN {S.text(v)} END" for k, v in SERVICE_SYNONYMS.items()) + ")"


@query("T8_expand_b", f"SELECT conv_id, turn, {EXPAND_B} AS expanded FROM conversations")
def t8(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.expand_b("text").alias("expanded"))


@query(
    "T9_variants",
    f"WITH a AS (SELECT conv_id, turn, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, {EXPAND_B} AS e FROM conversations), b AS (SELECT conv_id, turn, [text, CASE WHEN len(w) > 1 THEN array_to_string(list_reverse(w), ' ') ELSE text END, e] AS v FROM a) SELECT conv_id, turn, array_to_string({S.ordered_distinct('v')}, '|') AS variants FROM b",
)
def t9(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.variants("text"), "|").alias("variants"))


def _cleaned(c: str, patterns, flags: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, {S.text(f'(?{flags}){p}')}, ' ', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


DIRTY = "concat('Teilen ', substr(text, 1, 40), ' Facebook Urlaub Suchbegriff eingeben ', text)"


@query("T10_clean", f"SELECT doc_id, {_cleaned(DIRTY, NOISE_PATTERNS, 'i')} AS cleaned FROM documents")
def t10(spark, d):
    dirty = F.concat(F.lit("Teilen "), F.substring("text", 1, 40), F.lit(" Facebook Urlaub Suchbegriff eingeben "), "text")
    return table(spark, d, "documents").select("doc_id", T.clean(dirty).alias("cleaned"))


DIRTY_POST = "concat('Inhalt Ausblenden x y Inhalt einblenden ', text, ' AI Suche Hallo, ich bin deine AI Suche. Frage mich etwas! z')"


@query("T11_clean_post", f"SELECT doc_id, {_cleaned(DIRTY_POST, POST_PATTERNS, 'is')} AS cleaned FROM documents")
def t11(spark, d):
    dirty = F.concat(F.lit("Inhalt Ausblenden x y Inhalt einblenden "), "text", F.lit(" AI Suche Hallo, ich bin deine AI Suche. Frage mich etwas! z"))
    return table(spark, d, "documents").select("doc_id", T.clean_post(dirty).alias("cleaned"))


PARAS = f"list_filter(list_transform(regexp_extract_all(html, '(?s)<p>([^<]*)</p>', 1), lambda x: {S.plain('x')}), lambda x: x <> '')"


@query("T12_html_fields", f"SELECT page_id, {S.plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {S.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, array_to_string({PARAS}, '\n') AS content, len({PARAS}) AS n_paragraphs FROM pages")
def t12(spark, d):
    p = dom.paragraphs(F.col("html"))
    return table(spark, d, "pages").select("page_id", dom.title(F.col("html")).alias("title"), dom.h1(F.col("html")).alias("h1"), F.array_join(p, "\n").alias("content"), F.size(p).cast("long").alias("n_paragraphs"))


@query("T13_page_records")
def t13(spark, d):
    rows = table(spark, d, "pages").select("page_id", dom.page_record(F.col("html")).alias("r"))
    return rows.select("page_id", "r.title", "r.h1", "r.content", F.size("r.sections").alias("n_sections"), F.size("r.headings").alias("n_headings"))


@query("S19_simple_records")
def s19(spark, d):
    rows = table(spark, d, "pages").select("page_id", dom.simple_record(F.col("html")).alias("r")).where("r is not null")
    return rows.select("page_id", "r.title", "r.text")


PROBED = "'<option value=1> ' || event_type || ' </option> ' || strftime(ts, '%H:%M') || ' ' || " + "(['Sonntag','Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag'][dayofweek(ts) + 1])"


@query("S24_probes", f"WITH h AS (SELECT event_id, {PROBED} AS html FROM events) SELECT event_id, array_to_string(regexp_extract_all(html, '\\b\\d{{1,2}}:\\d{{2}}\\b'), '|') AS times, array_to_string(regexp_extract_all(html, '(Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag)'), '|') AS days, array_to_string(regexp_extract_all(html, '<option[^>]*>\\s*([^<]*?)\\s*</option>', 1), '|') AS options FROM h")
def s24(spark, d):
    html = F.concat(F.lit("<option value=1> "), "event_type", F.lit(" </option> "), F.date_format("ts", "HH:mm"), F.lit(" "), timetable.weekday(F.col("ts")))
    p = table(spark, d, "events").select("event_id", dom.probes(html).alias("p"))
    return p.select("event_id", *[F.array_join(f"p.{c}", "|").alias(c) for c in ("times", "days", "options")])


S6_SQL = """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages),
b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, link, regexp_replace(link, '[?#].*$', '') AS bare FROM l)
SELECT DISTINCT page_id, CASE WHEN starts_with(bare, '/') THEN host || bare ELSE bare END AS link FROM b
WHERE bare <> '' AND NOT regexp_matches(link, '^(#|mailto:|tel:|javascript:)') AND NOT regexp_matches(lower(bare), '\\.(pdf|jpg|jpeg|png|gif|svg|zip|doc|docx|xls|xlsx|ppt|pptx|mp3|mp4|css|js|ico)$')
AND (starts_with(bare, '/') OR starts_with(bare, host))"""


@query("S6_links", S6_SQL)
def s6(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(dom.raw_links(F.col("html"))).alias("raw"))
    return rows.select("page_id", dom.absolute(F.col("url"), F.col("raw")).alias("link")).where("link is not null").distinct()


@query(
    "T24_context_header",
    f"WITH p AS (SELECT page_id, {S.plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t, {S.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h, {PARAS}[1] AS s FROM pages) SELECT page_id, "
    "concat_ws(chr(10), CASE WHEN t <> '' THEN 'Seite: ' || t END, CASE WHEN h <> '' AND lower(h) <> lower(t) THEN 'Überschrift: ' || h END, CASE WHEN coalesce(s, '') NOT IN ('', 'Allgemein') AND lower(trim(s)) <> lower(t) AND lower(trim(s)) <> lower(h) THEN 'Abschnitt: ' || s END) AS header FROM p",
)
def t24(spark, d):
    rows = table(spark, d, "pages").select("page_id", dom.title(F.col("html")).alias("t"), dom.h1(F.col("html")).alias("h"), F.try_element_at(dom.paragraphs(F.col("html")), F.lit(1)).alias("s"))
    return rows.select("page_id", T.context_header(F.col("t"), F.col("h"), F.col("s")).alias("header"))


STRIDE = "SELECT doc_id, i - 1 AS chunk_index, substr(text, ((i - 1) * {step} + 1)::bigint, {size}) AS piece FROM (SELECT doc_id, text, unnest(range(1, (length(text) - 1) // {step} + 2)) AS i FROM documents WHERE length(text) > 0)"


@query("T26_stride_chunks", STRIDE.format(step=680, size=800))
def t26(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.stride_chunks(F.col("text"), 800, 120)).alias("chunk_index", "piece"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "piece")


@query(
    "T29_chunk_document",
    f"WITH d AS (SELECT doc_id, trim(text) AS text, lang, source, length(text) > 1500 AS long FROM documents WHERE trim(text) <> ''), e AS (SELECT *, CASE WHEN long THEN 680 ELSE 750 END AS step, CASE WHEN long THEN 800 ELSE 900 END AS size FROM d), "
    "f AS (SELECT *, unnest(range(1, (length(text) - 1) // step + 2)) AS i FROM e), g AS (SELECT *, substr(text, ((i - 1) * step + 1)::bigint, size) AS piece FROM f) "
    "SELECT 'doc/' || doc_id AS url, i - 1 AS chunk_index, CASE WHEN long THEN 'Text' ELSE 'Allgemein' END AS section_heading, 'Seite: ' || source || chr(10) || 'Überschrift: ' || lang || CASE WHEN long THEN chr(10) || 'Abschnitt: Text' ELSE '' END || chr(10) || chr(10) || piece AS text FROM g WHERE trim(piece) <> ''",
)
def t29(spark, d):
    none = F.array().cast("array<struct<heading:string,text:string>>")
    one = F.array(F.struct(F.lit("Text").alias("heading"), F.col("text").alias("text")))
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.col("lang").alias("h1"), F.col("text").alias("content"), F.when(F.length("text") > 1500, one).otherwise(none).alias("sections"), F.lit("webpage").alias("type"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return chunk.chunk_documents(docs, split=chunk.stride).select("url", F.col("chunk_index").cast("long").alias("chunk_index"), "section_heading", "text")


#: SQL of the recursive splitter. calls: a text with the coarsest separator that occurs in it, and in turn each part of
#: it that is too long, with the finer ones. spans: runs of the other parts, their lengths with separators summed up.
#: cuts: from part a the last part b that fits; then the first part a that leaves room and keeps the overlap.
RECURSIVE = """WITH RECURSIVE calls AS (
  SELECT doc_id, '' AS path, text AS x, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, ' ') THEN ' ' ELSE '' END AS sep FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, path || lpad(i::varchar, 8, '0'), part, CASE WHEN length(sep) = 2 AND contains(part, chr(10)) THEN chr(10) WHEN sep <> ' ' AND contains(part, ' ') THEN ' ' ELSE '' END
  FROM (SELECT doc_id, path, sep, unnest(string_split(x, sep)) AS part, unnest(range(1, len(string_split(x, sep)) + 1)) AS i FROM calls WHERE sep <> '') WHERE length(part) > {size}),
parts AS (SELECT doc_id, path, sep, unnest(string_split(x, sep)) AS part, unnest(range(1, len(string_split(x, sep)) + 1)) AS i FROM calls),
runs AS (SELECT *, sum(CASE WHEN length(part) > {size} AND sep <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY i) AS nr FROM parts WHERE part <> ''),
sums AS (SELECT *, sum(length(part) + length(sep)) OVER (PARTITION BY doc_id, path, nr ORDER BY i) AS c FROM runs WHERE NOT (length(part) > {size} AND sep <> '')),
spans AS (SELECT doc_id, path, nr, any_value(sep) AS sep, list(part ORDER BY i) AS ps, list(i ORDER BY i) AS nos, list(c::bigint ORDER BY i) AS cs FROM sums GROUP BY doc_id, path, nr),
cuts AS (
  SELECT doc_id, path, nr, sep, ps, nos, cs, 1::bigint AS a, len(list_filter(cs, lambda c: c <= {size} + length(sep)))::bigint AS b FROM spans
  UNION ALL SELECT doc_id, path, nr, sep, ps, nos, cs, a, len(list_filter(cs, lambda c: c <= {size} + length(sep) + CASE WHEN a > 1 THEN cs[a - 1] ELSE 0 END))::bigint
  FROM (SELECT * REPLACE (least(b + 1, 1 + len(list_filter(list_prepend(0, cs), lambda c: c < cs[b] - length(sep) - least({overlap}, {size} - length(ps[b + 1]) - length(sep)))))::bigint AS a) FROM cuts WHERE b < len(ps))),
pieces AS (SELECT doc_id, path || lpad(nos[b]::varchar, 8, '0') AS place, regexp_replace(list_reduce(ps[a:b], lambda u, w: u || sep || w), '^\\s+|\\s+$', '', 'g') AS piece FROM cuts)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS chunk_index, piece FROM pieces WHERE piece <> ''"""


@query("T25_recursive_chunks", RECURSIVE.format(size=800, overlap=120))
def t25(spark, d):
    return with_pieces(table(spark, d, "documents").select("doc_id", "text"), "text", recursive, 800, 120).select("doc_id", "chunk_index", "piece")


def last_in(part: str, sign: str) -> str:
    """SQL: the place before the last ``sign`` in ``part``, from 0; null without one."""
    return f"CASE WHEN contains({part}, {sign}) THEN length({part}) - length({sign}) - instr(reverse({part}), reverse({sign})) + 1 END"


def walk_sql(text: str, stop: str, size: int, overlap: int, go_on: str, source: str = "documents") -> str:
    """SQL of a splitter that walks over ``text``: ``stop`` gives a piece's end from x (the text) and spot."""
    step = f"SELECT doc_id, x, i, spot, {stop} AS stop FROM s"
    return (
        f"WITH RECURSIVE t AS (SELECT doc_id, {text} AS x FROM {source}), w AS (SELECT doc_id, x, i, spot, stop FROM (WITH s AS (SELECT doc_id, x, 0::bigint AS i, 0::bigint AS spot FROM t WHERE length(x) > {size}) {step}) "
        f"UNION ALL SELECT doc_id, x, i, spot, stop FROM (WITH s AS (SELECT doc_id, x, i + 1 AS i, greatest(spot + 1, stop - {overlap}) AS spot FROM w WHERE greatest(spot + 1, stop - {overlap}) < {go_on}) {step})), "
        "p AS (SELECT doc_id, i, regexp_replace(substr(x, spot + 1, stop - spot), '^\\s+|\\s+$', '', 'g') AS piece FROM w "
        f"UNION ALL SELECT doc_id, 0, x FROM t WHERE length(x) <= {size} AND regexp_matches(x, '\\S'))"
    )


SPACE_STOP = f"CASE WHEN spot + 1500 < length(x) AND {last_in('substr(x, spot + 1, 1500)', repr(' '))} > 750 THEN spot + {last_in('substr(x, spot + 1, 1500)', repr(' '))} ELSE spot + 1500 END"


@query("T27_window_chunks", walk_sql("trim(regexp_replace(text, '\\s+', ' ', 'g'))", SPACE_STOP, 1500, 200, "length(x) - 200") + " SELECT doc_id, i AS chunk_index, piece FROM p")
def t27(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(splitter(windows, 1500, 200)(F.col("text"))).alias("chunk_index", "piece"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "piece")


SENTENCE_STOP = "CASE WHEN spot + 800 < length(x) THEN coalesce(" + ", ".join(f"spot + 400 + length({e}) + {last_in('substr(x, spot + 401, 400)', e)}" for e in ("'. '", "'! '", "'? '", "chr(10)", "' '")) + ", spot + 800) ELSE spot + 800 END"


@query("T28_sentence_chunks", walk_sql("text", SENTENCE_STOP, 800, 150, "length(x)") + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, piece FROM p WHERE piece <> ''")
def t28(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(splitter(sentences, 800, 150)(F.col("text"))).alias("chunk_index", "piece"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "piece")


PART_STOP = f"CASE WHEN spot + 1200 < length(x) AND {last_in('substr(x, spot + 1, 1200)', repr(' '))} > 600 THEN spot + {last_in('substr(x, spot + 1, 1200)', repr(' '))} ELSE spot + 1200 END"
PAGE_TEXT = f"(SELECT row_number() OVER () AS doc_id, url, {S.plain('html')} AS x, {S.plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages)"


@query(
    "T45_part_chunks",
    walk_sql("x", PART_STOP, 1200, 150, "length(x) - 150", "(SELECT * FROM pg WHERE length(x) >= 200)").replace("WITH RECURSIVE t AS", f"WITH RECURSIVE pg AS {PAGE_TEXT}, t AS", 1)
    + ", k AS (SELECT p.doc_id, p.i, p.piece, g.url, g.title, count(*) OVER (PARTITION BY p.doc_id) AS chunk_total FROM p JOIN pg g USING (doc_id)) "
    "SELECT url, CASE WHEN chunk_total > 1 THEN title || ' (Part ' || (i + 1) || ')' ELSE title END AS title, piece AS text, i AS chunk_index, chunk_total, string_split(regexp_replace(coalesce(regexp_extract(url, '^https?://([^/?#:]+)', 1), ''), '^www\\.', ''), '.')[1] AS source, ('0x' || substr(md5(url || '_' || i), 1, 12))::bigint AS id FROM k",
)
def t45(spark, d):
    rows = chunk.window_chunks(table(spark, d, "pages").select("url", dom.title(F.col("html")).alias("title"), dom.plain(F.col("html")).alias("text")))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("chunk_total", F.col("chunk_total").cast("long"))


DAY = "['Sonntag','Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag'][dayofweek(ts) + 1]"


@query(
    "T31_ical_roundtrip",
    f"SELECT event_id, event_type AS title, {DAY} AS day, strftime(ts, '%H:%M') || ' - ' || strftime(ts + INTERVAL 90 MINUTE, '%H:%M') AS time, 'Studiengang: P' || user_id || ' | Tag: ' || {DAY} || ' | Zeit: ' || strftime(ts, '%H:%M') || ' - ' || strftime(ts + INTERVAL 90 MINUTE, '%H:%M') || ' | Raum: R' || user_id || ' | Veranstaltung: ' || event_type || ' | ' || props AS full_text FROM events",
)
def t31(spark, d):
    form = "yyyyMMdd'T'HHmmss"
    line = lambda k, v: F.concat(F.lit(k), v, F.lit("\r\n"))
    folded = F.concat(F.substring("props", 1, 3), F.lit("\r\n "), F.expr("substring(props, 4)"))
    ical = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), line("SUMMARY:", F.col("event_type")), line("LOCATION:R", F.col("user_id").cast("string")), line("DTSTART;TZID=Europe/Berlin:", F.date_format("ts", form)), line("DTEND:", F.date_format(F.expr("ts + interval 90 minutes"), form)), line("DESCRIPTION:", folded), F.lit("END:VEVENT\r\nEND:VCALENDAR\r\n"))
    rows = table(spark, d, "events").select(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("program"), F.col("event_id").alias("pg_id"), ical.alias("ical"))
    return timetable.parse_ical(rows).select(F.col("pg_id").alias("event_id"), "title", "day", "time", "full_text")


@query("T36_weekday", f"SELECT event_id, {DAY} AS day, strftime(ts, '%H:%M') AS time FROM events")
def t36(spark, d):
    return table(spark, d, "events").select("event_id", timetable.weekday(F.col("ts")).alias("day"), F.date_format("ts", "HH:mm").alias("time"))


SLOTS_SQL = f"""WITH f AS (SELECT user_id AS program_id, CASE WHEN event_type = 'error' THEN '' ELSE {DAY} END AS day, strftime(ts, '%H') || ':00' AS time, event_id AS pos, trim(event_type || ' ' || CASE WHEN value > 50 THEN props ELSE '' END) AS info FROM events)
SELECT program_id, day, time, count(*) AS n_fragments, string_agg(info, '|' ORDER BY pos) AS fragments FROM f WHERE length(info) > 5 AND day <> '' AND time <> ''
GROUP BY program_id, day, time HAVING NOT (time = '17:00' AND count(*) <= 2)"""


@query("T32_slots", SLOTS_SQL)
def t32(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("program_id"), F.lit("p").alias("program"), F.when(F.col("event_type") == "error", "").otherwise(timetable.weekday(F.col("ts"))).alias("day"), F.concat(F.date_format("ts", "HH"), F.lit(":00")).alias("time"), F.col("event_id").alias("pos"), F.concat_ws(" ", "event_type", F.when(F.col("value") > 50, F.col("props")).otherwise("")).alias("info"))
    return timetable.slots(rows).select("program_id", "day", "time", F.size("fragments").cast("long").alias("n_fragments"), F.array_join("fragments", "|").alias("fragments"))


ROOMS = "'G1','G2','G3','G4','AH','WIN','231','111','114','129','130','131'"
T33_SQL = f"""WITH f AS (SELECT p_partkey, p_brand, [p_name || ' (IN-' || p_partkey || ')', 'G2 ' || p_brand, 'M. ' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '), 'IN S' || (p_size % 9 + 1)] AS fs FROM part),
u AS (SELECT p_partkey, p_brand, unnest(fs) AS f, unnest([1, 2, 3, 4]) AS n FROM f),
k AS (SELECT *, CASE WHEN regexp_matches(f, '[.,]') AND contains(f, ' ') AND len(list_filter(string_split(f, ','), lambda p: length(trim(p)) >= 30)) = 0 AND regexp_matches(substr(f, 1, 3), '\\p{{Lu}}') THEN 'lecturer'
WHEN regexp_matches(f, 'S[1-9]$') OR contains(f, 'S1+') OR contains(f, 'S1_') THEN 'group' WHEN string_split(f, ' ')[1] IN ({ROOMS}) OR (length(f) <= 20 AND regexp_matches(substr(f, 1, 4), '\\d')) THEN 'room'
WHEN contains(f, '(') AND contains(f, '-') THEN 'name' ELSE 'other' END AS kind FROM u),
g AS (SELECT p_partkey, p_brand, arg_max(f, n) FILTER (WHERE kind = 'lecturer') AS lecturer, arg_max(f, n) FILTER (WHERE kind = 'group') AS grp, arg_max(f, n) FILTER (WHERE kind = 'room') AS room, coalesce(arg_max(f, n) FILTER (WHERE kind = 'name'), arg_min(f, n) FILTER (WHERE kind = 'other' AND length(f) > 10)) AS name FROM k GROUP BY ALL)
SELECT p_partkey AS program_id, name, concat_ws(' | ', 'Studiengang: ' || p_brand, 'Vorlesung: ' || name, 'Tag: Montag', 'Zeit: 08:00', 'Raum: ' || room, 'Dozent: ' || lecturer, 'Gruppe: ' || grp) AS full_text FROM g WHERE name IS NOT NULL"""


@query("T33_lectures", T33_SQL)
def t33(spark, d):
    p = table(spark, d, "part")
    made = F.array(F.concat("p_name", F.lit(" (IN-"), F.col("p_partkey").cast("string"), F.lit(")")), F.concat(F.lit("G2 "), "p_brand"), F.concat(F.lit("M. "), F.initcap("p_type")), F.concat(F.lit("IN S"), (F.col("p_size") % 9 + 1).cast("string")))
    return timetable.lectures(p.select(F.col("p_partkey").alias("program_id"), F.col("p_brand").alias("program"), F.lit("Montag").alias("day"), F.lit("08:00").alias("time"), made.alias("fragments"))).select("program_id", "name", "full_text")


CARRY = f"""WITH l AS (SELECT user_id AS page, event_id AS pos, CASE event_type WHEN 'signup' THEN {DAY} WHEN 'error' THEN strftime(ts, '%H:%M') ELSE event_type END AS line FROM events),
k AS (SELECT *, line IN ('Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag') AS is_day, regexp_matches(line, '^\\d{{1,2}}:\\d{{2}}$') AS is_time FROM l),
c AS (SELECT *, last_value(CASE WHEN is_day THEN line END IGNORE NULLS) OVER w AS day, last_value(CASE WHEN is_time THEN line END IGNORE NULLS) OVER w AS time FROM k WINDOW w AS (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page, pos, line, day, time FROM c WHERE NOT is_day AND NOT is_time AND day IS NOT NULL"""


@query("S15_carry_forward", CARRY)
def s15(spark, d):
    line = F.when(F.col("event_type") == "signup", timetable.weekday(F.col("ts"))).when(F.col("event_type") == "error", F.date_format("ts", "HH:mm")).otherwise(F.col("event_type"))
    return timetable.carry_forward(table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), line.alias("line"))).select("page", "pos", "line", "day", "time")


@query("T34_semester_text", "SELECT 'sem_' || (row_number() OVER (PARTITION BY p_mfgr ORDER BY p_partkey) - 1) AS id, p_mfgr AS semester, trim(concat_ws(' ', p_name, p_type, nullif(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, ''))) AS content FROM (SELECT *, p_size % 4 AS p_mfgr FROM part)")
def t34(spark, d):
    p = table(spark, d, "part")
    rows = p.select((F.col("p_size") % 4).alias("semester"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("lecturer"), F.lit(None).cast("string").alias("day"), F.lit("  ").alias("time"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("room"))
    return timetable.semester_text(rows).select("id", "semester", "content")


MD5_BUCKET = "list_reduce([0::bigint] || list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(md5(term), i * 8 + 1, 8))::bigint), lambda a, b: (a * 4294967296 + b) % 1000000)"


@query("V4_hashed_tf", f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({S.norm('text')}, '[a-zA-Z0-9äöüÄÖÜß]{{2,}}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT doc_id, {MD5_BUCKET} AS bucket, sum(tf)::bigint AS tf FROM c GROUP BY ALL")
def v4(spark, d):
    from ..sources.store import hashed_terms

    return hashed_terms(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), F.col("index").alias("bucket"), F.col("value").alias("tf"))


@query("A7_term_freq", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def a7(spark, d):
    from ..operators.retrieve import postings

    return postings(table(spark, d, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


@query("V6_point_ids", "SELECT doc_id, ('0x' || substr(md5('doc_' || doc_id), 1, 12))::bigint AS id FROM documents")
def v6(spark, d):
    return table(spark, d, "documents").select("doc_id", T.point_id(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("id"))


@query("T18_markdown_table", "SELECT page_id, '| key | url | region |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || page_id || ' | ' || url || ' |  |' AS md FROM pages")
def t18(spark, d):
    rows = F.array(F.array(F.lit("key"), F.lit("url"), F.lit("region")), F.array(F.col("page_id").cast("string"), F.col("url")))
    return table(spark, d, "pages").select("page_id", T.markdown_table(rows).alias("md"))


@query(
    "S7_nested",
    "WITH RECURSIVE r AS (SELECT 0 AS k UNION ALL SELECT 2 * k + x FROM r CROSS JOIN (VALUES (1), (2)) t(x) WHERE k % 5 <> 3 AND 2 * k + x <= (SELECT max(page_id) // 100 FROM pages)) SELECT DISTINCT url FROM pages JOIN r ON page_id // 100 = k",
)
def s7_nested(spark, d):
    """Sitemaps of a hundred pages; each names two further ones, but for some."""
    p = table(spark, d, "pages").select(F.floor(F.col("page_id") / 100).cast("long").alias("k"), F.concat(F.lit("<url><loc>\n"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("x"))
    name = lambda k: F.concat(F.lit("http://x.example/s"), k.cast("string"), F.lit(".xml"))
    further = F.when(F.col("k") % 5 != 3, F.concat(*[x for i in (1, 2) for x in (F.lit("<sitemap><loc>"), name(2 * F.col("k") + i), F.lit("</loc></sitemap>"))])).otherwise("")
    files = p.groupBy("k").agg(F.array_join(F.collect_list("x"), "").alias("own")).select(name(F.col("k")).alias("sitemap"), F.concat(F.lit("<urlset>"), "own", further, F.lit("</urlset>")).alias("xml"))
    return crawl.sitemap_pages(spark.range(1).select(name(F.col("id")).alias("sitemap")), files)


@query("T42_highlight", "SELECT doc_id, regexp_replace(text, '(?i)(ation|the)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def t42(spark, d):
    return table(spark, d, "documents").select("doc_id", T.highlight(F.col("text"), "ation the of").alias("marked"))


@query("T44_to_int", "SELECT event_id, coalesce(try_cast(regexp_extract(props, '(\\d+|[a-z])', 1) AS int), -1) AS v FROM events")
def t44(spark, d):
    return table(spark, d, "events").select("event_id", T.to_int(F.regexp_extract("props", r"(\d+|[a-z])", 1), -1).alias("v"))


@query("S14_programs", "SELECT n_nationkey, n_nationkey::varchar || '=' || n_name AS programs FROM nation")
def s14(spark, d):
    html = F.concat(F.lit('<select name="og"><option value="">-</option><option value="'), F.col("n_nationkey").cast("string"), F.lit('"> '), "n_name", F.lit(" </option></select>"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(timetable.programs(html), lambda p: F.concat_ws("=", p["id"], p["name"])), "|").alias("programs"))


@query("S7_sitemap", "SELECT DISTINCT url FROM pages")
def s7(spark, d):
    xml = table(spark, d, "pages").select(F.lit("s").alias("sitemap"), F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("</loc></url><sitemap><loc>http://x.example/nested.xml</loc></sitemap></urlset>")).alias("xml"))
    return crawl.sitemap_urls(xml)
