"""Queries of records, shown results, stored collections and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import dom
from ..functions import text as T
from ..functions.constants import MODULE_SYNONYMS, PROGRAM_SYNONYMS
from ..operators import chunk, feedback, fuzzy, present, rank
from ..sources import readers, store
from ..streaming import feedback as streams
from . import sql as S
from .registry import query, table
from .search import Collection
from .search_queries import EVERY, dense_sql
from .text_queries import MD5_BUCKET

# --- collections -----------------------------------------------------------------------------


@query("K4_collection_info", "SELECT lang AS collection, count(*) AS points FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT NULL, count(lang) FROM documents")
def k4(spark, d):
    docs = table(spark, d, "documents")
    kept = store.Store(spark, scratch.folder(spark, "collections"))
    for (lang,) in docs.select("lang").where("lang is not null").distinct().collect():
        kept.recreate(lang, docs.where(F.col("lang") == lang).select(F.col("doc_id").alias("id"), "text"))
        kept.recreate(f"{lang}-old", docs.limit(0).select(F.col("doc_id").alias("id")))
        kept.drop(f"{lang}-old")
    return kept.info().select("collection", "points")


@query(
    "K11_migrated",
    f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({S.norm('text')}, '[a-zA-Z0-9äöüÄÖÜß]{{2,}}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), b AS (SELECT doc_id, {MD5_BUCKET} AS bucket, sum(tf)::bigint AS tf FROM c GROUP BY ALL), "
    "l AS (SELECT doc_id, string_agg(bucket, ',' ORDER BY bucket) AS indices, string_agg(tf, ',' ORDER BY bucket) AS counts FROM b GROUP BY doc_id) SELECT doc_id, coalesce(indices, '') AS indices, coalesce(counts, '') AS counts FROM documents LEFT JOIN l USING (doc_id)",
)
def k11(spark, d):
    kept = store.Store(spark, scratch.folder(spark, "migration"))
    kept.recreate("old", table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    kept.migrate("old", "new")
    return kept.read("new").select(F.col("id").alias("doc_id"), F.array_join("sparse_indices", ",").alias("indices"), F.array_join(F.transform("sparse_values", lambda v: v.cast("long")), ",").alias("counts"))


@query("R4_dense_fallback", f"SELECT query_id, id, round(1.0 / (60 + rank), 9) AS score, rank FROM {dense_sql(EVERY, 20)}")
def r4(spark, d):
    """A collection without texts has no term index and is searched by its vectors alone."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = points.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.lit("").alias("text"), F.col("embedding").alias("qvec"))
    return Collection(points).hybrid(asked, 20).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("K6_S18_json_lines", "SELECT doc_id, text, lang FROM documents")
def k6(spark, d):
    path = scratch.folder(spark, "lines")
    store.write_lines(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.json_lines(spark, path, "doc_id long, text string, lang string")


# --- words -----------------------------------------------------------------------------------

SYNONYM_ROWS = ", ".join(f"({S.text(w)}, {whole})" for s in (PROGRAM_SYNONYMS, MODULE_SYNONYMS) for k, values in s.items() for w, whole in [(k, True), *((v, False) for v in values)])


@query("T6_vocabulary", f"WITH r AS (SELECT whole, {S.norm('w')} AS n FROM (VALUES {SYNONYM_ROWS}) t(w, whole)) SELECT DISTINCT word FROM (SELECT unnest(CASE WHEN whole THEN [n] ELSE string_split(n, ' ') END) AS word FROM r) WHERE word <> ''")
def t6(spark, d):
    return fuzzy.vocabulary(spark, PROGRAM_SYNONYMS, MODULE_SYNONYMS)


@query("T41_clean_answers", "SELECT doc_id, CASE WHEN lang = 'es' OR contains(upper(text), 'UNBEKANNT') THEN '' ELSE trim(regexp_replace('\"' || trim(text) || '\"', '^[\"'']+|[\"'']+$', '', 'g')) END AS answer FROM documents")
def t41(spark, d):
    """Whole texts as answers, wrapped in reasoning and quotes; those in Spanish are marked unknown."""
    answer = F.concat(F.lit("<think>the\n"), F.coalesce("lang", F.lit("")), F.lit("</think> \""), F.trim("text"), F.when(F.col("lang") == "es", F.lit(" unbekannt\"")).otherwise(F.lit("\"")))
    return table(spark, d, "documents").select("doc_id", T.without_thinking(answer).alias("answer"))


@query("T43_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '-') AS shown FROM part")
def t43(spark, d):
    """Every letter after a non-letter is a capital, also behind hyphens."""
    return table(spark, d, "part").select("p_partkey", T.title_case(F.regexp_replace(F.upper("p_name"), " ", "-")).alias("shown"))


@query("Q22_suggestions", "WITH b AS (SELECT p_name AS value, 0 AS source, p_partkey AS place FROM part UNION ALL SELECT p_type, 1, p_partkey FROM part), f AS (SELECT value, min(source * 1000000000000 + place) AS spot FROM b WHERE contains(lower(value), 'an') AND lower(value) <> 'an' GROUP BY value) SELECT value, source, place FROM (SELECT value, (spot // 1000000000000)::int AS source, spot % 1000000000000 AS place FROM f ORDER BY spot, value LIMIT 15)")
def q22(spark, d):
    part = table(spark, d, "part")
    return rank.suggest(part.select(F.col("p_name").alias("value"), F.col("p_partkey").alias("place")), part.select(F.col("p_type").alias("value"), F.col("p_partkey").alias("place")), "An").select("value", "source", "place")


@query("ST2_query_counts", "SELECT lower(trim(substr(event_type, 1, 1 + event_id % 7))) AS query, count(*) AS search_count FROM events WHERE length(trim(substr(event_type, 1, 1 + event_id % 7))) >= 3 GROUP BY 1")
def st2(spark, d):
    """Queries as they are typed: beginnings of one to seven characters."""
    typed = F.expr("concat(' ', upper(substring(event_type, 1, 1 + cast(event_id % 7 as int))), ' ')")
    return feedback.query_counts(table(spark, d, "events").select(typed.alias("query")))


# --- chunks and documents of pages -----------------------------------------------------------


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages; the German ones link one PDF."""
    one = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("url"), F.concat("source", F.lit(".pdf")).alias("filename"), F.col("text").alias("text"))
    none = F.array().cast("array<struct<url:string,filename:string,text:string>>")
    return table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.col("text").alias("content"), F.when(F.col("lang") == "de", F.array(one)).otherwise(none).alias("pdfs"))


@query(
    "T30_page_chunks",
    "WITH d AS (SELECT *, coalesce(lang = 'de', false) AS pdf FROM documents WHERE text IS NOT NULL), c AS (SELECT *, unnest(range(0, (length(text) - 1) // 680 + 1)) AS i FROM d WHERE length(text) > 0), "
    "p AS (SELECT *, substr(text, (i * 680 + 1)::bigint, 800) AS piece FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM p WHERE trim(piece) <> '') "
    "SELECT 'u' || doc_id AS url, source AS title, piece || CASE WHEN chunk_index = 0 AND pdf THEN chr(10) || '[PDF: ' || source || '.pdf] ' || substr(text, 1, 1200) ELSE '' END AS text, chunk_index, chunk_total, NULL AS parent_url, 'website' AS type FROM k "
    "UNION ALL SELECT 'p' || doc_id, source || '.pdf', substr(text, 1, 1200), 0, 1, 'u' || doc_id, 'pdf' FROM d WHERE pdf",
)
def t30(spark, d):
    rows = chunk.page_chunks(pdf_pages(spark, d), chunk.stride(800, 120))
    return rows.select("url", "title", "text", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_total").cast("long").alias("chunk_total"), "parent_url", "type")


@query(
    "T22_with_pdfs",
    "WITH p AS (SELECT 'u' || (doc_id // 3) AS url, string_agg('[PDF: ' || lang || '.pdf] ' || substr(text, 1, 400), chr(10) ORDER BY doc_id) AS part, count(*) AS n, string_agg('p' || lpad(doc_id::varchar, 9, '0'), ',' ORDER BY doc_id) AS links FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1) "
    "SELECT 'u' || doc_id AS url, text || coalesce(chr(10) || part, '') AS content, coalesce(part, '') AS section, coalesce(n, 0) AS pdf_count, coalesce(links, '') AS links FROM documents d LEFT JOIN p ON p.url = 'u' || d.doc_id WHERE text IS NOT NULL",
)
def t22(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    none = F.array().cast("array<struct<heading:string,text:string>>")
    pages = docs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"), none.alias("sections"))
    pdfs = docs.where("lang is not null").select(F.expr("concat('u', doc_id div 3)").alias("page_url"), F.expr("concat('p', lpad(doc_id, 9, '0'))").alias("url"), F.concat("lang", F.lit(".pdf")).alias("filename"), "text")
    out = chunk.with_pdfs(pages, pdfs)
    section = F.coalesce(F.try_element_at("sections", F.lit(-1))["text"], F.lit(""))
    return out.select("url", "content", section.alias("section"), F.col("pdf_count").cast("long").alias("pdf_count"), F.array_join(F.transform("pdf_sources", lambda s: s.url), ",").alias("links"))


@query("T23_pdf_snippet", "SELECT doc_id, substr(trim(regexp_replace(text, '^\\s+', '')), 1, 1200) AS snippet FROM documents")
def t23(spark, d):
    docs = table(spark, d, "documents")
    section = F.concat(F.lit("[PDF: other.pdf] first\n[Dokument: own.pdf] "), "text")
    return docs.select("doc_id", chunk.pdf_snippet(section, F.lit("own.pdf")).alias("snippet"))


EVENT = "CASE WHEN lang = 'de' THEN 'https://x.example/veranstaltungen/' ELSE 'https://x.example/personen/' END"


@query("T16_template_text", "SELECT doc_id, CASE WHEN lang = 'de' THEN trim(text) ELSE text || ' WEITERE Veranstaltungen ' || source END AS body FROM documents")
def t16(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", present.template_section(F.expr(EVENT), F.concat("text", F.lit(" WEITERE Veranstaltungen "), "source")).alias("body"))


@query("T21_pdf_relevance", "SELECT page_id, regexp_matches(lower(url), 'a1|/2|handbuch') AS relevant FROM pages")
def t21(spark, d):
    return table(spark, d, "pages").select("page_id", present.relevant_pdf(F.upper("url"), ("a1", "/2", "handbuch")).alias("relevant"))


@query("S21_rendered_choice", "SELECT doc_id, CASE WHEN length(substr(text, 1, n_chars // 3)) < 350 AND length(text) > length(substr(text, 1, n_chars // 3)) THEN text ELSE substr(text, 1, n_chars // 3) END AS chosen FROM documents")
def s21(spark, d):
    return table(spark, d, "documents").select("doc_id", present.rendered_choice(F.expr("substring(text, 1, cast(n_chars div 3 as int))"), F.col("text")).alias("chosen"))


@query("T35_body_records", "SELECT 'd' || doc_id AS url, source AS title, substr(text, 1, 1000) AS content, source || ' ' || substr(text, 1, 1000) AS full_text, 'asta' AS type FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def t35(spark, d):
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    return present.student_body_record(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.col("text").alias("content")), "asta")


BARE = "regexp_replace(url, '[?#].*$', '')"
ORIGIN = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')"
PDF_FOLDER = f"CASE WHEN regexp_matches({BARE}, '^[a-zA-Z]+://[^/]*$') THEN {BARE} || '/' ELSE regexp_replace({BARE}, '[^/]*$', '') END"


@query("T20_pdf_links", f"SELECT page_id, {PDF_FOLDER} || 'a' || page_id || '.pdf,' || {ORIGIN} || '/' || page_id || '.PDF,' || {ORIGIN} || '/b.pdf' AS links FROM pages")
def t20(spark, d):
    """Whole pages, with links to files at their end."""
    key = F.col("page_id").cast("string")
    html = F.concat("html", F.lit("<a data-href='/b.pdf'>x</a><a class=k href='a"), key, F.lit(".pdf'>1</a><a href=\"/"), key, F.lit(".PDF\">2</a><a href='a"), key, F.lit(".pdf'>again</a><a href='/page'>3</a>"))
    return table(spark, d, "pages").select("page_id", F.array_join(dom.pdf_links(html, F.col("url")), ",").alias("links"))


@query("T17_html_tables", "SELECT page_id, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || url || ' |' AS md FROM pages")
def t17(spark, d):
    html = F.concat("html", F.lit("<p>x</p><table class=t><tr><th> Key <th><b>Name</b></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), "url", F.lit("</td></tr></table><table><tr><td>no</td></tr></table>"))
    return table(spark, d, "pages").select("page_id", T.markdown_table(dom.table_rows(html)).alias("md"))


@query(
    "T15_json_ld",
    "SELECT doc_id, source AS heading, trim(regexp_replace(source || ' ' || text || ' ' || lang, '\\s+', ' ', 'g')) AS text FROM documents WHERE lang <> 'es' AND source IS NOT NULL AND text IS NOT NULL AND length(trim(regexp_replace(source || ' ' || text || ' ' || lang, '\\s+', ' ', 'g'))) >= 40",
)
def t15(spark, d):
    """Documents as JSON-LD: an object, one of an array beside another that is too short, in a graph, and
    broken in Spanish ones."""
    docs = table(spark, d, "documents").where("source is not null and text is not null and lang is not null")
    one = F.struct(F.col("source").alias("name"), F.col("text").alias("description"), F.struct(F.col("lang").alias("name")).alias("location"))
    many = F.to_json(F.array(one, F.struct(F.lit("kurz").alias("name"), F.lit("zu kurz").alias("description"), F.struct(F.lit("").alias("name")).alias("location"))))
    whole = F.when(F.col("lang") == "de", many).when(F.col("lang") == "fr", F.to_json(F.struct(F.array(one).alias("@graph")))).when(F.col("lang") == "es", F.lit('{"name": ')).otherwise(F.to_json(one))
    pages = docs.select("doc_id", F.concat(F.lit("<p>x</p><script type='application/ld+json'>"), whole, F.lit("</script><script>var a = 1;</script>")).alias("html"))
    return dom.json_ld_items(pages, "html").select("doc_id", "heading", "text")


# --- files -----------------------------------------------------------------------------------

FIFTY = "SELECT doc_id // 50 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1"


def fifties(spark: SparkSession, d: str) -> DataFrame:
    """The documents by fifty, as one text each."""
    parts = table(spark, d, "documents").where("text is not null").groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("rows"))
    return parts


@query("S9_folder", f"SELECT md5(content || chr(10)) AS content, length(content) + 1 AS n FROM ({FIFTY}) WHERE length(content) >= 50")
def s9(spark, d):
    """A folder of text files, one for fifty documents, through the loader of folders."""
    path = scratch.folder(spark, "files")
    fifties(spark, d).select(F.array_join(F.transform("rows", lambda r: r.text), "\n").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(f"{path}/in")
    rows = readers.load(spark, readers.Source("docs", "folder", "c", options={"path": f"{path}/in"}))
    return rows.select(F.md5("content").alias("content"), F.length("content").cast("long").alias("n"))


@query("S17_json_document", "SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL")
def s17(spark, d):
    """JSON documents over several lines, an array of fifty records in each file."""
    path = scratch.folder(spark, "json")
    fifties(spark, d).select(F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(f"{path}/in")
    return readers.json_document(spark, f"{path}/in", "doc_id long, text string, lang string")


@query("K8_report", "SELECT 'lang' AS section, lang AS key, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def k8(spark, d):
    path = scratch.folder(spark, "report")
    docs = table(spark, d, "documents")
    store.write_report({c: docs.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for c in ("lang", "source")}, path)
    return spark.read.schema("key string, n long, section string").json([f"{path}/lang", f"{path}/source"]).select(F.regexp_extract(F.col("_metadata.file_path"), "/([a-z]+)/[^/]*$", 1).alias("section"), "key", "n")


@query("ST4_feedback_lines", "SELECT event_id, user_id, event_type AS summary, value AS rating FROM events")
def st4(spark, d):
    """ST4, ST5: a stream of answers' ratings appended as JSON lines, read as those are."""
    path = scratch.folder(spark, "feedback")
    rows = spark.readStream.schema(streams.EVENT).option("pathGlobFilter", "events*.parquet").parquet(d)
    streams.append(rows.select("event_id", "user_id", F.col("event_type").alias("summary"), F.col("value").alias("rating")), f"{path}/lines", f"{path}/checkpoint").awaitTermination()
    return readers.json_lines(spark, f"{path}/lines", "event_id long, user_id long, summary string, rating double", strict=True)


# --- shown results ---------------------------------------------------------------------------

KIND = "CASE lang WHEN 'de' THEN 'starplan_timetable' WHEN 'es' THEN 'campus_pdfs' WHEN 'fr' THEN 'asta' ELSE 'campus_website' END"


@query(
    "T39_service_results",
    f"WITH d AS (SELECT doc_id, text, lang, {KIND} AS source, CASE WHEN lang = 'en' THEN '' ELSE source END AS title FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), "
    "o AS (SELECT doc_id, title AS t, CASE lang WHEN 'de' THEN 'timetable' WHEN 'es' THEN 'pdf' WHEN 'fr' THEN 'asta' ELSE 'website' END AS type, CASE lang WHEN 'de' THEN concat_ws(' — ', nullif(title, ''), 'Montag', '08:00') WHEN 'es' THEN text ELSE trim(title || ': ' || substr(text, 1, 2000)) END AS shown FROM d) "
    "SELECT doc_id, type, shown AS text, coalesce(nullif(t, ''), string_split(substr(shown, 1, 60), chr(10))[1]) AS title FROM o",
)
def t39(spark, d):
    docs = table(spark, d, "documents").where("text is not null and lang is not null")
    rows = docs.select("doc_id", "text", F.col("text").alias("content"), F.expr(KIND).alias("source"), F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("title"), F.when(F.col("lang") == "de", "Montag").alias("day"), F.when(F.col("lang") == "de", "08:00").alias("time"))
    return present.service_results(rows).select("doc_id", "type", "text", "title")


@query("T38_configured_text", "SELECT doc_id, CASE WHEN lang = 'de' AND source IS NOT NULL THEN source || ' | Montag | Aula' WHEN lang = 'de' THEN 'Montag | Aula' ELSE coalesce(text, '') END AS shown FROM documents")
def t38(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("lang") == "de", "timetable").otherwise("webpage").alias("type"), F.create_map(F.lit("title"), "source", F.lit("day"), F.lit("Montag"), F.lit("time"), F.lit(""), F.lit("location"), F.lit("Aula")).alias("metadata"))
    return rows.select("doc_id", present.configured_text(rows).alias("shown"))


@query(
    "T46_indexed_texts",
    "SELECT doc_id, concat_ws(' ', nullif(source, ''), nullif(substr(text, 1, 2000), '')) AS chunks, nullif(source, '') AS pages, concat_ws(' ', nullif(lang, ''), 'Mo', '8') AS timetable, concat_ws(' ', nullif(source, ''), 'Mo', '8') AS semester FROM documents WHERE source IS NOT NULL",
)
def t46(spark, d):
    rows = table(spark, d, "documents").where("source is not null").select("doc_id", F.col("source").alias("title"), "text", F.col("lang").alias("program"), F.lit("Mo").alias("day"), F.lit("8").alias("time"))
    return rows.select("doc_id", *[F.nullif(present.indexed_text(rows, k), F.lit("")).alias(k) for k in present.INDEXED])
