"""Core operators against short specifications in plain Python, on hand-written rows."""

import json
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodex.functions import dom, splitters
from lodex.functions import text as T
from lodex.functions.constants import STOPWORDS
from lodex.functions.encode import encode, encode_query, hashed_embedding
from lodex.operators import chunk, crawl, fuzzy, present, quality, rank, retrieve, serve, timetable
from lodex.plans.ingest import Pipeline
from lodex.plans.search import SearchEngine, ServiceSearch
from lodex.sources import readers
from lodex.sources.readers import Config
from lodex.sources.store import Store, append_feedback, coalesced, seed, write_lines, write_report
from lodex.streaming import feedback as streams


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["Der  Prüfungs-Plan\n für Informatik", None, "", "A B ﬁnal Ⅳ ２", "x", "die die und oder", "Ça va: Ünïcode ß", "eins zwei eins zwei drei"]


def norm(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", (t or "").lower())).strip()


def toks(t):
    return [w for w in re.findall(r"[a-zA-Z0-9äöüÄÖÜß]{2,}", norm(t)) if w not in STOPWORDS]


def test_normalize_and_tokenize(spark):
    assert column(spark, TEXTS, lambda x: T.normalize(x, with_nfkc=True)) == [norm(t) for t in TEXTS]
    plain = [t for t in TEXTS if t is None or "ﬁ" not in t]
    assert column(spark, plain, T.tokenize) == [toks(t) for t in plain]


def test_phrases_and_ngrams(spark):
    quoted = ['a "B  c" d "" " " "e"', '"x" und "Y z"', "ohne"]
    assert column(spark, quoted, T.phrases) == [[norm(p) for p in re.findall('"([^"]+)"', q) if p.strip()] for q in quoted]
    assert column(spark, ["eins zwei eins zwei drei", "eins"], lambda x: T.ngrams(T.tokenize(x), 2)) == [["eins zwei", "zwei eins", "zwei drei"], []]


def spec_lexical_f(q, text, url):
    q_t, h = toks(q), norm(text) + " " + norm(url)
    if not q_t:
        return 0.0
    long = [t for t in q_t if len(t) >= 6]
    s = 0.7 * len({t for t in q_t if t in h}) / len(q_t) + (0.2 if len(norm(q)) >= 6 and norm(q) in h else 0) + (0.1 * sum(t in h for t in long) / len(long) if long else 0)
    return max(0.0, min(1.0, s))


@pytest.mark.parametrize("q", ["Informatik Plan", "die und", "Plan Plan Prüfung", '"genau das" Plan', "zwei eins", ""])
def test_lexical_and_strict(spark, q):
    rows = [("Der Plan der Prüfung", "https://x/plan"), ("Informatik Plan genau das", ""), ("", ""), ("eins zwei eins", "u")]
    df = spark.createDataFrame(rows, "text string, url string").withColumn("q", F.lit(q))
    wide = T.held(df, n=T.normalize("q"), t=T.tokenize("q"), p=T.phrases("q"), h=T.haystack("text", "url"))
    got = wide.select(T.lexical_f(F.col("n"), F.col("t"), F.col("h")).alias("s"), T.strict_match(F.col("t"), F.col("p"), F.col("h")).alias("m")).collect()
    for r, (text, url) in zip(got, rows):
        h, core = norm(text) + " " + norm(url), [t for t in toks(q) if len(t) >= 4]
        assert abs(r.s - spec_lexical_f(q, text, url)) < 1e-12
        assert r.m == (all(norm(p) in h for p in re.findall('"([^"]+)"', q) if p.strip()) and (not core or any(t in h for t in core)))


def test_expansion_and_variants(spark):
    assert column(spark, ["KI lernen"], T.expand_f) == ["KI lernen kuenstliche intelligenz ai informatik in"]
    assert column(spark, ["Mensa heute", "nichts"], T.expand_b) == ["Mensa heute speiseplan essen cafeteria", "nichts"]
    assert column(spark, ["mensa plan", "x"], T.variants) == [["mensa plan", "plan mensa", "mensa plan speiseplan essen cafeteria"], ["x"]]


def test_fuzzy_correction(spark):
    vocab = fuzzy.vocabulary(spark, {"informatik": ["computer science"], "physik": []})
    q = spark.createDataFrame([(1, "Informatk, der fysik!"), (2, "science"), (3, "xyzzyq und")], "query_id int, query string")
    got = {r.query_id: (r.corrected, r.was_corrected) for r in fuzzy.correct(q, vocab).collect()}
    assert got == {1: ("Informatik, der physik!", True), 2: ("science", False), 3: ("xyzzyq und", False)}


def test_cleaning(spark):
    assert column(spark, ["Teilen Urlaub Schließen x"], T.clean) == ["aub x"]
    assert column(spark, ["Teilen Urlaub Schließen x"], lambda x: T.clean(x, whole_words=True)) == ["Urlaub x"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!?", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_pieces_are_short_and_complete(text, size, overlap):
    bare = lambda t: re.sub(r"\s", "", t)
    assert all(0 < len(p) <= size for p in splitters.recursive(text, size, overlap))
    assert "".join(map(bare, splitters.recursive(text, size, 0))) == bare(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=3000))
def test_windows_and_sentences_cover(text):
    flat = re.sub(r"\s+", " ", text).strip()
    pieces = splitters.windows(text, 200, 30)
    assert (not flat and not pieces) or all(len(p) <= 200 for p in pieces)
    assert all(len(p) <= 801 and (len(text) <= 800 or p == p.strip()) for p in splitters.sentences(text))


def test_context_header_and_chunks(spark):
    docs = spark.createDataFrame(
        [("u1", "Titel", "TITEL", "", [("Allgemein", "kurz"), ("Neu", "x" * 900), ("leer", " ")], "webpage", {}), ("u2", "T", "H", "nur Inhalt", None, None, None), ("u3", "", "", "Mo 8:00", [], "timetable", {"a": "b"}), ("u4", "t", "h", " ", [], "webpage", None)],
        "url string, title string, h1 string, content string, sections array<struct<heading:string,text:string>>, type string, metadata map<string,string>",
    )
    rows = {(r.url, r.section_index, r.chunk_index): r.text for r in chunk.chunk_documents(docs, split=chunk.stride).collect()}
    assert rows == {("u1", 0, 0): "Seite: Titel\n\nkurz", ("u1", 1, 0): "Seite: Titel\nAbschnitt: Neu\n\n" + "x" * 800, ("u1", 1, 1): "Seite: Titel\nAbschnitt: Neu\n\n" + "x" * 220, ("u2", 0, 0): "Seite: T\nÜberschrift: H\n\nnur Inhalt", ("u3", 0, 0): "Mo 8:00"}


HTML = """<html><head><title>A &amp; B</title><script type="application/ld+json">{"@type":"Event","name":"Tag der offenen Tür","description":"Ein langer Tag für alle","location":{"name":"Aula"}}</script></head><body><nav>menu</nav>
<main><h1>Kopf</h1><p>Ein Absatz mit genug Zeichen für die Grenze.<p>Noch ein Absatz, der nicht geschlossen ist hier.<h2>Teil</h2><div class="share-box"><p>Teilen Sie das bitte mit allen, die Sie kennen.</p></div><p>Text im zweiten Teil, lang genug auch er.</p><p>kurz</p></main></body></html>"""


def test_page_records(spark):
    r = dom.sections_of(HTML)
    assert (r["title"], r["h1"], r["headings"]) == ("A & B", "Kopf", ["Kopf", "Teil"])
    assert [s["heading"] for s in r["sections"]] == ["Kopf", "Teil", "Tag der offenen Tür"]
    assert "Teilen" not in r["content"] and "menu" not in r["content"]
    assert dom.sections_of(None)["sections"] == []
    assert [x["heading"] for x in dom.sections_of("<h1>A</h1><h2>B</h2><p>" + "wort " * 9, empty_headings=True)["sections"]] == ["A", "B"]
    assert [r and r.title for r in column(spark, [HTML, "<p>kurz"], lambda x: dom.simple_record(x, least=50))] == ["Kopf", None]
    html = '<a href="/a.pdf">x</a><a class=b href="b.pdf"></a><a href="/a.pdf"></a><a data-href="c.pdf"><a href="//o.example/d.pdf"><a href="HTTP://p.example/e.PDF">'
    for base, folder in (("https://h.example/d/", "https://h.example/d/"), ("https://h.example/d/x?y=/z#/w", "https://h.example/d/"), ("https://h.example", "https://h.example/"), ("https://h.example?q=1", "https://h.example/")):
        got = spark.range(1).select(dom.pdf_links(F.lit(html), F.lit(base)).alias("l")).first().l
        assert got == ["https://h.example/a.pdf", f"{folder}b.pdf", "https://o.example/d.pdf", "HTTP://p.example/e.PDF", f"{folder}c.pdf"], base
    tables = ["<table><tr><th>a<th> <b>b</b></tr><tr><td> 1 </td></tr></table><table><tr><td>no</td></tr></table>", "none", None]
    got = spark.createDataFrame([(t,) for t in tables], "h string").select(dom.table_rows(F.col("h")).alias("r")).collect()
    assert [r.r for r in got] == [[["a", "b"], ["1"]], [], None]


def test_links(spark):
    links = ["/a?x=1#y", "https://h.example/b", "https://other.example/", "c.html", "mailto:x@y", "#top", "/d.pdf", "//h.example/e"]
    assert column(spark, links, lambda x: dom.absolute(F.lit("https://h.example/dir/page?q=1"), x)) == ["https://h.example/a", "https://h.example/b", None, "https://h.example/dir/c.html", None, None, None, "https://h.example/e"]


ICAL = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Mathe\r\n  1\r\nDTSTART;TZID=Europe/Berlin:20240414T090000\r\nDTEND:20240414T103000\r\nLOCATION:G2\r\nORGANIZER:mailto:a@b\r\nDESCRIPTION:lang\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20240415T080000\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"


def test_calendars(spark):
    df = spark.createDataFrame([("IN", 7, ICAL)], "program string, pg_id int, ical string")
    rows = timetable.parse_ical(df).orderBy("n").collect()
    assert (rows[0].title, rows[0].day, rows[0].time, rows[0].instructor) == ("Mathe 1", "Sonntag", "09:00 - 10:30", "a@b")
    assert rows[0].full_text == "Studiengang: IN | Tag: Sonntag | Zeit: 09:00 - 10:30 | Raum: G2 | Veranstaltung: Mathe 1 | lang"
    assert (rows[1].title, rows[1].time) == ("", "08:00") and timetable.parse_ical(df, drop_untitled=True).count() == 1
    assert readers.calendars(df, "https://b").where("type = 'timetable' and metadata['day'] = 'Sonntag'").count() == 1


def test_lectures(spark):
    raw = [("1", "IN", "Montag", "08:00", i, f) for i, f in enumerate(["Montag", "Mathematik 1 (IN-1234)", "M. Hermann", "IN-B S1", "G2 023", "kurz", "Powered by x", "M. Zweite"])]
    raw += [("1", "IN", "Dienstag", "17:00", 9, "einzeln hier"), ("1", "IN", "", "09:00", 10, "ohne Tag hier")]
    s = timetable.slots(spark.createDataFrame(raw, "program_id string, program string, day string, time string, pos int, info string"))
    rows = timetable.lectures(s).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.name, r.lecturer, r.group, r.room) == ("Mathematik 1 (IN-1234)", "M. Zweite", "IN-B S1", "G2 023")
    assert r.full_text == "Studiengang: IN | Vorlesung: Mathematik 1 (IN-1234) | Tag: Montag | Zeit: 08:00 | Raum: G2 023 | Dozent: M. Zweite | Gruppe: IN-B S1"


def test_rrf_key_of_hits_without_url(spark):
    hits = [(0, 0, "c", 1, 1.0, "", 1), (0, 0, "c", 2, 1.0, "", 2), (0, 1, "c", 1, 1.0, "u", 3), (0, 1, "d", 1, 0.5, "u", 4), (0, 1, "e", 1, 0.04, "u", 5)]
    df = spark.createDataFrame(hits, "query_id int, variant int, collection string, rank int, weight double, url string, id long")
    got = {r.key: (r.score, r.hit.id) for r in retrieve.accumulate(df).collect()}
    assert got == {"1": (round(1 / 61, 9), 1), "2": (round(1 / 62, 9), 2), "u": (round(1.5 / 61, 9), 3)}
    assert retrieve.accumulate(df, legacy_url_key=True).count() == 2
    twice = df.unionByName(df.where("id = 3").withColumn("rank", F.lit(9)).withColumn("id", F.lit(6).cast("long")))
    assert {r.key: r.score for r in retrieve.accumulate(twice, one_per_url_per_list=True).collect()}["u"] == round(1.5 / 61, 9)


def test_boosts_read_the_source(spark):
    rows = [(1, "prof müller", 1, 0.9, "u", "Prof. Müller", "x", "webpage", "campus"), (1, "prof müller", 2, 0.1, "v", "t", "x", "webpage", "")]
    df = spark.createDataFrame(rows, "query_id int, query string, id long, score double, url string, title string, text string, type string, source string")
    clicks = spark.createDataFrame([("prof müller", "v", 1, 9)], "query string, url string, short_clicks int, long_clicks int")
    got = {r.id: r.score for r in rank.boost_and_rank_b(df, clicks).collect()}
    lex = 0.55 * 1 + 0.1 * 1 + 0.25 * 0  # "prof. müller" holds both words, not the phrase
    assert abs(got[1] - (0.7 + 0.3 * lex) * 1.3 * 1.3 * 1.1) < 1e-6 and abs(got[2] - 0.2) < 1e-9


def test_pages_clamp(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(1, 24)], "query_id int, id int, rank int")
    assert [r.id for r in rank.page_b(df, 3).orderBy("rank").collect()] == [21, 22, 23] == [r.id for r in rank.page_b(df, 77).orderBy("rank").collect()]
    assert rank.page_b(df, 0).count() == 10 and rank.page_b(df.limit(0), 1).count() == 0


def test_pair_scorer_runs_on_the_pool_only(spark):
    df = spark.createDataFrame([(1, "q", i, 1.0 / i, "t", f"text {i}", i) for i in range(1, 6)], "query_id int, query string, id int, score double, title string, text string, rank int")
    out = rank.rerank_f(df, rank.pair_scorer(lambda pairs: [float(p[1][-1]) for p in pairs]), pool=3).orderBy("rank").collect()
    assert [r.id for r in out] == [3, 2, 1, 4, 5] and out[3].ce is None


def test_robots_modes(spark):
    urls = spark.createDataFrame([("https://a.example/x/1",), ("https://a.example/y",), ("https://b.example/z",), ("https://b.example",)], "url string")
    rules = crawl.robots_rules(spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /x\nAllow: /x/1\nSitemap: https://a.example/s.xml"), ("b.example", "User-agent: *\nAllow: /z")], "host string, text string"))
    get = lambda **o: sorted(r.url for r in crawl.allowed(urls, rules, **o).collect())
    assert get() == ["https://a.example/y", "https://b.example", "https://b.example/z"]
    assert get(allow_list=True) == ["https://b.example/z"]
    assert [r.prefix for r in rules.where("kind = 'sitemap'").collect()] == ["https://a.example/s.xml"]


def test_results_by_kind(spark):
    rows = [(1, "starplan_timetable", "", "Mathe", "Mo", "8:00", "", ""), (2, "campus", "", "T", None, None, "c", ""), (3, "", "pdf", "", None, None, "inhalt", ""), (4, "", "", "", None, None, "erste\nzweite", "Kopf")]
    df = spark.createDataFrame(rows, "id int, source string, type string, title string, day string, time string, content string, section_heading string")
    got = {r.id: (r.type, r.text, r.title) for r in present.service_results(df).collect()}
    assert got == {1: ("timetable", "Mathe — Mo — 8:00", "Mathe"), 2: ("website", "T: c", "T"), 3: ("pdf", "inhalt", "inhalt"), 4: ("webpage", "Kopf: erste\nzweite", "Kopf: erste")}


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "a", ["x"], None, None), (2, "a", None, ["Wort"], "pdf"), (3, "b", None, None, None), (4, "b", None, None, None)], "query_id int, category string, expected_url_contains array<string>, expected_keywords array<string>, expected_type string")
    res = spark.createDataFrame([(1, 4, "x", "", ""), (2, 1, "u", "ein wort", "web"), (2, 2, "u", "ein WORT", "pdf"), (3, 3, None, None, None)], "query_id int, rank int, url string, text string, type string")
    out = quality.evaluate(cases, res)
    assert {r.query_id: r.passed for r in out.collect()} == {1: False, 2: True, 3: True, 4: False}
    assert {r.category: (r.passed, r.cases) for r in quality.pass_rates(out).collect()} == {"a": (1, 2), "b": (1, 2), None: (2, 4)}


def test_empty_and_title_only_fields_differ(spark):
    df = spark.createDataFrame([("", "t", "x"), (None, None, None)], "title string, modul string, text string")
    assert [(r.title, r.content) for r in coalesced(df, "s").collect()] == [("t", "x"), ("Unbenannt", "")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "texte").mkdir()
    topics = {"mathe-plan": "Mathematik Vorlesung Stundenplan Montag im Hörsaal mit Übungen und Klausur.", "mensa_heute": "Die Mensa hat heute einen Speiseplan mit Suppe und Salat für alle Gäste.", "bibliothek": "Die Bibliothek ist geöffnet und hat viele Bücher über Informatik und Physik."}
    for name, text in topics.items():
        (root / "texte" / f"{name}.txt").write_text(text * 3, encoding="utf-8")
    (root / "cal.jsonl").write_text(json.dumps({"program": "IN", "pg_id": 7, "ical": ICAL}) + "\n\n{broken\n", encoding="utf-8")
    (root / "pages.jsonl").write_text(json.dumps({"url": "https://h.example/a", "html": HTML}) + "\n", encoding="utf-8")
    config = Config.of({"name": "p", "sources": [
        {"name": "texte", "type": "folder", "collection": "campus_search", "search_weight": 0.5, "path": str(root / "texte")},
        {"name": "plan", "type": "starplan", "collection": "starplan_timetable", "result_type": "timetable", "search_weight": 0.1, "calendars": str(root / "cal.jsonl")},
        {"name": "web", "type": "website", "collection": "campus_website", "result_type": "website", "search_weight": 0.2, "pages_jsonl": str(root / "pages.jsonl"), "chunk_size": 300, "chunk_overlap": 30},
    ]})
    store = Store(spark, f"file://{root}/store")
    embed = hashed_embedding(64)
    return store, config, embed, Pipeline(spark, store, config, embed, 64).run()


def test_ingest_and_search(spark, corpus):
    store, config, embed, done = corpus
    assert done["texte"] == 3 and done["plan"] == 2 and done["web"] >= 3
    assert store.names() == ["campus_search", "campus_website", "starplan_timetable"]
    assert {r.collection: r.points for r in store.info().collect()}[None] == sum(done.values())
    engine = SearchEngine(spark, store, config, embed)
    top = engine.search("Speiseplan Mensaa").orderBy("rank").first()
    assert "mensa" in top.url and top.score >= 0.34
    assert engine.prepare("Informatk")[0] == "Informatik"
    service = ServiceSearch(spark, store, embed)
    page = service.page("Bibliothek Bücher").orderBy("rank").collect()
    assert any("bibliothek" in r.url for r in page[:3]) and len({r.url for r in page}) == len(page)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    points = spark.createDataFrame([(1, "a", [0.1, 0.2]), (2, "b", [0.3, 0.4])], "id long, text string, embedding array<float>")
    assert store.recreate("c", points, 2) == 2
    assert store.upsert("c", points.where("id = 2").withColumn("text", F.lit("neu"))) == 2
    assert {r.id: r.text for r in store.read("c").collect()} == {1: "a", 2: "neu"}
    with pytest.raises(Exception, match="components"):
        store.recreate("d", points, 3)
    assert store.migrate("c", "e") == 2 and set(store.read("e").columns) >= {"sparse_indices", "sparse_values"}
    store.drop("e")
    assert not store.exists("e") and seed(spark, [("u", "t", "x")]).first().id == 5000
    write_lines(points, f"{tmp_path}/lines")
    write_report({"counts": points.groupBy().count(), "points": points}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/lines").count() == spark.read.json(f"{tmp_path}/report/points").count() == 2
    append_feedback(spark, f"{tmp_path}/f", "p", "q", "s", 1, "m")
    append_feedback(spark, f"{tmp_path}/f", "p", "q2", "s", 0, "m")
    assert spark.read.json(f"{tmp_path}/f").count() == 2


def test_encoders(spark):
    embed = hashed_embedding(32)
    df = spark.createDataFrame([("ein text",), (None,)], "t string").select(encode(F.col("t"), embed).alias("v"))
    rows = [r.v for r in df.collect()]
    assert len(rows[0]) == 32 and rows[0] == pytest.approx(encode_query("ein text", embed)) and set(rows[1]) == {0.0}


def test_stream_merge_equals_batch(spark, sf, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    events = streams.read_events(spark, f"{sf}/events*.parquet")
    rows = events.select(F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("query"), F.get_json_object("props", "$.k").alias("url"), F.when(F.col("event_type") == "click", "short_click").otherwise("long_click").alias("type"))
    for _ in range(2):  # the second run finds nothing new
        streams.count_clicks(rows, store, "clicks", f"{tmp_path}/cp").awaitTermination()
    got = store.read("clicks").agg(F.sum("short_clicks").alias("s"), F.sum("long_clicks").alias("l")).first()
    whole = spark.read.parquet(f"{sf}/events.parquet")
    assert (got.s, got.l) == (whole.where("event_type = 'click'").count(), whole.where("event_type <> 'click'").count())


def test_core_does_not_need_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodex.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.split()[-1]) > 60


def test_tokens_are_of_compatible_characters(spark):
    """Ligatures, full-width letters and no-break spaces, as T1, T2, T3, Q1 and the index see them."""
    from lodex.functions import text as T
    from lodex.operators.retrieve import TermIndex

    raw = 'ﬁnale Ｗｉｄｅ ﬂow "Oﬃce  Ｈｏｕｒｓ"'
    df = spark.createDataFrame([(1, raw)], "id long, text string")
    got = df.select(T.normalize("text").alias("n"), T.tokenize("text").alias("t"), T.phrases("text").alias("p"), T.haystack("text", F.lit("")).alias("h")).first()
    assert got.n == 'finale wide flow "office hours"' and got.p == ["office hours"] and got.t == ["finale", "wide", "flow", "office", "hours"] and got.h.startswith("finale wide")
    hits = TermIndex.build(df).top(spark.createDataFrame([("q", "finale flow")], "query_id string, text string"), 5).collect()
    assert [h.id for h in hits] == [1]


@pytest.mark.parametrize("split", ["windows", "sentences"])
@pytest.mark.parametrize("overlap", [30, 40, 100])
def test_splitters_always_get_on(split, overlap):
    from lodex.functions import splitters

    text = "word and more words. " * 20
    pieces = list(getattr(splitters, split)(text, 40, overlap))
    assert 0 < len(pieces) <= len(text) and all(p in text for p in pieces)


def test_hashed_terms_and_sparse_vectors(spark):
    from lodex.sources import store

    rows = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r for r in store.with_hashed_sparse(rows).collect()}
    assert len(got[1].sparse_indices) == 2 and sorted(got[1].sparse_values) == [1.0, 2.0] and got[1].sparse_indices == sorted(got[1].sparse_indices)
    assert got[2].sparse_indices == got[3].sparse_indices == [] and got[1].text == "aa bb aa"


def test_store_pointer_changes_in_one_step(spark, tmp_path):
    from lodex.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "beta", [0.0, 1.0])], "id long, text string, embedding array<double>")
    assert not store.exists("c") and store.recreate("c", rows) == 2 and store.dimension("c") == 2
    open_ = store.read("c")
    terms = store.terms("c")
    assert terms.n == 2 and store.terms("c").path == terms.path
    assert store.recreate("c", rows.where("id = 1")) == 1
    assert open_.count() == 2 and store.read("c").count() == 1 and store.terms("c").n == 1
    store.recreate("c", rows)
    store.recreate("c", rows)
    assert len(store._pointers("c")) == 2 and store.names() == ["c"] and store.read("c").count() == 2


def test_collections_without_text_or_vectors(spark, tmp_path):
    from lodex.plans.search import Collection
    from lodex.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    store.recreate("dense", spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>"))
    store.recreate("sparse", spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string"))
    store.recreate("none", spark.createDataFrame([(1, "x")], "id long, url string"))
    queries = spark.createDataFrame([("q", "alpha", [0.0, 1.0])], "query_id string, text string, qvec array<double>")
    assert [r.id for r in Collection.of(store, "dense").hybrid(queries, 1).collect()] == [2]
    assert [r.id for r in Collection.of(store, "sparse").hybrid(queries, 1).collect()] == [1]
    assert Collection.of(store, "none").hybrid(queries, 1).count() == 0


def test_index_reads_only_wanted_terms(spark):
    from lodex.operators.retrieve import TermIndex

    own = TermIndex.build(spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, text string"))
    plan = own.top(spark.createDataFrame([("q", "word7")], "query_id string, text string"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,word7)" in plan or "In(term" in plan


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    from lodex.operators import retrieve

    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    queries = points.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    whole = sorted(map(str, retrieve.dense_top(points, queries, 3).collect()))
    monkeypatch.setattr(retrieve.query_blocks, "__defaults__", (4,))
    assert sorted(map(str, retrieve.dense_top(points, queries, 3).collect())) == whole


def test_result_cache_gives_up_the_oldest():
    cache = serve.ResultCache(2)
    made = []
    for key in "ababcab":
        cache.get(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "c", "a", "b"] and len(cache) == 2


def test_providers_and_models():
    def fails():
        raise OSError

    assert [serve.resolve_provider(*x) for x in [("none", fails), ("auto", list), ("auto", fails, "k"), ("auto", fails)]] == ["none", "ollama", "openai", "none"]
    assert serve.models("openai", lambda: ["gpt-b", "x", "gpt-a", "gpt-a"], "own") == {"models": ["gpt-a", "gpt-b"], "provider": "openai"}
    assert serve.models("ollama", fails, "own") == {"models": ["own"], "provider": "ollama", "fallback": True}
    assert serve.models("none", fails, "own")["models"] == [] and serve.models("openai", lambda: ["x"], "own")["models"] == ["gpt-4o-mini"]


def test_fetch_tries_again():
    pauses, answers = [], [OSError(), OSError(), "text"]

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert serve.fetched(get, "u", wait=pauses.append) == "text" and pauses == [1.0, 1.5]
    answers[:] = [OSError()] * 3
    assert serve.fetched(get, "u", wait=pauses.append) is None


def test_groups_of_jobs(spark):
    out = serve.run_groups(spark, {"a": [lambda s: s.range(3).count(), lambda s: s.range(4).count()], "b": [lambda s: s.range(5).count()]})
    assert out == {"a": [3, 4], "b": [5]}


def test_folder_with_extractors(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "one_file.txt").write_text("t" * 60)
    (tmp_path / "below" / "two-file.pdf").write_bytes(b"%" + b"p" * 200)
    (tmp_path / "bad.pdf").write_bytes(b"x")
    (tmp_path / "none.docx").write_bytes(b"d" * 99)

    def strict(data):
        if data[:1] != b"%":
            raise ValueError
        return data[1:].decode()

    rows = readers.folder(spark, str(tmp_path), extractors={"pdf": readers.cascade([lambda b: "short", strict])}).collect()
    assert {(r.title, r.content) for r in rows} == {("one file", "t" * 60), ("two file", "p" * 200)}


def test_timetable_service(spark):
    def get(url):
        if "getogs" in url:
            return '[{"id": 1}, {"id": 2}]'
        if "getPgsExt" in url:
            return '[[{"id": 7, "shortname": "INF"}]]' if url.endswith("og=1") else '[[{"id": 7, "shortname": "INF"}, {"id": 8, "shortname": "MB"}]]'
        if url.endswith("=8"):
            raise OSError
        return "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Logik\nDTSTART:20240108T080000\nDTEND:20240108T093000\nLOCATION:A1\nEND:VEVENT\nEND:VCALENDAR"

    rows = readers.timetable_source(spark, get, "https://t.example/splan/", tries=1).collect()
    assert [(r.title, r.type, r.url) for r in rows] == [("Logik", "timetable", "https://t.example/splan/ical?lan=de&puid=50&type=pg&pgid=7")]


def test_title_case(spark):
    got = spark.createDataFrame([("o'neil-SMITH 3d",), ("",), (None,)], "q string").select(T.title_case(F.col("q"))).collect()
    assert [r[0] for r in got] == ["O'Neil-Smith 3D", "", None]


def test_lexical_scores_look_words_up(spark):
    rng = random.Random(4)
    words = ["plan", "planung", "aa", "ab", "x.y", "größe", "prüfung", "in", "straße", "abab"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(120)]
    df = T.held(spark.createDataFrame(rows, "q string, text string"), n=T.normalize("q"), t=T.tokenize("q"), h=T.haystack("text", F.lit("u")))
    got = df.select("n", "t", "h", T.lexical_b(F.col("n"), F.col("t"), F.col("h")).alias("s")).collect()
    for n, t, h, s in got:
        grams = [{" ".join(g) for g in zip(*[t[i:] for i in range(k)])} for k in (1, 2, 3)]
        long = [x for x in t if len(x) >= 6]
        share = lambda a, b: a / b if b else 0.0
        want = 0.55 * share(sum(g in h for g in grams[0]), len(t)) + 0.25 * share(sum(g in h for g in grams[1]), len(grams[1])) + 0.15 * share(sum(g in h for g in grams[2]), len(grams[2]))
        want += (0.3 if len(n) >= 6 and n in h else 0) + 0.1 * share(sum(x in h for x in long), len(long))
        assert abs(s - (min(1.0, want) if t else 0.0)) < 1e-12
    assert "ArrowEvalPython" in df.select(T.lexical_b(F.col("n"), F.col("t"), F.col("h")))._jdf.queryExecution().executedPlan().toString()


def test_capitals_of_single_letters(spark):
    assert column(spark, ["Straße größe", ""], T.upper_signs) == ["STRAßE GRÖßE", ""]


def test_all_windows_are_counted(spark, tmp_path):
    from lodex.streaming import feedback as streams

    # the last windows are within two hours of the newest event, and one event is a day late
    at = ["2024-01-02 10:05:00", "2024-01-02 10:59:59", "2024-01-02 11:00:00", "2024-01-01 09:00:00"]
    for i, ts in enumerate(at):
        spark.createDataFrame([(ts, "click")], "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((str(r.start), r.n) for r in streams.all_window_counts(stream, f"file://{tmp_path}/out").collect())
    assert got == [("2024-01-01 09:00:00", 1), ("2024-01-02 10:00:00", 2), ("2024-01-02 11:00:00", 1)]


def test_texts_of_hits_move_once(spark, sf):
    """A hit's document and its query's text are shuffled to the document's task; steps by query come when texts are gone."""
    from lodex.plans import search_queries as s

    plans = {f.__name__: f(spark, sf)._jdf.queryExecution().executedPlan().toString() for f in (s.q7, s.q2, s.q3, s.flagship)}
    for name, plan in plans.items():
        lines = plan.splitlines()
        moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert not any("Window" in line and re.search(r"\btext#|\bquery#|_hay#", line) for line in lines), name
        assert sum(bool(re.search(r"[\[ ]text#\d+[,\]]", line)) for line in moved) <= 1, name
        assert sum(bool(re.search(r"[\[ ]query#\d+[,\]]", line)) for line in moved) <= (2 if name == "q7" else 1), name


def test_what_searches_shuffled_goes_when_hits_are_written(spark, tmp_path):
    from lodex.scratch import written

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    out = written(spark.range(100).repartition(3, "id").groupBy(F.col("id") % 7).count(), "test")
    assert out.count() == 7 and spark.conf.get(name, None) == before


def test_substrings_of_words_and_neighbours_as_plain_search_finds_them():
    rng = random.Random(5)
    for _ in range(300):
        hay = " ".join("".join(rng.choices("abä-/.", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 30)))
        made = T.Haystack(hay)
        tokens = ["".join(rng.choices("abä", k=rng.randint(2, 4))) for _ in range(40)]
        for a, b in zip(tokens, tokens[1:]):
            assert made.has(a) == (a in hay) and made.has_two(a, b) == (f"{a} {b}" in hay)


def test_signs_beyond_latin_letters_are_told_as_the_pattern_tells_them(spark):
    signs = [chr(i) for i in (*range(1, 0x180), 0x2009, 0xFB01, 0x1F600)]
    df = spark.createDataFrame([(s,) for s in [*signs, *(f"aé{s}ß " for s in signs), "", None]], "s string")
    wrong = df.where(~T.other_signs(F.col("s")).eqNullSafe(F.col("s").rlike(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")))
    assert wrong.collect() == []
    assert "RLIKE" not in df.select(T.nfkc("s"))._jdf.queryExecution().optimizedPlan().toString()


def test_an_evaluation_moves_no_texts_beyond_its_first_hits(spark, sf):
    from lodex.plans import search_queries as s

    def found(first):
        return {r.query_id: r.n for r in s.hits(spark, sf, first=first).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}

    few, every = found(3), found(None)
    assert set(few) == set(every) and max(every.values()) > 3 and all(few[q] == min(3, every[q]) for q in every)
