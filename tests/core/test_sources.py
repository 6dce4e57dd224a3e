"""Loaders over files that Spark writes, sitemaps and JSON-LD with odd contents, walks that were broken off."""

import pytest
from pyspark.sql import functions as F

from lodex.deploy import ship
from lodex.functions import dom
from lodex.functions.splitters import recursive, with_pieces
from lodex.operators import crawl
from lodex.sources import readers


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def test_a_file_of_several_lines_is_one_document(spark, tmp_path):
    (tmp_path / "a_b.txt").write_text("line one\n\nline two " + "x" * 60)
    (tmp_path / "short.md").write_text("too short")
    got = readers.folder(spark, str(tmp_path)).collect()
    assert [(r.title, r.content) for r in got] == [("a b", "line one\n\nline two " + "x" * 60)]


def test_a_walk_goes_on_where_it_was_broken_off(spark, tmp_path):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(9)] + [("p9", "p0"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("p0",), ("p0",)], "url string")
    path = f"file://{tmp_path}/walk"
    assert crawl.walk(seeds, links, path, 3).count() == 4
    (tmp_path / "walk" / "depth=3" / "_SUCCESS").unlink()  # the last round was not finished
    whole = {r.url: r.depth for r in crawl.walk(seeds, links, path).collect()}
    assert whole == {f"p{i}": i for i in range(10)}
    assert crawl.bfs(seeds, links, None, 3).count() == 3
    assert crawl.bfs(spark.createDataFrame([("q",)], "url string"), links).count() == 1


def test_sitemaps_nested_broken_and_in_circles(spark):
    rows = [
        ("r.xml", "<sitemapindex xmlns='http://x'><sitemap><loc> a.xml </loc></sitemap><sitemap><loc>r.xml</loc></sitemap></sitemapindex>"),
        ("a.xml", "<?xml version='1.0'?><urlset><url><loc>http://h/1?a=1&amp;b=2</loc><lastmod>2</lastmod></url><url><loc>http://h/2</loc></url><url><loc>B.XML</loc></url></urlset>"),
        ("B.XML", "no xml <loc> http://h/3 </loc>"),
        ("lost.xml", "<urlset><url><loc>http://h/4</loc></url></urlset>"),
        ("null.xml", None),
    ]
    maps = spark.createDataFrame(rows, "sitemap string, xml string")
    roots = spark.createDataFrame([("r.xml",), ("null.xml",), ("none.xml",)], "sitemap string")
    assert sorted(r.url for r in crawl.sitemap_pages(roots, maps).collect()) == ["http://h/1?a=1&b=2", "http://h/2", "http://h/3"]
    assert [r.url for r in crawl.sitemap_urls(maps).collect()] == ["http://h/1?a=1&b=2", "http://h/2", "http://h/3", "http://h/4"]


def test_json_ld_items(spark):
    block = lambda x: f'<SCRIPT type="application/ld+json">{x}</SCRIPT>'
    long = "d" * 50
    rows = [
        (1, block(f'{{"name": "n", "description": "{long}", "location": {{"name": "here"}}}}') + block('{"name": "short"}')),
        (2, block(f'[{{"description": "{long}"}}, 5, "x", null]')),
        (3, block(f'{{"@graph": [{{"name": "g", "startDate": "2024", "description": "{long}"}}]}}')),
        (4, block("{broken")),
        (5, "<p>none</p>"),
        (6, None),
        (7, block(f'{{"name": 7, "description": "a\\n  {long}"}}')),
    ]
    got = sorted((r.id, r.heading, r.text) for r in dom.json_ld_items(spark.createDataFrame(rows, "id long, html string"), "html").collect())
    assert got == [(1, "n", f"n {long} here"), (2, "Strukturierte Daten", long), (3, "g", f"g {long} 2024"), (7, "7", f"7 a {long}")]


def test_pieces_come_from_a_table_function(spark):
    df = spark.createDataFrame([(1, "a " * 30, 5), (2, None, 6), (3, "", 7), (4, "x" * 45, 8)], "id long, text string, n int")
    out = with_pieces(df, "text", recursive, 20, 5)
    got = sorted((r.id, r.chunk_index, r.piece, r.n) for r in out.collect())
    want = [(i, k, p, n) for i, t, n in df.collect() for k, p in enumerate(recursive(t, 20, 5) if t else ())]
    assert got == want and len({g[0] for g in got}) == 2
