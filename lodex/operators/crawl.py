"""Crawl frontier, robots rules and URL filters over link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BINARY_EXTENSIONS
from ..scratch import finished, folder


def walk(seeds: DataFrame, links: DataFrame, path: str, depth: int | None = None) -> DataFrame:
    """S1. (url, depth) of the pages reached from seeds (url) over links (src, dst), breadth first.
    Every round's frontier is written below ``path`` and read from there: one join with the last
    round and one anti-join with all rounds, no lineage beyond a round. The walk ends when a round
    reaches nothing new, or at ``depth``; a walk that was broken off goes on from the rounds that are
    there, with the seeds it began with."""
    spark = seeds.sparkSession
    rounds = finished(spark, path)
    if not rounds:
        seeds.select("url").distinct().write.parquet(f"{path}/depth=0")
        rounds = [0]
    while (depth is None or rounds[-1] < depth) and not spark.read.parquet(f"{path}/depth={rounds[-1]}").isEmpty():
        d = rounds[-1] + 1
        last = spark.read.parquet(f"{path}/depth={d - 1}")
        seen = spark.read.schema("url string").parquet(*[f"{path}/depth={r}" for r in rounds])
        found = links.join(last, links.src == last.url, "left_semi").select(F.col("dst").alias("url")).distinct()
        found.join(seen, "url", "left_anti").write.mode("overwrite").parquet(f"{path}/depth={d}")
        rounds.append(d)
    return spark.read.option("basePath", path).schema("url string, depth int").parquet(*[f"{path}/depth={r}" for r in rounds])


def bfs(seeds: DataFrame, links: DataFrame, depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """S1 in a folder that goes with the application; ``max_pages``: those reached first."""
    seen = walk(seeds, links, f"{folder(seeds.sparkSession, 'crawl')}/rounds", depth)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def robots_rules(robots: DataFrame) -> DataFrame:
    """S3. robots (host, text) to (host, agent, kind, prefix) in file order; kinds allow, disallow,
    sitemap. Rules of a group count for the agent line above them."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    lines = lines.select("host", "pos", F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value"))
    from pyspark.sql import Window

    above = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(above))
    return lines.where(F.col("key").isin("allow", "disallow", "sitemap") & (F.col("value") != "")).select("host", F.when(F.col("key") == "sitemap", "*").otherwise(F.coalesce("agent", F.lit("*"))).alias("agent"), F.col("key").alias("kind"), F.col("value").alias("prefix"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", allow_list: bool = False) -> DataFrame:
    """S2-S4. urls (url) without those whose path starts with a disallowed prefix of their host;
    with ``allow_list``, hosts that have allow rules admit only paths that match one."""
    own = rules.where(F.col("agent") == agent)
    rows = urls.withColumn("_host", F.try_parse_url("url", F.lit("HOST"))).withColumn("_path", F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")))
    deny = own.where("kind = 'disallow'").select(F.col("host").alias("_h"), F.col("prefix").alias("_p"))
    hit = (F.col("_host") == F.col("_h")) & F.col("_path").startswith(F.col("_p"))
    rows = rows.join(deny, hit, "left_anti")
    if allow_list:
        grant = own.where("kind = 'allow'").select(F.col("host").alias("_h"), F.col("prefix").alias("_p"))
        free = rows.join(grant.select("_h").distinct(), F.col("_host") == F.col("_h"), "left_anti")
        rows = rows.join(grant, hit, "left_semi").unionByName(free)
    return rows.drop("_host", "_path")


def fetchable(url: Column, deny: tuple[str, ...] = ()) -> Column:
    """No denied pattern, no media file."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    ok = ~path.rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$")
    return ok & ~url.rlike("|".join(deny)) if deny else ok


SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def parsed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, pages, nested) of (sitemap, xml), parsed as XML; what isn't XML is searched for its
    locations. A location that ends in .xml counts as nested wherever it stands."""
    rows = sitemaps.select("sitemap", F.from_xml("xml", SITEMAP, {"mode": "PERMISSIVE"}).alias("x"), F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.trim(u)).alias("raw"))
    own = F.concat(*[F.transform(F.coalesce(f"x.{c}", F.array().cast("array<struct<loc:string>>")), lambda u: F.trim(u.loc)) for c in ("url", "sitemap")])
    rows = rows.select("sitemap", F.array_compact(F.when(F.size(own) > 0, own).otherwise(F.coalesce("raw", F.array().cast("array<string>")))).alias("locs"))
    is_map = lambda u: F.lower(u).endswith(".xml")
    return rows.select("sitemap", F.filter("locs", lambda u: ~is_map(u) & (u != "")).alias("pages"), F.filter("locs", is_map).alias("nested"))


def sitemap_pages(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """S7. The distinct pages of the sitemaps reached from roots (sitemap) through nested indexes, as
    deep as they go; sitemaps (sitemap, xml) are the stored files."""
    rows = parsed_sitemaps(sitemaps)
    links = rows.select(F.col("sitemap").alias("src"), F.explode("nested").alias("dst"))
    reached = bfs(roots.select(F.col("sitemap").alias("url")), links).select(F.col("url").alias("sitemap"))
    return rows.join(reached, "sitemap", "left_semi").select(F.explode("pages").alias("url")).distinct()


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """S7. sitemaps (sitemap, xml) to the distinct sorted page URLs; nested indexes are entries
    that end in .xml and are returned apart by nested_sitemaps."""
    return parsed_sitemaps(sitemaps).select(F.explode("pages").alias("url")).distinct().orderBy("url")


def nested_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return parsed_sitemaps(sitemaps).select(F.explode("nested").alias("url")).distinct()
