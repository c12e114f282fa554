"""Links of web pages, and crawls over the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of document files. Fixed values.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "odt", "txt", "xls", "xlsx", "zip")

_ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))


def urls_in_text(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'https?://[^\s"<>]+'), F.lit(0))


def origin(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)


def absolute(href: Column, base: Column) -> Column:
    """A link as seen from its page."""
    return F.when(href.rlike("^[a-z]+://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(origin(base), href)).otherwise(F.concat(origin(base), F.lit("/"), href))


def file_name(url: Column, most: int = 120) -> Column:
    """The last part of the path with only safe characters."""
    return F.left(F.regexp_replace(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1), r"[^A-Za-z0-9._\-]", "_"), F.lit(most))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url`` of all links, absolute, each once per page."""
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(F.array_distinct(hrefs(F.col("html")))).alias("href"))
    return rows.where("href <> '' and not startswith(href, '#')").select("page_id", absolute(F.col("href"), F.col("base")).alias("url")).distinct()


def anchors(pages: DataFrame, most: int = 100) -> DataFrame:
    """``page_id, href, title``: links with their plain text, cut to ``most`` characters."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.explode(found).alias("a"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", _ANCHOR, 2), "<[^>]*>", ""), r"\s+", " "))
    return rows.select("page_id", F.regexp_extract("a", _ANCHOR, 1).alias("href"), F.left(title, F.lit(most)).alias("title"))


def crawl(edges: DataFrame, seeds: DataFrame, most_rounds: int | None = None, save=None) -> DataFrame:
    """Breadth-first crawl: ``node, depth``; every round is a join of the frontier with the links.

    It ends when nothing new is found, or after ``most_rounds`` where a depth is
    asked for.  ``save`` cuts the lineage of a round, by default a checkpoint.
    """
    save = save or (lambda df: df.checkpoint())
    visited = save(seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = visited, 0
    while most_rounds is None or depth < most_rounds:
        depth += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = save(found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = save(visited.unionByName(frontier))
    return visited


def crawl_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, path``: a crawl to a stated depth that carries the way to each node, as names joined by `` > ``."""
    level = seeds.select("node", F.col("node").alias("path"))
    out = level
    for _ in range(depth):
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.lit(" > "), "dst").alias("path"))
        out = out.unionByName(level)
    return out


def listings(links: DataFrame, least: int = 4) -> DataFrame:
    """``page_id, n_links, n_files, is_listing``: a listing has ``least`` links or more, half of them to files."""
    files = F.lower("url").rlike(r"\.(pdf|docx?|zip|html)([?#]|$)")
    counts = links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(files).alias("n_files"))
    return counts.withColumn("is_listing", (F.col("n_links") >= least) & (F.col("n_files") * 2 >= F.col("n_links")))
