"""Web pages: text, links and a breadth-first crawl over a table of pages. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(html: Column) -> Column:
    """Text outside tags, scripts and styles, squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def hrefs(html: Column) -> Column:
    """Targets of links, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a[^>]* href="([^"#]+)'), F.lit(1)))


def links(pages: DataFrame) -> DataFrame:
    """Absolute links of each page (page_id, url, html) to its own host, without fragments: page_id, link."""
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    rows = pages.select("page_id", root.alias("root"), F.explode(hrefs(F.col("html"))).alias("href"))
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat("root", "href"))
    return rows.select("page_id", "root", link.alias("link")).where("link IS NOT NULL AND (link = root OR startswith(link, root || '/'))").select("page_id", "link").distinct()


def crawl(pages: DataFrame, start: DataFrame, depth: int = 1, least: int = 50) -> DataFrame:
    """Pages reachable from ``start`` (url) in ``depth`` steps over links, with at least ``least`` characters of text: page_id, url, depth, text."""
    seen = pages.join(start.select("url"), "url", "left_semi").select("page_id", "url", F.lit(0).alias("depth"))
    edge = links(pages)
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(edge, "page_id").select(F.col("link").alias("url")).distinct()
        frontier = pages.join(found, "url", "left_semi").join(seen.select("page_id"), "page_id", "left_anti").select("page_id", "url", F.lit(d).alias("depth"))
        seen = seen.union(frontier)
    return seen.join(pages.select("page_id", text(F.col("html")).alias("text")), "page_id").where(F.length("text") >= least)


def joined(pages: DataFrame, key: str) -> DataFrame:
    """Texts of each group's pages (place, url, text) in order of visit, each under a line that names its source: key, text, n."""
    part = F.concat(F.lit("--- Source: "), "url", F.lit(" ---\n\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("text"), F.count("*").alias("n"))
