"""Links: extraction, normalising, classes, crawl targets, reach over a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import numbered

#: Classes of addresses, the first that fits; what is never followed.
KINDS = (
    ("board_detail", r"(?i)(artclView|detailView)\.do"),
    ("board_list", r"(?i)(lists?|bbs|board)\.do|/Board/"),
    ("subview", r"(?i)subview\.do"),
    ("xhr", r"(?i)(dataAjax|Ajax)\.do"),
    ("static_page", r"(?i)\.do(\?|$)"),
)
SKIP_PATH = r"(?i)(logout|login|download|delete|update|write|checkPwd|actionView|link\.do|search\.do|print|excel)"
SKIP_EXT = r"(?i)\.(pdf|hwpx?|docx?|xlsx?|pptx?|zip|jpe?g|png|gif|mp4|css|js)$"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
SKIP_SCHEME = r"(?i)^\s*(javascript|mailto|tel|#|data):?"


def classify(url: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(F.regexp_like(url, F.lit(pattern)), name).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def normalize(url: Column, base: Column, suffix: str) -> Column:
    """An absolute address of a host under ``suffix`` without its fragment; null if it isn't to be followed."""
    bare = F.trim(F.substring_index(url, "#", 1))
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    full = (
        F.when(F.regexp_like(bare, F.lit("^https?://")), bare)
        .when(bare.startswith("//"), F.concat(F.lit("https:"), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .otherwise(F.concat(folder, F.lit("/"), bare))
    )
    full = F.when(F.regexp_like(full, F.lit(r"^https?://[^/?#]+$")), F.concat(full, F.lit("/"))).otherwise(full)
    host, path = host_of(full), F.regexp_replace(full, r"^https?://[^/]+", "")
    good = (
        (bare != "") & ~F.regexp_like(url, F.lit(SKIP_SCHEME)) & ((host == suffix) | host.endswith(f".{suffix}"))
        & ~F.regexp_like(F.substring_index(path, "?", 1), F.lit(SKIP_EXT)) & ~F.regexp_like(path, F.lit(SKIP_PATH))
    )
    return F.when(good, full)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Each page's different link targets as they are written."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))))
    return pages.select(url, found.alias("href"))


def targets(pages: DataFrame, url: str, done: DataFrame | None = None) -> DataFrame:
    """Addresses to fetch, each once and none that is done, taking hosts in turns."""
    once = pages.select(url).where(F.col(url).isNotNull()).distinct().withColumn("host", host_of(F.col(url)))
    if done is not None:
        once = once.join(done.select(url), url, "left_anti")
    seen = once.groupBy("host").agg(F.min(url).alias("seen"))
    return numbered(once, ["host"], [F.col(url)], "turn").join(seen, "host")


def menu_order(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, href, place: the different links of each host's pages, numbered in the order in which they come first.

    Pages come in the order of ``page``, links in that of the page; links without a target and pages without a host don't count.
    """
    targets = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page"), F.posexplode(targets).alias("pos", "href"))
    first = found.where("href <> '' and host <> ''").groupBy("host", "href").agg(F.min(F.struct("page", "pos")).alias("first"))
    return numbered(first, ["host"], [F.col("first")], "place").drop("first")


def reach(links: DataFrame, seeds: DataFrame, most_depth: int) -> DataFrame:
    """Pages within so many links of the seeds, with the least number of links.

    ``links`` (source, target); each round joins the new frontier alone.
    """
    known = seeds.select(F.col("url"), F.lit(0).alias("depth")).distinct()
    frontier = known
    for depth in range(1, most_depth + 1):
        frontier = links.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        frontier = frontier.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        known = known.unionByName(frontier)
    return known
