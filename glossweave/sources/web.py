"""Choosing what to download: links of pages and feeds, export addresses, names and kinds of payloads.

The decisions are DataFrame expressions.  Fetching is a driver's step before any
query: a handful of addresses, tried one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .snapshots import exists, write_bytes

# --- fixed values -----------------------------------------------------------
KINDS = [
    ("spreadsheetml.sheet", ".xlsx"), ("ms-excel", ".xls"), ("wordprocessingml.document", ".docx"), ("text/html", ".html"),
    ("application/rss+xml", ".xml"), ("application/xml", ".xml"), ("text/xml", ".xml"), ("application/json", ".json"), ("text/plain", ".txt"),
]
EXPORT_BASE = r"ExternalApi\.setBaseUrl\(\s*['\"]([^'\"]+)['\"]\s*\)"
EXPORT_ID = r"let\s+id\s*=\s*['\"]([0-9a-fA-F-]{8,})['\"]"
EXPORT_PATH, EXPORT_END = "/rest/registry/", "/export?"
# --- end of fixed values ----------------------------------------------------


def looks_like_xml(content_type: Column, content: Column) -> Column:
    return F.lower(content_type).rlike("xml|rss") | F.ltrim(content).rlike(r"^<\?xml|^<rss")


def hrefs(content: Column) -> Column:
    """Targets of a page's links, in order."""
    tags = F.regexp_extract_all(content, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"), F.lit(1))
    return F.filter(F.transform(tags, lambda t: F.trim(F.regexp_replace(t, "^[\"']|[\"']$", ""))), lambda t: t != "")


def feed_links(content: Column) -> Column:
    """Links of a feed's items and their enclosures; of the feed itself if there are none."""
    of_items = F.concat(F.xpath(content, F.lit("//item/link/text()")), F.xpath(content, F.lit("//item/enclosure/@url")))
    return let(of_items, lambda x: F.when(F.size(x) > 0, x).otherwise(F.xpath(content, F.lit("//link/text()"))))


def resolve_url(base: Column, link: Column) -> Column:
    """A link as seen from a page."""
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).when(link == "", base).otherwise(F.concat(folder, link))


def extension(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]*[^/.](\.[^./]+)$", 1))


def best_link(links: Column, page_url: Column, allowed: list[str]) -> Column:
    """The first link with the most wanted extension, resolved; null if none has one."""
    wanted = F.array(*[F.lit(a) for a in allowed])
    ranked = F.transform(links, lambda x, i: let(resolve_url(page_url, x), lambda u: F.struct(F.array_position(wanted, extension(u)).alias("rank"), i.alias("i"), u.alias("url"))))
    return F.array_min(F.filter(ranked, lambda r: r.rank > 0)).url


def export_url(content: Column) -> Column:
    """The export address that a registry page's script builds; null if it doesn't."""
    base, registry = F.regexp_extract(content, EXPORT_BASE, 1), F.regexp_extract(content, EXPORT_ID, 1)
    return F.when((base != "") & (registry != ""), F.concat(F.rtrim(base, F.lit("/")), F.lit(EXPORT_PATH), registry, F.lit(EXPORT_END)))


def download_urls(pages: DataFrame, allowed: list[str], with_export: bool = False) -> DataFrame:
    """``download_url`` for pages (url, content, content_type)."""
    page = best_link(hrefs(F.col("content")), F.col("url"), allowed)
    page = F.coalesce(page, export_url(F.col("content"))) if with_export else page
    return pages.withColumn("download_url", F.when(looks_like_xml(F.col("content_type"), F.col("content")), best_link(feed_links(F.col("content")), F.col("url"), allowed)).otherwise(page))


def extension_of_response(url: Column, content_type: Column, disposition: Column) -> Column:
    """By the address, else the file name that the server gave, else the content type."""
    named = F.lower(F.regexp_extract(F.regexp_extract(disposition, r"(?i)filename=\"?([^\";]+)\"?", 1), r"[^/.](\.[^./]+)$", 1))
    kind = F.coalesce(*[F.when(F.lower(content_type).contains(marker), ext) for marker, ext in KINDS], F.lit(".bin"))
    return F.when(extension(url) != "", extension(url)).when(named != "", named).otherwise(kind)


def safe_stem(url: Column) -> Column:
    """A file name made of an address, 80 characters at most."""
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "([^/]*)/*$", 1)
    stem = F.regexp_replace(last, r"(?<=[^.])\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(F.coalesce(F.when(stem != "", stem), F.when(host != "", host), F.lit("download")), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.when(clean == "", "download").otherwise(F.left(clean, F.lit(80)))


def archive_names(downloads: DataFrame) -> DataFrame:
    """``path`` as date/source/time_stem.ext for (source, url, content_type, disposition, fetched_at); equal names are numbered."""
    from pyspark.sql import Window

    base = F.concat_ws("/", F.date_format("fetched_at", "yyyy-MM-dd"), "source", F.concat(F.date_format("fetched_at", "HHmmss"), F.lit("_"), safe_stem(F.col("url"))))
    df = downloads.withColumn("_base", base).withColumn("_ext", extension_of_response(F.col("url"), F.col("content_type"), F.col("disposition")))
    n = F.row_number().over(Window.partitionBy("_base", "_ext").orderBy("url")) - 1
    return df.withColumn("path", F.concat("_base", F.when(n > 0, F.concat(F.lit("_"), n)).otherwise(F.lit("")), "_ext")).drop("_base", "_ext")


# --- fetching ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Payload:
    """What an address gave."""

    content: bytes
    content_type: str
    disposition: str
    url: str  # after redirections


def download(url: str, headers: dict[str, str] | None = None, timeout: int = 45) -> Payload:
    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as r:
        return Payload(r.read(), r.headers.get("Content-Type", ""), r.headers.get("Content-Disposition", ""), r.geturl())


def archive(spark: SparkSession, root: str, source: str, payload: Payload, fetched_at: datetime) -> str:
    """Write a payload as date/source/time_stem.ext under ``root``, numbered if that is taken; its path."""
    row = spark.createDataFrame([(source, payload.url, payload.content_type, payload.disposition, fetched_at)], "source string, url string, content_type string, disposition string, fetched_at timestamp_ntz")
    path = archive_names(row).first().path
    stem, dot, ext = path.rpartition(".")
    n, target = 0, f"{root}/{path}"
    while exists(spark, target):
        n += 1
        target = f"{root}/{stem}_{n}{dot}{ext}"
    write_bytes(spark, target, payload.content)
    return target


def fetch(spark: SparkSession, source: str, pages: list[str], allowed: list[str], root: str, with_export: bool = False, get: Callable[[str], Payload] = download, now: Callable[[], datetime] = datetime.now) -> str:
    """The path of a source's newest file: of each page in turn the page itself if it is such a file, else what it links to.

    Every page is archived under ``raw_pages``.  If none brings a file, the error lists why.
    """
    errors: list[str] = []
    at = now()
    for page in pages:
        try:
            got = get(page)
            archive(spark, f"{root}/raw_pages", source, got, at)
            row = spark.createDataFrame([(got.url, got.content.decode("utf-8", "ignore"), got.content_type, got.disposition)], "url string, content string, content_type string, disposition string")
            kind = extension_of_response(F.col("url"), F.col("content_type"), F.col("disposition")).alias("kind")
            choice = download_urls(row, allowed, with_export).select(kind, "download_url").first()
            if choice.kind in allowed and choice.kind not in (".html", ".xml"):
                return archive(spark, root, source, got, at)
            if choice.download_url:
                return archive(spark, root, source, get(choice.download_url), at)
            errors.append(f"{page}: no link to a file")
        except Exception as e:  # any address may fail in its own way; the next one is tried
            errors.append(f"{page}: {e}")
    raise RuntimeError(f"nothing could be fetched for {source}:\n" + "\n".join(errors))
