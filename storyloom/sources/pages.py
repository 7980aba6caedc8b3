"""Pages, feeds and listings: from raw HTML, RSS and JSON to article rows.

Fetching stays outside the engine: a landing job writes what it fetched, and these operators read it.
"""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from storyloom.functions import text as T
from storyloom.operators import relevance as R

LISTED = 50  # links kept of one listing
LEAST_BODY, MOST_BODY = 200, 40_000

#: The catalogue of sources: how each is listed, from where, and which paths are articles.
ADAPTERS = [
    ("ol_official", "ol_api", "https://www.ol.fr/app-config.json", ["www.ol.fr"], None, None, None),
    ("olympique_et_lyonnais", "html", "https://www.olympique-et-lyonnais.com/", ["olympique-et-lyonnais.com", "www.olympique-et-lyonnais.com"], "/", None, None),
    ("footmercato", "html", "https://www.footmercato.net/club/ol/actualite", ["footmercato.net", "www.footmercato.net"], r"/a\d+", None, None),
    ("foot01", "html", "https://www.foot01.com/ol", ["foot01.com", "www.foot01.com"], "/(?:ol|mercato|ligue1|football)", None, None),
    ("sport_fr", "html", "https://www.sport.fr/football", ["sport.fr", "www.sport.fr"], r"\.shtm$", None, None),
    ("leprogres", "html", "https://www.leprogres.fr/sport/ol-olympique-lyonnais-football", ["leprogres.fr", "www.leprogres.fr"], "/sport/", None, None),
    ("sport365", "html", "https://www.sport365.fr/football365", ["sport365.fr", "www.sport365.fr"], r"\.html$", None, r"-\d{6,}\.html$"),
    ("sports_fr", "rss", "https://www.sports.fr/football/feed", ["sports.fr", "www.sports.fr"], None, None, None),
    ("topmercato", "rss", "https://www.topmercato.com/feed", ["topmercato.com", "www.topmercato.com"], None, None, None),
    ("butfootballclub", "rss", "https://www.butfootballclub.fr/feed", ["butfootballclub.fr", "www.butfootballclub.fr"], None, None, None),
    ("ferveur_lyonnaise", "html", "https://www.ferveurlyonnaise.fr/", ["ferveurlyonnaise.fr", "www.ferveurlyonnaise.fr"], "/", None, None),
    ("madeingones", "html", "https://madeingones.ouest-france.fr/", ["madeingones.ouest-france.fr"], "/", None, None),
    ("sports_orange", "html", "https://sports.orange.fr/football/", ["sports.orange.fr"], "/football/", "/videos/football/", None),
]


def adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADAPTERS, "id string, mode string, discovery_url string, hosts array<string>, include_path string, exclude_path string, article_path string")


@F.pandas_udf(S.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            return urljoin(b or "", x) if x else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)])


@F.pandas_udf(S.StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """Numeric and named entities, decoded until nothing changes, three times at most."""

    def one(t):
        if t is None:
            return None
        for _ in range(3):
            now = _html.unescape(t).replace("\xa0", " ")
            if now == t:
                break
            t = now
        return t

    return x.map(one, na_action="ignore")


_HINT = re.compile("[ÃÂâ]")


@F.pandas_udf(S.StringType())
def repair_mojibake(x: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252, read right again, three times at most; left as it is where that fails."""

    def raw(c: str) -> int:
        return ord(c) if ord(c) < 256 else c.encode("cp1252")[0]

    def one(t):
        for _ in range(3):
            if not t or not _HINT.search(t):
                return t
            try:
                now = bytes(raw(c) for c in t).decode("utf-8")
            except (UnicodeError, ValueError):
                return t
            if now == t:
                return t
            t = now
        return t

    return x.map(one, na_action="ignore")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, link, first_pos, times) of every anchor."""
    pattern = r"""(?is)<a\b[^>]*href=["']([^"'#]+)["'][^>]*>(.*?)</a>"""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "href"))
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    link = F.when(F.col("href").startswith("/"), F.concat(host, "href")).otherwise(F.col("href"))
    return found.groupBy("page_id", link.alias("link")).agg((F.min("pos") + 1).alias("first_pos"), F.count("*").alias("times"))


def discover_links(pages: DataFrame, adapter: DataFrame | None = None) -> DataFrame:
    """Listed articles of each page: absolute, of an allowed host and path, with an article's address and title; the
    first place of each canonical address wins, and LISTED addresses are kept per page."""
    pattern = r"""(?is)(<a\b[^>]*href=["'][^"'#]+["'][^>]*>.*?</a>)"""
    found = pages.select("page_id", "url", *(["source_id"] if adapter is not None else []), F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "anchor"))
    found = found.withColumn("href", F.regexp_extract("anchor", r"""(?is)href=["']([^"'#]+)["']""", 1)).withColumn("title", T.strip_tags(F.col("anchor")))
    found = found.withColumn("link", absolute_url("url", "href"))
    own = None
    if adapter is not None:
        found = found.join(F.broadcast(adapter.withColumnRenamed("id", "source_id")), "source_id")  # a catalogue kept by hand
        path = F.coalesce(F.parse_url("link", F.lit("PATH")), F.lit(""))
        found = found.where(F.array_contains("hosts", F.parse_url("link", F.lit("HOST"))))
        found = found.where(F.col("include_path").isNull() | F.regexp_like(path, F.concat(F.lit("(?i)"), "include_path")))
        found = found.where(F.col("exclude_path").isNull() | ~F.regexp_like(path, F.concat(F.lit("(?i)"), "exclude_path")))
        own = F.concat(F.lit("(?i)"), "article_path")
        found = found.where(R.looks_like_article_url(F.col("link"), own) & R.looks_like_article_title(F.col("title")))
    found = found.withColumn("canonical", T.canonical_url(F.col("link"))).where("canonical is not null")
    first = found.groupBy("page_id", "canonical").agg(F.min(F.struct("pos", "title")).alias("f"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first.select("page_id", "canonical", "f.pos", "f.title").withColumn("place", place).where(F.col("place") <= LISTED).select("page_id", "place", F.col("canonical").alias("url"), "title")


def embedded_routes(pages: DataFrame, base: str, path: str) -> DataFrame:
    """Articles named in script payloads under `path`, with a title made of the slug; (page_id, place, url, title)."""
    route = r"\\?/".join(re.escape(p) for p in path.strip("/").split("/"))
    slugs = F.regexp_extract_all("html", F.lit(rf"(?i)\\?/{route}\\?/([a-z0-9][a-z0-9-]{{5,}})"), F.lit(1))
    found = pages.select("page_id", F.posexplode(F.array_distinct(slugs)).alias("pos", "slug")).withColumn("url", F.concat(F.lit(f"{base.rstrip('/')}/{path.strip('/')}/"), "slug"))
    parts = F.filter(F.split("slug", "-"), lambda w: w != "")
    title = F.array_join(F.transform(parts, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(w)), " ")
    found = found.where(R.looks_like_article_url(F.col("url"))).withColumn("title", title)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return found.withColumn("place", place).where(F.col("place") <= LISTED).select("page_id", "place", "url", "title")


def xml_tag(block: Column, tag: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return T.compact(F.regexp_replace(F.regexp_replace(inner, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?s)<[^>]+>", " "))


def rss_items(feeds: DataFrame) -> DataFrame:
    """(source_id, place, url, title, excerpt, published_at) of feeds (source_id, base_url, hosts, xml)."""
    items = feeds.select("source_id", "base_url", "hosts", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("pos", "item"))
    block = F.col("item")
    items = items.withColumn("title", decode_entities(xml_tag(block, "title"))).withColumn("link", F.coalesce(F.nullif(xml_tag(block, "link"), F.lit("")), xml_tag(block, "guid")))
    items = items.where((F.col("link") != "") & R.looks_like_article_title(F.col("title"))).withColumn("url", T.canonical_url(absolute_url("base_url", "link")))
    items = items.where(F.col("hosts").isNull() | F.array_contains("hosts", F.parse_url("url", F.lit("HOST"))))
    date = F.try_to_timestamp(F.regexp_replace(xml_tag(block, "pubDate"), r"^\w+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    items = items.select("source_id", "pos", "url", "title", decode_entities(xml_tag(block, "description")).alias("excerpt"), date.alias("published_at"))
    first = items.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "url").orderBy("pos"))).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    return first.withColumn("place", place).where(F.col("place") <= LISTED).drop("pos")


def api_articles(payloads: DataFrame) -> DataFrame:
    """Articles of JSON payloads (source_id, base_url, json); malformed payloads give no rows."""
    schema = "struct<data:array<struct<slug:string,title:string,excerpt:string,publishedAt:string>>>"
    rows = payloads.select("source_id", "base_url", F.posexplode(F.from_json("json", schema)["data"]).alias("pos", "a"))
    return rows.where("a.slug is not null").select("source_id", F.concat("base_url", "a.slug").alias("url"), T.compact(F.col("a.title")).alias("title"), T.compact(F.col("a.excerpt")).alias("excerpt"), F.try_to_timestamp("a.publishedAt").alias("published_at"))


class _Reader(HTMLParser):
    """Text of block elements, blank lines between; what frames a page rather than fills it is left out."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "br", "div", "section", "article"}
    FRAME = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.out_of = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.out_of += tag in self.FRAME
        if tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        self.out_of = max(0, self.out_of - (tag in self.FRAME))
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.out_of:
            self.now.append(data)

    def flush(self):
        line = " ".join("".join(self.now).split())
        self.now = []
        if line:
            self.blocks.append(line)


def readable(page: str | None) -> str:
    """The text of the article element, or of the body if there is none, as paragraphs."""
    if not page:
        return ""
    m = re.search(r"<article\b.*?</article>", page, re.S | re.I) or re.search(r"<main\b.*?</main>", page, re.S | re.I)
    r = _Reader()
    r.feed(m.group() if m else page)
    r.flush()
    return "\n\n".join(r.blocks)


@F.pandas_udf(S.StringType())
def readable_text(pages: pd.Series) -> pd.Series:
    return pages.map(readable)


def bodies(pages: DataFrame, http_status: Column | None = None) -> DataFrame:
    """(page_id, text, content_hash, status): completed with enough text; retry after server errors and throttling."""
    code = http_status if http_status is not None else F.lit(200)
    p = pages.select("page_id", F.substring(readable_text("html"), 1, MOST_BODY).alias("text"), code.alias("code"))
    status = F.when((F.col("code") >= 500) | (F.col("code") == 429), "retry").when((F.col("code") >= 400) | (F.char_length("text") < LEAST_BODY), "failed").otherwise("completed")
    return p.select("page_id", "text", F.sha2("text", 256).alias("content_hash"), status.alias("status"))
