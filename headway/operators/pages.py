"""Jobs over a table of landed web pages; each page is read whole, inside its own task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import absolute_url, web_address

READABLE_CHARS = 600
LEAST_PIXELS = 200
# fixed values: markup of page furniture and article bodies, entities
FURNITURE = r"(?is)<(script|style|noscript|svg|form|nav|header|footer|aside)\b.*?</\1>"
MAIN_BODY = r"(?is)<(article|main)\b[^>]*>(.*?)</\1>"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&mdash;", "-"), ("&ndash;", "-"))
# fixed values: where a page names its own picture
META_IMAGE = (
    ("og:image", r"""(?i)<meta[^>]+property=["']og:image(?::url)?["'][^>]+content=["']([^"']+)["']"""),
    ("og:image", r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image(?::url)?["']"""),
    ("twitter:image", r"""(?i)<meta[^>]+name=["']twitter:image(?::src)?["'][^>]+content=["']([^"']+)["']"""),
)
# fixed values: words in addresses of pictures that illustrate nothing
JUNK = (r"(?i)(sprite|icon|favicon|logo|avatar|placeholder|spacer|pixel|tracking|1x1|blank|"
        r"advert|doubleclick|googletag|gravatar|badge|button|share|social)")


def page_text(html: Column | str) -> Column:
    """Readable text: the article body when marked up, else the page without its furniture."""
    html = F.col(html) if isinstance(html, str) else html
    body = F.when(html.rlike(MAIN_BODY), F.regexp_extract(html, MAIN_BODY, 2)).otherwise(html)
    text = F.regexp_replace(body, FURNITURE, " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.array_join(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.coalesce(text, F.lit(""))


def readable(text: Column | str) -> Column:
    return F.length(text) >= READABLE_CHARS


def social_image(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The page's own social image as a full address."""
    links = F.array(*[F.nullif(F.regexp_extract(F.col(html), p, 1), F.lit("")) for _, p in META_IMAGE])
    full = F.transform("_links", lambda link: web_address(absolute_url(F.col(url), link)))
    return pages.withColumn("_links", links).withColumn("image_url", F.get(F.array_compact(full), F.lit(0))).drop("_links")


def _attr(tag: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(tag, rf"""(?i){name}=["']([^"']*)["']""", 1))


def _either(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _widest(srcset: Column) -> Column:
    """The widest entry of a srcset; the later one on equal widths."""
    entries = F.filter(F.transform(F.split(srcset, ","), lambda e: F.trim(e)), lambda e: e != "")
    scored = F.transform(entries, lambda e, i: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(e, r"\s(\d+)w$", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("w"),
        i.alias("i"), F.regexp_extract(e, r"^(\S+)", 1).alias("u")))
    return F.array_max(scored)["u"]


def image_candidates(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id",
                     top: int | None = None) -> DataFrame:
    """Pictures a page offers, best first (the first ``top``, or all): its social images, then those in the
    text; repeats, icons and small ones dropped. All of a page's pictures are weighed inside its row."""
    empty = F.lit("")
    meta = [F.struct(F.lit(kind).alias("kind"), F.regexp_extract(F.col(html), p, 1).alias("src"), empty.alias("alt"),
                     empty.alias("w"), empty.alias("h")) for kind, p in META_IMAGE]
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    inline = F.transform(tags, lambda tag: F.struct(
        F.lit("article").alias("kind"),
        F.coalesce(_widest(_either(_attr(tag, "srcset"), _attr(tag, "data-srcset"))),
                   _either(_attr(tag, "src"), _attr(tag, "data-src"), _attr(tag, "data-lazy-src")), empty).alias("src"),
        _attr(tag, "alt").alias("alt"), _attr(tag, "width").alias("w"), _attr(tag, "height").alias("h")))
    rows = pages.select(page_id, F.col(url).alias("_base"), F.posexplode(F.concat(F.array(*meta), inline)).alias("_pos", "c"))
    size = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    rows = rows.filter("c.src <> ''").select(
        page_id, "_pos", "c.kind", web_address(absolute_url(F.col("_base"), F.col("c.src"))).alias("url"),
        F.nullif(size(F.col("c.w")), F.lit(0)).alias("width"), F.nullif(size(F.col("c.h")), F.lit(0)).alias("height"),
        "c.alt")
    small = F.coalesce(F.least("width", "height") < LEAST_PIXELS, F.lit(False))
    kept = rows.filter(F.col("url").isNotNull() & ~small & ~((F.col("kind") == "article") & F.col("url").rlike(JUNK)))
    once = kept.groupBy(page_id, "url").agg(F.min_by(F.struct("_pos", "kind", "alt", "width", "height"), "_pos").alias("c"))
    place = F.row_number().over(Window.partitionBy(page_id).orderBy("c._pos"))  # the pictures of one page
    ranked = once.withColumn("place", place)
    return ((ranked if top is None else ranked.filter(F.col("place") <= top))
            .select(page_id, "place", "url", "c.kind", "c.alt", "c.width", "c.height"))


def document_links(pages: DataFrame, hosts: list[str] | None = None, html: str = "html", url: str = "url",
                   page_id: str = "page_id") -> DataFrame:
    """Distinct PDF links of each page as full addresses, optionally on allowed hosts only."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)href="([^"]+\.pdf)"'), F.lit(1))
    rows = pages.select(page_id, F.col(url).alias("_base"), F.explode(F.array_distinct(found)).alias("_l"))
    rows = rows.select(page_id, absolute_url("_base", "_l").alias("document_url"))
    if hosts is not None:
        rows = rows.filter(F.lower(F.try_parse_url("document_url", F.lit("HOST"))).isin(*hosts))
    return rows.distinct()
