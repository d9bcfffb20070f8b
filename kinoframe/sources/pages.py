"""HTML sources (S8, N11, N12, W4): landed pages -> typed columns.

Extraction is ``regexp_extract`` / ``regexp_extract_all`` on the html column
(JVM-side, inside codegen, one pass, no shuffle). The patterns target the
tags that carry each field; pages are processed whole.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.session import checked_broadcast



def tag(name: str, **attributes: str) -> str:
    """Pattern of a start tag that bears the attributes (values are patterns;
    a trailing underscore of a name is dropped), in any order and with
    either kind of quotes."""
    looks = "".join(rf"""(?=[^>]*\s{k.rstrip('_')}\s*=\s*["'](?:{v})["'])""" for k, v in attributes.items())
    return rf"<{name}\b{looks}[^>]*>"


def attribute(name: str) -> str:
    """Pattern of an attribute's value (group 2) inside a tag."""
    return rf"""\s{name}\s*=\s*(["'])(.*?)\1"""


def classed(word: str) -> str:
    """Pattern of a class attribute that holds the word."""
    return rf"""(?:[^"']*\s)?{word}(?:\s[^"']*)?"""


# Where each field sits on a film page and on a film-list page.
# A field is cut out step by step: (pattern, group), each within the last find.
FILM_PAGE_FIELDS = {
    "poster_url": [(tag("meta", itemprop="image"), 0), (attribute("content"), 2)],
    "my_rating": [(tag("div", class_=classed("fi_score_div")) + r"\s*([0-9]+)\s*<", 1)],
    "my_psi": [(tag("div", class_=classed("fi_psi_div")) + r"\s*([0-9]+)\s*<", 1)],
    "my_psi_fallback": [(r"(?s)PSI.{0,200}?<span[^>]*>\s*([0-9]+)\s*</span>", 1)],
    "trailer_id": [("(?s)" + tag("[a-z]+", id="fi_trailer") + r".*?(?:</div>|$)", 0),
                   (r"<iframe\b[^>]*>", 0), (attribute("src"), 2), (r"youtube[^/]*/(?:[^/]*/)*([A-Za-z0-9_-]+)", 1)],
    "imdbid": [("(?s)" + tag("p", id="fi_info_ext") + r".*?(?:</p>|$)", 0), (r"/tt([0-9]{7,})/", 1)],
    "crit_rating": [(tag("[a-z]+", itemprop="ratingValue") + r"\s*([0-9.]+)\s*<", 1)],
    "crit_votes": [(tag("[a-z]+", itemprop="reviewCount") + r"\s*([0-9]+)\s*<", 1)],
}
LIST_ITEM = "(?s)" + tag("li", id="fl_titlelist_title_[0-9]+") + ".*?</li>"
LINK = r"<a\b[^>]*>"
LIST_ITEM_FIELDS = {
    "crit_id": [(attribute("titleid"), 2)],
    "crit_url": [(LINK, 0), (attribute("href"), 2)],
    "title": [(LINK, 0), (attribute("title"), 2)],
    "link_text": [(r"(?s)<a\b[^>]*>(.*?)</a>", 1)],
    "psi": [(tag("div", class_=classed("pti"), title="Probable Score") + r"\s*([0-9]+)\s*<", 1)],
    "psi_plain": [(tag("div", class_=classed("pti")) + r"\s*([0-9]+)\s*<", 1)],
    "rating": [(tag("[a-z]+", title="Your Ranking") + r"\s*([0-9]+)\s*<", 1)],
}
# The entities that such pages use, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
PAGE_COUNT = r"""Page\s+[0-9]+\s+of\s+([0-9]+)"""
TRAILER_URL = "https://www.youtube.com/watch?v=%s"


def extract_fields(df: DataFrame, html: str, fields: Mapping[str, str | list], group: int = 1) -> DataFrame:
    """Generic S8: one column per field, a pattern (first match, ``group``)
    or steps of (pattern, group), each searched within what the one before
    it cut out; no match gives NULL (``regexp_extract`` gives '')."""
    def cut(steps) -> Column:
        found = F.col(html)
        for pattern, at in [(steps, group)] if isinstance(steps, str) else steps:
            found = F.regexp_extract(found, pattern, at)
        return F.nullif(found, F.lit(""))
    return df.select("*", *[cut(steps).alias(n) for n, steps in fields.items()])


def decode_entities(text) -> Column:
    """Character entities of a value cut out of a page."""
    out = F.col(text) if isinstance(text, str) else text
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, entity, char)
    return out


def extract_film_page(df: DataFrame, html: str = "html", trailer_url: str = TRAILER_URL) -> DataFrame:
    """Film page -> poster (empty -> NULL), own rating and psi (psi from
    its fallback place when the main one is missing or not a number),
    trailer URL, external id, rating; a missing vote count is 0."""
    x = extract_fields(df, html, FILM_PAGE_FIELDS)
    return x.select(
        *[c for c in df.columns if c != html],
        decode_entities("poster_url").alias("poster_url"),
        F.col("my_rating").try_cast("int").alias("my_rating"),
        F.coalesce(F.col("my_psi").try_cast("int"), F.col("my_psi_fallback").try_cast("int")).alias("my_psi"),
        F.when(F.col("trailer_id").isNotNull(), F.format_string(trailer_url, F.col("trailer_id"))).alias("trailer_url"),
        F.col("imdbid").try_cast("bigint").alias("imdbid"),
        F.col("crit_rating").try_cast("double").alias("crit_rating"),
        F.coalesce(F.col("crit_votes").try_cast("int"), F.lit(0)).alias("crit_votes"))


def page_popularity(popularity, page, pages) -> Column:
    """P - (page-1)/(pages-1); a single page keeps p (no division by 0)."""
    p = F.col(popularity) if isinstance(popularity, str) else popularity
    pg = F.col(page) if isinstance(page, str) else page
    n = F.col(pages) if isinstance(pages, str) else pages
    return F.when(n > 1, p - (pg - 1) / (n - 1)).otherwise(p.cast("double"))


def extract_film_list(df: DataFrame, html: str = "html", page: str | None = None,
                      popularity: str | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """N12 + W4 + P9: film-list page -> one row per listed film (id, url,
    title, year = last bracketed number, psi, rating) with the page count;
    optional popularity from page position; blocked ids removed."""
    keep = [c for c in df.columns if c != html]
    pages = F.regexp_extract(F.col(html), PAGE_COUNT, 1).try_cast("int")
    items = df.select(*keep, pages.alias("nr_pages"),
                      F.explode(F.regexp_extract_all(F.col(html), F.lit(LIST_ITEM), 0)).alias("_li"))
    x = extract_fields(items, "_li", LIST_ITEM_FIELDS).drop("_li")
    # year: the last bracketed number preceded by white space in the link text
    year = F.regexp_extract(F.col("link_text"), r"(?s)^.*\s+\(([0-9]+)\)", 1)
    x = x.select(*keep, "nr_pages",
                 F.col("crit_id").try_cast("int").alias("crit_id"), decode_entities("crit_url").alias("crit_url"),
                 decode_entities("title").alias("title"),
                 year.try_cast("int").alias("year"),
                 F.coalesce("psi", "psi_plain").try_cast("int").alias("psi"), F.col("rating").try_cast("int").alias("rating"))
    if page is not None and popularity is not None:
        x = x.withColumn("crit_popularity", page_popularity(popularity, page, "nr_pages"))
    if blocked is not None:
        x = x.join(checked_broadcast(blocked.select("crit_id").distinct()), "crit_id", "left_anti")
    return x
