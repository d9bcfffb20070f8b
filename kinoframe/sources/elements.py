"""Elements of HTML pages by their range.

``pages`` cuts flat pages with patterns; here a page's tags are found first
(comments, scripts and ``>`` inside attributes are no tags), every start tag
is paired with the end tag of its element, and fields are taken from the
element's range, however deep other elements lie in it. Tags of an Arrow block
are paired at once: a prefix sum over a name's start and end tags gives the
depth, and in the order of (page, name, depth, place) a start tag is followed
by its end.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.session import importable
from kinoframe.sources.pages import TRAILER_URL

TAG = re.compile(r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][a-z0-9]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-z][a-z0-9]*)(?P<rest2>[^>]*+)>""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""([a-z][-a-z0-9_:]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}   # fixed values
NUMBER = re.compile(r"\s*([0-9.]+)\s*\Z")


@dataclass
class Page:
    """A page's tags in order: names, attributes, places and, for start tags,
    the tag that ends their element (or -1)."""

    text: str
    names: list[str]
    rest: list[str]
    begin: list[int]
    after: list[int]
    close: list[int]
    hidden: list[tuple[int, int]]
    known: dict[int, dict[str, str]] = field(default_factory=dict)   # attributes that were read

    def __post_init__(self):
        self.starts = [i for i, n in enumerate(self.names) if n]
        self.bearing = [i for i in self.starts if "=" in self.rest[i]]   # start tags that may have attributes

    def attributes(self, i: int) -> dict[str, str]:
        got = self.known.get(i)
        if got is None:
            got = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.rest[i])}
            self.known[i] = got
        return got

    def find(self, name: str | None, inside: tuple[int, int] | None = None, **wanted: str) -> Iterator[int]:
        """The start tags of a name (any: None) with attribute values that
        fit the patterns, within a range of the page."""
        lo, hi = inside or (0, len(self.text))
        looks = [(k.rstrip("_"), re.compile(v).fullmatch) for k, v in wanted.items()]
        # a tag without attributes fits only patterns that an absent value fits
        for i in self.starts if all(fits("") for _, fits in looks) else self.bearing:
            if (name is None or self.names[i] == name) and lo <= self.begin[i] < hi:
                got = self.attributes(i) if looks else {}
                if all(fits(got.get(k, "")) for k, fits in looks):
                    yield i

    def range(self, i: int) -> tuple[int, int]:
        """Where an element's content lies; one without an end tag runs to
        the page's end."""
        return self.after[i], self.begin[self.close[i]] if self.close[i] >= 0 else len(self.text)

    def own_text(self, i: int) -> str:
        """The text of an element that stands in none of those within it."""
        at, end = self.range(i)
        out, j = [], i + 1
        while j < len(self.names) and self.begin[j] < end:
            out.append(self.text[at:self.begin[j]])
            at = self.after[j]
            if self.names[j] and self.close[j] >= 0:
                at = self.after[self.close[j]]
                j = self.close[j]
            j += 1
        return entities.unescape("".join([*out, self.text[at:end]]))

    def number(self, tags: Iterator[int]) -> str | None:
        """The first of the elements' own texts that is a number."""
        return next((m[1] for m in (NUMBER.match(self.own_text(i)) for i in tags) if m), None)


def pages_of(texts: list[str]) -> list[Page]:
    """The tags of each text, start tags paired with end tags."""
    found = [[(*m.span(), *m.group("name", "name2", "end", "end2", "rest", "rest2")) for m in TAG.finditer(x)] for x in texts]
    page = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = [m for f in found for m in f]
    names = [(m[2] or m[3] or "").lower() for m in flat]
    is_end = [bool(m[4] or m[5]) for m in flat]
    rest = [m[6] or m[7] or "" for m in flat]
    ends = np.array(is_end, bool)
    alone = np.array([n in VOID or not n or r.endswith("/") for n, r in zip(names, rest)], bool)
    codes: dict[str, int] = {}
    code = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
    close = np.full(len(flat), -1)
    pair = np.flatnonzero(~alone)
    order = pair[np.lexsort((pair, code[pair], page[pair]))]
    step = np.where(ends[order], -1, 1)
    new = np.ones(len(order), bool)
    new[1:] = (page[order][1:] != page[order][:-1]) | (code[order][1:] != code[order][:-1])
    group = np.cumsum(new) - 1
    total = np.cumsum(step)
    heads = np.flatnonzero(new)
    depth = total - (total[heads] - step[heads])[group] if len(order) else total
    depth = depth + ends[order]                      # an end tag counts with its start
    by_depth = np.lexsort((order, depth, group))
    o, d, g = order[by_depth], depth[by_depth], group[by_depth]
    if len(o):
        hit = (~ends[o[:-1]]) & ends[o[1:]] & (d[1:] == d[:-1]) & (g[1:] == g[:-1])
        close[o[:-1][hit]] = o[1:][hit]
    close = np.where(close >= 0, close - np.searchsorted(page, page), -1).tolist()   # counted from the page's first tag
    begin, after = [m[0] for m in flat], [m[1] for m in flat]
    started = ["" if e else n for n, e in zip(names, is_end)]
    first = np.searchsorted(page, np.arange(len(texts) + 1)).tolist()
    return [Page(text, started[a:b], rest[a:b], begin[a:b], after[a:b], close[a:b],
                 [m[:2] for m, n in zip(flat[a:b], names[a:b]) if not n])
            for text, a, b in zip(texts, first, first[1:])]


def classed(word: str) -> str:
    return rf"(?:.*\s)?{word}(?:\s.*)?"


def film_page_fields(p: Page) -> dict[str, str | None]:
    """The raw fields of a film page, as ``pages.extract_film_page`` names
    them."""
    one = lambda found: next(found, None)
    poster, trailer, info = one(p.find("meta", itemprop="image")), one(p.find(None, id="fi_trailer")), one(p.find("p", id="fi_info_ext"))
    frame = one(p.find("iframe", p.range(trailer))) if trailer is not None else None
    video = re.search(r"youtube[^/]*/(?:[^/]*/)*([A-Za-z0-9_-]+)", p.attributes(frame).get("src", "")) if frame is not None else None
    links = [p.attributes(i).get("href", "") for i in p.find("a", p.range(info))] if info is not None else []
    ids = [m[1] for m in (re.search(r"/tt([0-9]{7,})/", x) for x in links) if m]
    psi = p.number(p.find("div", class_=classed("fi_psi_div")))
    if psi is None:
        at = next((m.end() for m in re.finditer("PSI", p.text) if not any(a <= m.start() < b for a, b in p.hidden)), None)
        psi = p.number(p.find("span", (at, len(p.text)))) if at is not None else None
    return {"poster_url": (p.attributes(poster).get("content") or None) if poster is not None else None,
            "my_rating": p.number(p.find("div", class_=classed("fi_score_div"))), "my_psi": psi,
            "trailer_id": video[1] if video else None, "imdbid": ids[0] if ids else None,
            "crit_rating": p.number(p.find(None, itemprop="ratingValue")), "crit_votes": p.number(p.find(None, itemprop="reviewCount"))}


FIELDS = ["poster_url", "my_rating", "my_psi", "trailer_id", "imdbid", "crit_rating", "crit_votes"]


def extract_film_elements(df: DataFrame, html: str = "html", trailer_url: str = TRAILER_URL) -> DataFrame:
    """N11 for pages with nested elements: the columns of
    ``pages.extract_film_page``; numbers are an element's own text. A NULL or
    empty page has no field (and no votes)."""
    importable(df.sparkSession)
    keep = [c for c in df.columns if c != html and c not in FIELDS]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(f, T.StringType()) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [film_page_fields(p) for p in pages_of([x or "" for x in part.column(html).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array([r[f] for r in rows], pa.string()) for f in FIELDS],
                                                 names=[*keep, *FIELDS])

    x = df.select(*keep, html).mapInArrow(run, schema)
    return x.select(*keep, "poster_url", F.col("my_rating").try_cast("int").alias("my_rating"), F.col("my_psi").try_cast("int").alias("my_psi"),
                    F.when(F.col("trailer_id").isNotNull(), F.format_string(trailer_url, F.col("trailer_id"))).alias("trailer_url"),
                    F.col("imdbid").try_cast("bigint").alias("imdbid"), F.col("crit_rating").try_cast("double").alias("crit_rating"),
                    F.coalesce(F.col("crit_votes").try_cast("int"), F.lit(0)).alias("crit_votes"))
