"""Priority picks (A11-A14, N3, N4, N8): the earliest date or the
alphabetically first title of the best non-empty priority class.

Over rows each pick is one ``groupBy`` with filtered ``min`` aggregates
(map-side combinable, so a hot key never gathers its rows in one task) and a
``coalesce``. Over a list that stands in the row (``*_of``) it is an
expression on the list, without any exchange.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.text import (ENGLISH_TITLE_TAG, LIMITED_TAG, ORIGINAL_TITLE_TAG,
                                      RE_RELEASE_TAG, USA_COUNTRY, WORLDWIDE_COUNTRY, bound)
from kinoframe.operators.quality import exact_percentiles


def priority_min(value: Column, classes: Sequence[Column], any_last: bool = True) -> Column:
    """min(value) of the first class that has a non-NULL value; optionally
    of all rows when no class matches."""
    picks = [F.min(F.when(c, value)) for c in classes]
    if any_last:
        picks.append(F.min(value))
    return F.coalesce(*picks)


def pick_release_dates(releases: DataFrame, key: str, country: str = "Netherlands",
                       country_col: str = "country", date_col: str = "date",
                       tags_col: str = "tags") -> DataFrame:
    """N3 + A11: drop re-releases, then per key the earliest date of the
    normal (untagged) releases, else of limited ones, else of any; once over
    all countries (``original_release_date``) and once for ``country``."""
    tags = F.coalesce(F.col(tags_col), F.array().cast("array<string>"))
    r = releases.filter(~F.array_contains(tags, RE_RELEASE_TAG))
    normal = F.col(tags_col).isNull()
    limited = F.array_contains(tags, LIMITED_TAG)
    local = F.col(country_col) == F.lit(country)
    d = F.col(date_col)
    return r.groupBy(key).agg(
        priority_min(d, [normal, limited]).alias("original_release_date"),
        priority_min(F.when(local, d), [local & normal, local & limited]).alias("local_release_date"))


def pick_titles(akas: DataFrame, key: str, country_col: str = "country", tag_col: str = "tag",
                title_col: str = "title") -> DataFrame:
    """A12 + N4: original title = first original-title aka; English title =
    first of World-wide + English title > World-wide > English title > USA,
    and only when an original title exists (else both NULL)."""
    c, tg, ti = F.col(country_col), F.col(tag_col), F.col(title_col)
    ww = c == F.lit(WORLDWIDE_COUNTRY)
    eng = tg == F.lit(ENGLISH_TITLE_TAG)
    original = F.min(F.when(tg == F.lit(ORIGINAL_TITLE_TAG), ti))
    english = priority_min(ti, [ww & eng, ww, eng, c == F.lit(USA_COUNTRY)], any_last=False)
    return akas.groupBy(key).agg(original.alias("original_title"),
                                 F.when(original.isNotNull(), english).alias("english_title"))


def shortest_text(df: DataFrame, key: str, text: str, pos: str) -> DataFrame:
    """Shortest text per key, the first (lowest ``pos``) wins ties."""
    return df.filter(F.col(text).isNotNull()).groupBy(key).agg(
        F.min_by(F.col(text), F.struct(F.length(text), F.col(pos))).alias(text))


def median_int(df: DataFrame, key: str | Sequence[str], value: str, alias: str | None = None) -> DataFrame:
    """Median (interpolated), rounded half to even, as int; the exact
    median is found by rank, so no group is held by one task."""
    keys = [key] if isinstance(key, str) else list(key)
    med = exact_percentiles(df, value, [0.5], by=keys)
    return med.select(*keys, F.bround(F.col("p50"), 0).cast("int").alias(alias or value))


def _best_of(items: Column, value: str, classes: Sequence) -> Column:
    """The least value of the first class with one, over a list of structs."""
    return F.coalesce(*[F.array_min(F.transform(F.filter(items, c), lambda x: x[value])) for c in classes])


def release_dates_of(releases: str, country: str = "Netherlands") -> tuple[Column, Column]:
    """N3 + A11 on a list of parsed releases: (original, local) date."""
    tags = lambda r: F.coalesce(r["tags"], F.array().cast("array<string>"))
    dated = F.filter(F.col(releases), lambda r: r["date"].isNotNull() & ~F.array_contains(tags(r), RE_RELEASE_TAG))
    classes = [lambda r: r["tags"].isNull(), lambda r: F.array_contains(tags(r), LIMITED_TAG), lambda r: r["date"].isNotNull()]
    local = F.filter(dated, lambda r: r["country"] == country)
    return tuple(bound(x, lambda items: _best_of(items, "date", classes)) for x in (dated, local))


def titles_of(akas: str) -> tuple[Column, Column]:
    """A12 + N4 on a list of parsed titles: (original, English) title."""
    items = F.col(akas)
    worldwide = lambda a: a["country"] == WORLDWIDE_COUNTRY
    english = lambda a: a["tag"] == ENGLISH_TITLE_TAG
    original = _best_of(items, "title", [lambda a: a["tag"] == ORIGINAL_TITLE_TAG])
    found = _best_of(items, "title", [lambda a: worldwide(a) & english(a), worldwide, english, lambda a: a["country"] == USA_COUNTRY])
    return original, F.when(original.isNotNull(), found)


def shortest_of(texts: Column) -> Column:
    """A13 on a list: the shortest text, the first of equal ones."""
    placed = F.transform(texts, lambda x, i: F.struct(F.length(x).alias("size"), i.alias("at"), x.alias("text")))
    return F.array_min(F.filter(placed, lambda x: x["text"].isNotNull()))["text"]


def median_of(numbers: Column) -> Column:
    """A14 on a list: the median, rounded half to even, as int."""
    def middle(x: Column) -> Column:
        n = F.size(x)
        at = lambda i: F.get(x, i.cast("int")).cast("double")
        return F.when(n > 0, F.bround((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 0).cast("int"))

    return bound(F.array_sort(F.array_compact(numbers)), middle)
