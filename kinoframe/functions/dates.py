"""Date expressions (N15, N16, M1, M2, R6). ``as_of`` is always a parameter
(never ``current_timestamp()``), so results are repeatable."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_WEEK = 7 * 24 * 3600 * 1_000_000
DAYS_PER_YEAR = 365.25


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(x) -> Column:
    """A literal instant (``datetime`` / ISO text) as a TIMESTAMP."""
    if isinstance(x, Column):
        return x.cast("timestamp")
    if isinstance(x, _dt.datetime):
        x = x.isoformat(sep=" ")
    return F.lit(str(x)).cast("timestamp")


def year_start(year) -> Column:
    return F.make_timestamp(_c(year).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def fractional_year(release_ts, imdb_year, year) -> Column:
    """Year + elapsed share of that year for a release date; else
    imdb_year + 0.5; else year + 0.5; NULL when nothing is known."""
    r = _c(release_ts).cast("timestamp")
    y = F.year(r)
    start = F.unix_micros(year_start(y))
    end = F.unix_micros(year_start(y + 1))
    share = (F.unix_micros(r) - start) / (end - start)
    return F.coalesce(y + share, _c(imdb_year) + F.lit(0.5), _c(year) + F.lit(0.5))


def release_date(local_ts, original_ts, imdb_year, year, default_year: int = 1900) -> Column:
    """M1: local ?? original ?? Jan 1 of (imdb_year ?? year ?? 1900)."""
    y = F.coalesce(_c(imdb_year), _c(year), F.lit(default_year))
    return F.coalesce(_c(local_ts).cast("timestamp"), _c(original_ts).cast("timestamp"), year_start(y))


def whole_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored (also when negative)."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def years_since(ts, as_of) -> Column:
    """M2: whole days since ``ts`` divided by 365.25."""
    return whole_days(ts, ts_lit(as_of)) / F.lit(DAYS_PER_YEAR)


# Thresholds (seconds) of the relative age label, with the unit
# used above each one; between thresholds the count is floored, at least 2.
AGE_LADDER = [
    (10, "just now", None), (45, "seconds", 1), (90, "a minute", None), (2700, "minutes", 60),
    (5400, "an hour", None), (79200, "hours", 3600), (129600, "a day", None), (554400, "days", 86400),
    (907200, "a week", None), (2419200, "weeks", 604800), (3888000, "a month", None),
    (29808000, "months", 2592000), (47260800, "a year", None), (None, "years", 31536000),
]


def humanized_age(ts, as_of, fallback: str = "Not updated before") -> Column:
    """Relative age of ``ts`` seen from ``as_of`` ('just now', 'a day
    ago', '3 weeks ago', ...); NULL -> ``fallback``."""
    secs = (F.unix_micros(ts_lit(as_of)) - F.unix_micros(_c(ts).cast("timestamp"))) / F.lit(1_000_000)
    label = None
    for limit, word, unit in AGE_LADDER:
        if unit is None:
            text = F.lit(word if word == "just now" else f"{word} ago")
        elif unit == 1:
            text = F.concat(F.floor(secs).cast("string"), F.lit(f" {word} ago"))
        else:
            n = F.greatest(F.floor(secs / F.lit(unit)), F.lit(2)).cast("long")
            text = F.concat(n.cast("string"), F.lit(f" {word} ago"))
        if limit is None:
            label = label.otherwise(text)
        else:
            label = F.when(secs < limit, text) if label is None else label.when(secs < limit, text)
    return F.when(_c(ts).isNull(), F.lit(fallback)).otherwise(label)
