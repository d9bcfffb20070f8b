"""Column expressions that normalise raw text fields (N1, N2, N4-N8, N10,
N18, N19). All are built-in Spark expressions (no Python UDF), so they run
inside whole-stage codegen; ANSI mode is on, so every parse is a ``try_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and tag words that must match the source data.
RELEASE_DATE_FORMATS = ("d MMMM yyyy", "MMMM yyyy", "yyyy")
RE_RELEASE_TAG = "re-release"
LIMITED_TAG = "limited"
ORIGINAL_TITLE_TAG = "original title"
ENGLISH_TITLE_TAG = "English title"
WORLDWIDE_COUNTRY = "World-wide"
USA_COUNTRY = "USA"
CATALOGUE_SENTINELS = ("", "notfound", "unknown")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value, use) -> Column:
    """``use`` of a value that is worked out once per row, however often
    ``use`` names it (inside a lambda nothing is shared by itself)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Shapes of the three date forms, tried in the same order as the formats.
RELEASE_DATE_SHAPES = (r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", r"^[A-Za-z]+ [0-9]{4}$", r"^[0-9]{4}$")


def parse_loose_date(s) -> Column:
    """N2: 'D MMMM YYYY', else 'MMMM YYYY', else 'YYYY'; NULL if none fits.

    The shape of the text picks the one format to try, so a row is parsed
    once instead of failing through the formats (a failed parse is costly)."""
    def parse(v: Column) -> Column:
        out = None
        for shape, fmt in zip(RELEASE_DATE_SHAPES, RELEASE_DATE_FORMATS):
            parsed = F.try_to_timestamp(v, F.lit(fmt))
            out = F.when(v.rlike(shape), parsed) if out is None else out.when(v.rlike(shape), parsed)
        return out

    return bound(F.trim(_c(s)), parse)


def parse_release(s) -> Column:
    """N1: 'country::date (tag)\\n (tag)' -> struct(country, date, tags).

    The country runs to the last '::' of the first line, the date is the run
    of letters, digits and spaces after it, and the tags are the bracketed
    texts after the date, of which only the last two are kept (a third one
    and earlier are dropped); no tag gives NULL.
    """
    v = _c(s)
    head = r"(.*)::([a-zA-Z0-9 ]*)((?s:.*))"
    country = F.regexp_extract(v, head, 1)
    date_txt = F.regexp_extract(v, head, 2)
    rest = F.regexp_extract(v, head, 3)
    last_two = bound(F.regexp_extract_all(rest, F.lit(r"\((.*?)\)"), 1),
                     lambda found: F.when(F.size(found) > 2, F.slice(found, -2, 2)).otherwise(found))
    kept = F.filter(last_two, lambda x: x != F.lit(""))
    matched = v.contains("::")
    return F.when(matched, F.struct(
        country.alias("country"),
        parse_loose_date(date_txt).alias("date"),
        bound(kept, lambda x: F.when(F.size(x) > 0, x)).alias("tags")))


def parse_aka(s) -> Column:
    """N4: 'country (tag) (tag)::title' -> struct(country, tag, title); the tag
    is the last bracketed text before '::', NULL when there is none."""
    v = _c(s)
    pat = r"^(.*?)((?:\s*\([^)]*\))*)::(.*)$"
    tags = F.regexp_extract(v, pat, 2)
    tag = F.regexp_extract(tags, r"\(([^)]*)\)\s*$", 1)
    return F.struct(F.regexp_extract(v, pat, 1).alias("country"),
                    F.nullif(tag, F.lit("")).alias("tag"),
                    F.regexp_extract(v, pat, 3).alias("title"))


def parse_votes(s) -> Column:
    """An integer, else the digits inside '(1,234)', else NULL."""
    v = _c(s)
    inner = F.when(v.contains("("), F.substring_index(F.substring_index(v, "(", -1), ")", 1))
    return F.coalesce(v.try_cast("bigint"), F.translate(inner, ",", "").try_cast("bigint"))


def to_int_or_null(s) -> Column:
    """Score text to int, NULL when it is not a number."""
    return _c(s).try_cast("int")


def display_name(name) -> Column:
    """N5: 'Last, First' -> 'First Last'; other forms unchanged."""
    v = F.trim(_c(name))
    return F.when(v.contains(", "),
                  F.concat_ws(" ", F.substring_index(v, ", ", -1), F.substring_index(v, ", ", 1))
                  ).otherwise(v)


# Words that begin a surname, and names that come before them.
SURNAME_PREFIXES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "ten", "ter", "el", "al"]


def canonical_name(name) -> Column:
    """N5: 'First Last' -> 'Last, First'. The surname is the last word with
    the prefixes right before it ('Anna van der Berg' -> 'van der Berg,
    Anna'); a name keeps at least one word before the surname. Already
    canonical or one-word names are unchanged."""
    pattern = rf"(?i)^(\S.*?) ((?:(?:{'|'.join(SURNAME_PREFIXES)}) )*\S+)$"

    def turn(v: Column) -> Column:
        first = F.regexp_extract(v, pattern, 1)
        return bound(F.regexp_extract(v, pattern, 2), lambda last: F.when(
            v.contains(", ") | (last == ""), F.trim(_c(name))).otherwise(F.concat_ws(", ", last, first)))

    return bound(F.regexp_replace(F.trim(_c(name)), r"\s+", " "), turn)


def person_record(person) -> Column:
    """struct(name, personID) -> struct(canonical_name, name, person_id)
    or NULL when the id does not parse (the person is then dropped)."""
    p = _c(person)
    pid = p["personID"].cast("string").try_cast("bigint")
    return F.when(pid.isNotNull() & p["name"].isNotNull(), F.struct(
        canonical_name(p["name"]).alias("canonical_name"),
        display_name(p["name"]).alias("name"),
        pid.alias("person_id")))


def people_list(arr) -> Column:
    """N5 + W5 on a list: normalise, drop unparseable, de-duplicate keeping
    the first occurrence (``array_distinct`` keeps first-seen order)."""
    return F.array_distinct(F.array_compact(F.transform(_c(arr), person_record)))


def strip_author(s) -> Column:
    """N8: 'plot text::author' -> 'plot text' (up to the first '::'); a text
    that begins with the mark stays whole."""
    v = F.trim(_c(s))
    plot = F.substring_index(v, "::", 1)
    return F.when(plot == "", v).otherwise(plot)


def pad_id(i, width: int = 7) -> Column:
    """Zero-padded id that never truncates longer ids."""
    return F.format_string(f"%0{width}d", _c(i).cast("long"))


def external_id(s) -> Column:
    """N9: 'tt0123456' -> 123456 as long; anything else NULL."""
    v = _c(s)
    return F.when(v.startswith("tt"), F.substring(v, 3, 1 << 20).try_cast("bigint"))


def feature_slug(prefix: str, s) -> Column:
    """Prefix + lower-case name, spaces to underscores."""
    return F.concat(F.lit(prefix), F.replace(F.lower(_c(s)), F.lit(" "), F.lit("_")))


def to_bool(x) -> Column:
    """Truthiness keeping NULL."""
    return _c(x).cast("boolean")


def is_sentinel(x) -> Column:
    """P10: sentinel ids ('' / 'notfound' / 'unknown') or NULL."""
    v = _c(x)
    return v.isNull() | v.isin(*CATALOGUE_SENTINELS)
