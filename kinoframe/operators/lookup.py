"""Lookups, bridges, selections and small set operations
(P4, P5, P9, P12, P16, O1, O5, J5, A9, W5, X1-X3)."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.functions.dates import ts_lit, whole_days
from kinoframe.operators.prefix import running_sum
from kinoframe.session import checked_broadcast, fixed_broadcast


class NotFound(LookupError):
    pass


def get_one(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; raises when absent. Only ``limit(1)`` rows reach the
    driver (the filter is pushed to the Parquet scan)."""
    hit = df.filter(F.col(key) == F.lit(value))
    if not hit.limit(1).collect():
        raise NotFound(f"{key}={value!r}")
    return hit


def first_by_alternate(df: DataFrame, alt_key: str, value, order: str) -> DataFrame:
    """P5: lookup by an alternate (non-unique) id, first hit by ``order``."""
    return df.filter(F.col(alt_key) == F.lit(value)).orderBy(order).limit(1)


def exclude_blocked(df: DataFrame, key: str, blocked: DataFrame, blocked_key: str | None = None,
                    max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Drop rows whose id is on a block list (``left_anti``); the list
    is broadcast only after its size has been checked."""
    b = blocked.select(F.col(blocked_key or key).alias(key)).distinct()
    return df.join(checked_broadcast(b, max_broadcast_rows), on=key, how="left_anti")


def bridge(items: DataFrame, mapping: DataFrame, ext_key: str, key: str) -> DataFrame:
    """Attach internal ids through an external-id bridge: unmatched rows
    are dropped, a row whose external id maps to several ids fans out."""
    m = mapping.select(ext_key, key).filter(F.col(ext_key).isNotNull()).distinct()
    return items.join(m, on=ext_key, how="inner")


def bridge_sets(mapping: DataFrame, ext_key: str, key: str) -> DataFrame:
    """J5 map view: external id -> sorted set of internal ids."""
    return (mapping.filter(F.col(ext_key).isNotNull()).groupBy(ext_key)
            .agg(F.array_sort(F.collect_set(key)).alias(f"{key}s")))


def genre_catalogue(rows: DataFrame, id_col: str = "genreid", name_col: str = "genre_name",
                    stamp_col: str = "movies_updated") -> DataFrame:
    """Per id the distinct sorted names and the latest stamp (compared as
    timestamps; no stamp -> NULL)."""
    return rows.groupBy(id_col).agg(F.array_sort(F.collect_set(name_col)).alias("genre_names"),
                                    F.max(stamp_col).alias(stamp_col))


def stale_first(df: DataFrame, id_col: str, stamp_col: str, as_of, min_age_days: int = 7,
                never: str = "2000-01-01") -> DataFrame:
    """Never updated, or at least ``min_age_days`` whole days old;
    oldest first, a missing stamp counting as ``never``; ids break ties.
    Adds ``order_no`` (1-based) by the two-level prefix sum (no window over
    one partition)."""
    stamp = F.coalesce(F.col(stamp_col).cast("timestamp"), ts_lit(never))
    due = df.filter(F.col(stamp_col).isNull() | (whole_days(F.col(stamp_col), ts_lit(as_of)) >= min_age_days))
    due = due.withColumn("_sort_stamp", stamp).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1.0))
    numbered = running_sum(due, "_all", ["_sort_stamp", id_col], "_one", "order_no")
    return (numbered.withColumn("order_no", F.col("order_no").cast("long")).drop("_sort_stamp", "_all", "_one")
            .orderBy("order_no"))


def recent_first(df: DataFrame, id_col: str, stamp_cols: Sequence[str], n: int = 10,
                 floor: str = "1970-01-01") -> DataFrame:
    """O1: the ``n`` most recently touched rows: descending by the greatest
    of the stamps (NULL as ``floor``), id as tie-break. Planned as a
    TakeOrderedAndProject (per-partition top-n, then a merge of n rows)."""
    g = F.greatest(*[F.coalesce(F.col(c).cast("timestamp"), ts_lit(floor)) for c in stamp_cols])
    return df.withColumn("last_touched", g).orderBy(F.col("last_touched").desc(), F.col(id_col)).limit(n)


GOLDEN = (1 + 5 ** 0.5) / 2


def _nth_fibonacci(n: int) -> int:
    """Closed form; exact for the handful of bands of a tier table."""
    return round(GOLDEN ** n / 5 ** 0.5)


def popularity_tiers(spark: SparkSession, start_popularity: int, as_of_year: int,
                     top: int = 10) -> DataFrame:
    """P16 tier table (at most ``top`` rows, from the rule): the band at step
    i above the first keeps films from year as_of_year + 3 - F(i + 4) on,
    F being the Fibonacci numbers (their sums telescope)."""
    bands = spark.range(start_popularity, top + 1).select(F.col("id").cast("int").alias("band"))
    years = F.create_map(*[F.lit(x) for i, p in enumerate(range(start_popularity, top + 1))
                           for x in (p, as_of_year + 3 - _nth_fibonacci(i + 4))])
    return bands.select("band", years[F.col("band")].alias("min_year"))


def tier_select(df: DataFrame, band_col: str, year_col: str, tiers: DataFrame) -> DataFrame:
    """Equi join on the band plus a range condition on the year,
    against the fixed-size tier table (broadcast by construction)."""
    t = fixed_broadcast(tiers.select(F.col("band").alias("_tier_band"), F.col("min_year").alias("_tier_min")))
    out = df.join(t, (F.col(band_col) == F.col("_tier_band")) & (F.col(year_col) >= F.col("_tier_min")), "inner")
    return out.drop("_tier_band").withColumnRenamed("_tier_min", "min_year")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W5 on rows: first occurrence of each distinct value per group, by
    ``order``. Written as a grouped ``min`` of the position (map-side
    combinable) instead of a window over a possibly hot group."""
    if len(order) == 1:  # a primitive min stays in the hash aggregate
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    pos = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min(pos).alias("_first")).select(*keys, "_first.*")


def dedupe_first_words(docs: DataFrame, key: str, text: str, sep: str, hot_rows: int = 1000) -> DataFrame:
    """(key, word, first_pos): ``dedupe_first`` of the words of each key's
    texts (positions from 1). The texts are dealt by key and cut afterwards,
    so each crosses the exchange once, in place of a row for each of its
    words. The words of a key with more than ``hot_rows`` rows are dealt by
    key and word, as one task would have all of them."""
    def words(rows: DataFrame) -> DataFrame:
        # the separator is a plain text; split takes a pattern
        cut = rows.select(key, F.posexplode(F.split(text, re.escape(sep))).alias("_pos", "word"))
        return dedupe_first(cut.select(key, "word", (F.col("_pos") + 1).cast("long").alias("first_pos")),
                            [key, "word"], ["first_pos"])

    docs = docs.select(key, text)
    hot = docs.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select("_hot")
    hot = checked_broadcast(hot)   # one key for each ``hot_rows`` rows at most
    same = F.col(key).eqNullSafe(F.col("_hot"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = docs.join(hot, same, "left_anti").repartition(parts, key)
    return words(by_key).unionByName(words(docs.join(hot, same, "left_semi")))


def distinct_sorted(arr) -> Column:
    """Distinct + sorted list."""
    return F.array_sort(F.array_distinct(F.col(arr) if isinstance(arr, str) else arr))


def append_frames(*frames: DataFrame) -> DataFrame:
    """Column-aligned append; columns missing on one side are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
