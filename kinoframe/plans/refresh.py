"""Refresh scheduling as DataFrame jobs.

films (one row per film) -> population statistics (one row) -> per-film
period scores -> film x source next-update times -> due set -> per-source
arrival sequence spread under hourly caps -> merged plan.

Randomness is repeatable: the uniform draws are hashes of (id, source, seed)
unless the caller passes its own draw column, so a re-run after a lost
executor gives the same plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.dates import MICROS_PER_WEEK, ts_lit
from kinoframe.functions.scoring import (combined_period, curve_a, curve_b, exponential_gap,
                                         period_score, unit_draw, weibull_jitter)
from kinoframe.operators.prefix import running_sum, running_sum_top_n
from kinoframe.operators.quality import exact_percentiles
from kinoframe.session import cut_lineage, fixed_broadcast

# Sources in scheduling order with their period multipliers,
# the first-time speed-up, the hourly caps per source group, the period cap.
SOURCES = [("criticker", 1), ("omdb", 10), ("imdb_main", 1), ("imdb_release", 10),
           ("imdb_metacritic", 5), ("imdb_keywords", 10), ("imdb_taglines", 10),
           ("imdb_vote_details", 2), ("imdb_plot", 10), ("ptp", 1)]
FIRSTTIME_SPEEDUP = 50000.0
MAX_PER_HOUR = {"criticker": 400, "omdb": 40, "imdb": 800, "ptp": 400}
MAX_WEEKS = 500.0
NO_EXTERNAL_ID_SOURCES = ("criticker",)


@dataclass
class RefreshConfig:
    sources: list = field(default_factory=lambda: list(SOURCES))
    base_multiplier: float = 1.0
    firsttime_speedup: float = FIRSTTIME_SPEEDUP
    max_per_hour: dict = field(default_factory=lambda: dict(MAX_PER_HOUR))
    max_weeks: float = MAX_WEEKS
    weibull_shape: float = 1.5
    seed: int = 0


def population_stats(films: DataFrame, year: str = "float_year", popularity: str = "crit_popularity",
                     date_added: str = "date_added", method: str = "sorted") -> DataFrame:
    """A10 + R1: one row with min / median / max of the fractional release
    year and of popularity (NULL ignored), the earliest date_added, and the
    curve parameters a, b of both features.

    ``sorted`` (default) computes the exact medians by rank
    (:func:`exact_percentiles`: no task ever holds a whole column); they
    enter the one-row result as scalar subqueries. ``map`` uses Spark's
    ``median`` (value -> count map, fine for few distinct values),
    ``approx`` uses ``percentile_approx``.
    """
    base = films.agg(
        F.min(year).alias("year_min"), F.max(year).alias("year_max"),
        F.min(popularity).alias("pop_min"), F.max(popularity).alias("pop_max"),
        F.min(date_added).alias("earliest_date_added"))
    if method == "sorted":
        long = films.select(F.explode(F.array(
            F.struct(F.lit("year").alias("feature"), F.col(year).cast("double").alias("value")),
            F.struct(F.lit("pop").alias("feature"), F.col(popularity).cast("double").alias("value")))).alias("x")
        ).select("x.*")
        med = exact_percentiles(long, "value", [0.5], by=["feature"])
        s = base.select("*", *[med.filter(F.col("feature") == f).select("p50").scalar().alias(f"{f}_median")
                               for f in ("year", "pop")])
    else:
        agg = F.median if method == "map" else (lambda c: F.percentile_approx(c, 0.5, 100000))
        s = base.select("*", *[films.select(agg(c)).scalar().alias(f"{f}_median")
                               for f, c in (("year", year), ("pop", popularity))])
    for p in ("year", "pop"):
        s = s.withColumn(f"{p}_b", curve_b(F.col(f"{p}_max") - F.col(f"{p}_median"),
                                           F.col(f"{p}_max") - F.col(f"{p}_min")))
        s = s.withColumn(f"{p}_a", curve_a(F.col(f"{p}_max") - F.col(f"{p}_median"), F.col(f"{p}_b")))
    return s


def period_scores(films: DataFrame, stats: DataFrame, year: str = "year",
                  popularity: str = "crit_popularity") -> DataFrame:
    """R2 + R3: per film the year score, popularity score (NULL popularity ->
    median) and the combined base period in weeks. ``stats`` (one row) enters
    as a scalar subquery: computed once, no join."""
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    pop = F.coalesce(F.col(popularity), s["pop_median"])
    x = films.withColumn("year_score", period_score(s["year_max"] - F.col(year), s["year_a"], s["year_b"]))
    x = x.withColumn("pop_score", period_score(s["pop_max"] - pop, s["pop_a"], s["pop_b"]))
    x = x.withColumn("earliest_date_added", s["earliest_date_added"])
    return x.withColumn("base_weeks", combined_period(F.col("year_score"), F.col("pop_score")))


def sources_array(cfg: RefreshConfig) -> Column:
    """The configured sources as a literal array of structs (P13: the group
    is the first configured prefix of the source name)."""
    items = []
    for i, (name, mult) in enumerate(cfg.sources, start=1):
        m = float(mult * cfg.base_multiplier)
        group = next(g for g in cfg.max_per_hour if name.startswith(g))
        items.append(F.struct(F.lit(i).alias("source_no"), F.lit(name).alias("source"),
                              F.lit(group).alias("source_group"), F.lit(m).alias("multiplier"),
                              F.lit(m / cfg.firsttime_speedup).alias("multiplier_firsttime")))
    return F.array(*items)


def next_updates(scored: DataFrame, cfg: RefreshConfig, key: str = "crit_id",
                 external_id: str = "imdbid", stamp_prefix: str = "",
                 jitter_draw: Column | None = None) -> DataFrame:
    """R4-R6 + P14: film x source rows with ``next_update``.

    Stamps are read from ``{stamp_prefix}{source}_updated``. Without an
    external id only the sources that do not need one are scheduled.
    period = base x multiplier (first time: / speed-up); next update = last
    update (first time: earliest date_added of all films) + min(period x
    jitter, cap) weeks. ``jitter_draw`` may use ``source_no`` and the key.
    """
    # film x source: a generator over the literal source list (no join)
    x = scored.select("*", F.explode(sources_array(cfg)).alias("_src")).select("*", "_src.*").drop("_src")
    x = x.filter(F.col("source").isin(*NO_EXTERNAL_ID_SOURCES) | F.col(external_id).isNotNull())
    stamp = F.coalesce(*[F.when(F.col("source") == s, F.col(f"{stamp_prefix}{s}_updated").cast("timestamp"))
                         for s, _ in cfg.sources if f"{stamp_prefix}{s}_updated" in scored.columns],
                       F.lit(None).cast("timestamp"))
    u = jitter_draw if jitter_draw is not None else unit_draw(cfg.seed, F.col(key), F.col("source"))
    jitter = weibull_jitter(u, cfg.weibull_shape)
    first = stamp.isNull()
    period = F.when(first, F.col("base_weeks") * F.col("multiplier_firsttime")) \
              .otherwise(F.col("base_weeks") * F.col("multiplier"))
    weeks = F.least(period * jitter, F.lit(cfg.max_weeks))
    base = F.when(first, F.col("earliest_date_added").cast("timestamp")).otherwise(stamp)
    nxt = F.timestamp_micros(F.unix_micros(base) + F.round(weeks * F.lit(MICROS_PER_WEEK)).cast("long"))
    return x.select(key, "source", "source_no", "source_group",
                    weeks.alias("weeks"), F.least(period, F.lit(cfg.max_weeks)).alias("update_period"),
                    nxt.alias("next_update"))


def due(updates: DataFrame, as_of) -> DataFrame:
    """Tasks whose next update is not after ``as_of``."""
    return updates.filter(F.col("next_update") <= ts_lit(as_of))


def sequence(due_tasks: DataFrame, cfg: RefreshConfig, as_of, n: int | None = None,
             key: str = "crit_id", gap_draw: Column | None = None) -> DataFrame:
    """R8 + R9 + A17 + W2 + W3 + O2: per source group, tasks in order of
    next_update get arrival = as_of + running sum of exponential gaps with
    mean 3600 / min(count, cap) seconds; groups merged by arrival, first n.

    The per-group count is its own aggregation over the full due set (4
    rows, broadcast). With ``n`` the running sum only sees the first n rows
    per group (arrivals grow within a group, so no later row can enter the
    overall first n); without ``n`` it is the two-level prefix sum."""
    # The due set is read three times (counts, range sample, rows): compute
    # it once and cut the lineage (reliable checkpoint in the shared folder).
    due_tasks = cut_lineage(due_tasks)
    caps = due_tasks.sparkSession.createDataFrame(
        [(g, int(c)) for g, c in cfg.max_per_hour.items()], "source_group string, cap int")
    counts = due_tasks.groupBy("source_group").agg(F.count(F.lit(1)).alias("n_due"))
    # caps and per-group rates have one row per configured source group
    uph = counts.join(fixed_broadcast(caps), "source_group").select(
        "source_group", F.least(F.col("n_due"), F.col("cap")).alias("per_hour"))
    x = due_tasks.join(fixed_broadcast(uph), "source_group")
    u = gap_draw if gap_draw is not None else unit_draw(cfg.seed + 1, F.col(key), F.col("source"))
    x = x.withColumn("gap_s", exponential_gap(u, F.lit(3600.0) / F.col("per_hour")))
    order = ["next_update", key, "source"]
    if n is not None:
        x = running_sum_top_n(x, "source_group", order, "gap_s", "offset_s", n)
    else:
        x = running_sum(x, "source_group", order, "gap_s", "offset_s")
    x = x.withColumn("arrival", F.timestamp_micros(
        F.unix_micros(ts_lit(as_of)) + F.round(F.col("offset_s") * 1_000_000).cast("long")))
    if n is not None:
        x = x.orderBy("arrival", key, "source").limit(n)
    return x


def film_refresh_input(movies: DataFrame) -> DataFrame:
    """The film header (schema ``MOVIES``) with the fractional release year
    used by the population statistics (N15)."""
    from kinoframe.functions.dates import fractional_year
    return movies.withColumn("float_year", fractional_year("original_release_date", "imdb_year", "year"))


def schedule(films: DataFrame, cfg: RefreshConfig, as_of, n: int | None = None, key: str = "crit_id",
             float_year: str = "float_year") -> DataFrame:
    """Full refresh plan from a film table with columns crit_id, year,
    float_year, crit_popularity, imdbid, date_added and *_updated stamps
    (``film_refresh_input(movies)`` gives it from the film header)."""
    stats = population_stats(films, year=float_year)
    scored = period_scores(films, stats)
    return sequence(due(next_updates(scored, cfg, key=key), as_of), cfg, as_of, n=n, key=key)
