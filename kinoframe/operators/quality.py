"""Data-quality jobs and profiles.

Spark has no primary or foreign keys, so the key contract of every table is an
explicit job. All of them are aggregations or anti joins (no collect).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.operators.prefix import running_sum


def check_unique(df: DataFrame, keys: Sequence[str], count_col: str = "n") -> DataFrame:
    """One row per duplicated key with its multiplicity (partial counts
    are combined map-side, so a hot key costs one row per task)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col)).filter(F.col(count_col) > 1)


def find_orphans(child: DataFrame, parent: DataFrame, key: str,
                 parent_key: str | None = None) -> DataFrame:
    """Child rows whose parent key is absent (``left_anti``)."""
    pk = parent_key or key
    parents = parent.select(F.col(pk).alias(key))
    return child.join(parents, on=key, how="left_anti")


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float] = (0.1, 0.5, 0.9),
                      by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (linear interpolation, like numpy / DuckDB's
    ``quantile_cont``) without holding any group in one task: rows are first
    counted per (group, value), map-side, so ties and repeated values weigh
    one row; the counts' two-level prefix sum gives each value its ranks, and
    only the values at the 2 x len(probs) wanted ranks of a group are kept."""
    g = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    x = (df.select(g.alias("_g"), F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
           .groupBy("_g", "_v").agg(F.count(F.lit(1)).cast("double").alias("_c")))
    ranked = running_sum(x, "_g", ["_v"], "_c", "_rank")
    n = ranked.groupBy("_g").agg(F.max("_rank").alias("_n"))
    wanted = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        wanted.append(F.struct(F.lit(i).alias("_p"), (F.floor(h) + 1).cast("double").alias("_lo"),
                               (F.ceil(h) + 1).cast("double").alias("_hi"), (h - F.floor(h)).alias("_frac")))
    targets = n.select("_g", F.explode(F.array(*wanted)).alias("t")).select("_g", "t.*")
    ranks = targets.select(F.col("_g").alias("_tg"), "_p", "_frac", F.explode(F.array("_lo", "_hi")).alias("_want")).distinct()
    # groups x probs x 2 rows: AQE broadcasts it from its measured size
    picked = ranked.join(ranks, F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_want") <= F.col("_rank"))
                         & (F.col("_want") > F.col("_rank") - F.col("_c")), "inner")
    per = picked.groupBy("_g", "_p").agg(F.min("_v").alias("_vlo"), F.max("_v").alias("_vhi"),
                                          F.first("_frac").alias("_frac"))
    per = per.withColumn("_val", F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo")))
    out = per.groupBy("_g").agg(*[F.max(F.when(F.col("_p") == i, F.col("_val"))).alias(f"p{int(round(p * 100)):02d}")
                                  for i, p in enumerate(probs)])
    return out.select(*[F.col("_g")[c].alias(c) for c in by], *[c for c in out.columns if c != "_g"])


def percentiles(df: DataFrame, col: str, probs: Sequence[float] = (0.1, 0.5, 0.9),
                method: str = "sorted", accuracy: int = 100_000, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of a column (linear interpolation, like numpy).

    * ``sorted`` (default): exact, by rank (:func:`exact_percentiles`);
      scales with any number of rows and distinct values per group;
    * ``map``: exact ``percentile``, whose buffer is a value -> count map:
      fine when a group has few distinct values;
    * ``approx``: ``percentile_approx`` (bounded sketch).
    """
    if method == "sorted":
        return exact_percentiles(df, col, probs, by)
    cols = []
    for p in probs:
        name = f"p{int(round(p * 100)):02d}"
        if method == "map":
            cols.append(F.percentile(F.col(col), F.lit(p)).alias(name))
        else:
            cols.append(F.percentile_approx(F.col(col), F.lit(p), accuracy).alias(name))
    return df.groupBy(*by).agg(*cols)


def step_counts(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Row counts after each cumulative filter step, in ONE pass:
    ``steps = [("loaded", lit(True)), ("typed", cond1), ...]``; each step's
    predicate is AND-ed with all earlier ones. Returns (step_no, step, n)."""
    acc = F.lit(True)
    aggs = []
    for i, (_name, cond) in enumerate(steps):
        acc = acc & cond
        aggs.append(F.count_if(F.coalesce(acc, F.lit(False))).alias(f"_s{i}"))
    wide = df.agg(*aggs)
    pairs = [x for i, (name, _c) in enumerate(steps)
             for x in (F.lit(i).cast("long"), F.lit(name), F.col(f"_s{i}"))]
    return wide.select(F.stack(F.lit(len(steps)), *pairs).alias("step_no", "step", "n"))
