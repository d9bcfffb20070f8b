"""Merge / upsert family.

Plain Parquet has no MERGE, so every merge is a declarative join that yields
the next snapshot: header merges are one ``full_outer`` join on the key
(both sides hash-partitioned on it, or bucketed so that no shuffle is
needed); child replacement is an anti join plus a union; folding an update
log is one ``groupBy(key)`` whose ``max_by`` aggregates are combined on the
map side, so a hot key is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def header_projection(df: DataFrame, header_cols: Sequence[str]) -> DataFrame:
    """Keep only header columns (those present); NULLs are left in place
    and are ignored by :func:`merge_null_safe`, so a NULL never overwrites."""
    return df.select(*[c for c in header_cols if c in df.columns])


def merge_null_safe(old: DataFrame, new: DataFrame, key, columns: Sequence[str] | None = None,
                    keep_first: Sequence[str] = (), supplied: Sequence[str] | None = None,
                    replace_whole: Sequence[str] = (), order: Sequence[str] | None = None,
                    null_keys: bool = True) -> DataFrame:
    """Merge partial records ``new`` into ``old`` on ``key``.

    * default: new value wins unless it is NULL (``coalesce(new, old)``);
    * ``keep_first``: the old value is kept once set (``date_added``);
    * ``supplied``: only these columns are taken from ``new`` (an upsert that
      updates only the columns the batch supplies); others keep ``old``;
    * ``replace_whole``: list / map columns replaced whole when new is
      non-NULL (same rule as the default, named for clarity).
    Keys only in ``new`` are inserted, keys only in ``old`` are kept.

    A batch may hold a key more than once: with ``order`` (columns of
    ``new``; ``[]``: the rows' arrival) it is folded first (:func:`fold_log`),
    so the latest non-NULL value wins, as if it had been applied row by row.

    Plan: one full outer join on the key at every size (both sides hashed on
    it, or bucketed so that no shuffle is needed). Rows without a key match
    nothing; they pass by the join, so they never gather in one task. With
    ``null_keys=False`` (neither side has such rows) each side is read once.
    """
    if order is not None:
        new, order = (new, list(order)) if order else (new.withColumn("_seq", F.monotonically_increasing_id()), ["_seq"])
        new = fold_log(new, key, order, [c for c in new.columns if c not in _keys(key) and c not in order], keep_first)
    keys = _keys(key)
    cols = list(columns) if columns is not None else [c for c in old.columns if c not in keys]
    upd = set(supplied) if supplied is not None else set(new.columns)
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols if c in upd and c in new.columns])

    def combine(j: DataFrame) -> DataFrame:
        out = []
        for c in cols:
            oc = F.col(f"_o_{c}") if f"_o_{c}" in j.columns else F.lit(None)
            if f"_n_{c}" not in j.columns:
                out.append(oc.alias(c))
            elif c in keep_first:
                out.append(F.coalesce(oc, F.col(f"_n_{c}")).alias(c))
            else:
                out.append(F.coalesce(F.col(f"_n_{c}"), oc).alias(c))
        return j.select(*keys, *out)

    if not null_keys:
        return combine(o.join(n, on=keys, how="full_outer"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    nothing = lambda side, prefix: [F.lit(None).cast(side.schema[c].dataType).alias(c)
                                    for c in side.columns if c.startswith(prefix)]
    joined = combine(o.where(~no_key).join(n.where(~no_key), on=keys, how="full_outer"))
    return (joined.unionByName(combine(o.where(no_key).select("*", *nothing(n, "_n_"))))
            .unionByName(combine(n.where(no_key).select("*", *nothing(o, "_o_")))))


def merge_entries(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U3 on rows ``(id, user, type, score)``: an entry present in ``new``
    replaces the old entry whole (a NULL score in a present entry does
    replace); entries absent from ``new`` are kept."""
    keys = list(keys)
    kept = old.join(new.select(*keys), on=keys, how="left_anti")
    return kept.unionByName(new.select(*old.columns))


def merge_nested_maps(old: Column, new: Column, value_type: str = "double") -> Column:
    """U3 on map form ``map<user, map<type, score>>``: per user, per type the
    new entry replaces the old one (even with a NULL score); users and types
    present on one side only are kept. ``map_concat`` alone would fail on
    duplicate keys, so old entries shadowed by new ones are filtered first."""
    mtype = f"map<string,map<string,{value_type}>>"
    o = F.coalesce(old, F.create_map().cast(mtype))
    n = F.coalesce(new, F.create_map().cast(mtype))

    def per_user(_user, a, b):
        merged = F.map_concat(F.map_filter(a, lambda k, _v: ~F.map_contains_key(b, k)), b)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged)

    return F.map_zip_with(o, n, per_user)


def replace_children(existing: DataFrame, new: DataFrame, key, touched: DataFrame | None = None,
                     clear_empty: bool = False) -> DataFrame:
    """Per key delete all children, then insert the new ones.

    Keys are those with at least one new row: an empty batch for a key deletes
    nothing (the reference's behaviour). With ``clear_empty=True`` the keys in
    ``touched`` lose their children even when they have no new rows.
    """
    keys = _keys(key)
    drop = new.select(*keys)
    if clear_empty and touched is not None:
        drop = drop.unionByName(touched.select(*keys))
    kept = existing.join(drop.distinct(), on=keys, how="left_anti")
    return kept.unionByName(new.select(*existing.columns))


def fold_log(log: DataFrame, key, order: Sequence[str], columns: Sequence[str],
             keep_first: Sequence[str] = ()) -> DataFrame:
    """U8: fold an update log into the current record: per column the latest
    non-NULL value by ``order`` (ties broken by the later order columns);
    ``keep_first`` columns take the earliest non-NULL value. Order-free, so
    it equals applying :func:`merge_null_safe` batch after batch."""
    keys = _keys(key)
    ordering = F.struct(*[F.col(c) for c in order])
    aggs = []
    for c in columns:
        pick = F.min_by if c in keep_first else F.max_by
        aggs.append(pick(F.when(F.col(c).isNotNull(), F.col(c)),
                         F.when(F.col(c).isNotNull(), ordering)).alias(c))
    return log.groupBy(*keys).agg(*aggs)


def quarantine(df: DataFrame, key, parent: DataFrame | None = None,
               parent_key: str | None = None, reason: str = "reason") -> DataFrame:
    """U9 + S10: tag every row 'ok', 'null_key' or 'orphan' instead of failing
    the batch; callers split on the tag. The parent keys are only projected
    and de-duplicated before the join (a semi-join shape)."""
    keys = _keys(key)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    out = df
    if parent is not None:
        pk = parent_key or keys[0]
        present = parent.select(F.col(pk).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
        # rows without a key are tagged before the join: as one key they would meet in one task
        keyed = out.where(~null_key).join(present, F.col(keys[0]) == F.col("_pk"), "left").drop("_pk")
        keyed = keyed.withColumn(reason, F.when(F.col("_hit").isNull(), "orphan").otherwise("ok")).drop("_hit")
        return keyed.unionByName(out.where(null_key).withColumn(reason, F.lit("null_key")))
    return out.withColumn(reason, F.when(null_key, "null_key").otherwise("ok"))


def apply_batch(header: DataFrame, children: dict[str, DataFrame], batch: DataFrame, key: str,
                header_cols: Sequence[str], child_specs: dict, keep_first: Sequence[str] = ()):
    """Apply one batch of nested partial records to a header and its
    child tables. ``child_specs[name] = fn(batch) -> child rows`` (the B2-B6
    unnest of that list); returns (new_header, {name: new_child})."""
    new_header = merge_null_safe(header, header_projection(batch, [key, *header_cols]), key,
                                 columns=[c for c in header.columns if c != key],
                                 keep_first=keep_first, order=[])
    new_children = {name: replace_children(children[name], fn(batch), key)
                    for name, fn in child_specs.items()}
    return new_header, new_children
