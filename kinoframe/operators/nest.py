"""Nest / unnest between child tables and one nested record per key
(A4-A8, B1-B7, J2, W1).

Nesting is one ``groupBy(key)`` with ``collect_list`` (partial aggregation on
the map side, so only the already-grouped lists cross the shuffle); it is
meant for children that are bounded per key (a film's cast, its genres). The
order inside a list is fixed by ``array_sort`` on a struct whose leading
fields are the rank columns, so the result does not depend on partitioning.
Unnesting is a narrow ``posexplode`` (no shuffle).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def ordered_list(order: Sequence[str], fields: Sequence[str], alias: str,
                 single: bool = False, where: Column | None = None) -> Column:
    """Aggregate expression: list of ``struct(fields)`` (or bare value if
    ``single``) ordered by ``order`` then by the fields themselves.

    ``where`` keeps only matching rows (``collect_list`` skips the NULLs that
    ``when`` yields); a group with no matching row gives NULL, not [].
    """
    sort_struct = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                           *[F.col(c) for c in fields])
    if where is not None:
        sort_struct = F.when(where, sort_struct)
    ordered = F.array_sort(F.collect_list(sort_struct))
    if where is not None:
        ordered = F.when(F.size(ordered) > 0, ordered)
    if single:
        proj = F.transform(ordered, lambda x: x[fields[0]])
    else:
        proj = F.transform(ordered, lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return proj.alias(alias)


def nest_list(df: DataFrame, key: str | Sequence[str], fields: Sequence[str],
              order: Sequence[str] = (), alias: str = "items") -> DataFrame:
    """A4/A5: rows -> ``array<struct<fields>>`` per key, ordered by rank."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(ordered_list(order, fields, alias))


def nest_values(df: DataFrame, key: str | Sequence[str], value: str,
                order: Sequence[str] = (), alias: str | None = None) -> DataFrame:
    """Rows -> ``array<value>`` per key; without ``order`` the list is
    sorted by value (primary-key order of the reference's child tables)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(ordered_list(order, [value], alias or value, single=True))


def nest_by_role(df: DataFrame, key: str, role: str, roles: dict[str, str],
                 fields: Sequence[str], order: Sequence[str] = (),
                 single: bool = False) -> DataFrame:
    """A4 for several roles in ONE pass: ``roles`` maps a role value to the
    output list column (``{"cast": "cast", "director": "director"}``)."""
    return df.groupBy(key).agg(*[
        ordered_list(order, fields, alias, single=single, where=F.col(role) == F.lit(value))
        for value, alias in roles.items()])


def nest_map(df: DataFrame, key: str, map_key: str, fields: Sequence[str],
             alias: str = "details") -> DataFrame:
    """Rows -> ``map<map_key, struct<fields>>`` per key (map_key unique per key)."""
    entry = F.struct(F.col(map_key).alias("key"),
                     F.struct(*_cols(fields)).alias("value"))
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(alias))


def nest_map2(df: DataFrame, key: str, k1: str, k2: str, value: str,
              alias: str = "scores") -> DataFrame:
    """Rows -> ``map<k1, map<k2, value>>`` per key, by two groupings
    (the inner maps are built where the rows already are, then grouped)."""
    inner = (df.groupBy(key, k1)
               .agg(F.map_from_entries(F.collect_list(
                   F.struct(F.col(k2).alias("key"), F.col(value).alias("value")))).alias("_inner")))
    return inner.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(k1).alias("key"), F.col("_inner").alias("value")))).alias(alias))


def attach(header: DataFrame, key: str, parts: Sequence[DataFrame],
           empty_map_cols: Sequence[str] = ()) -> DataFrame:
    """Left-join nested parts to the header. A missing child list stays
    NULL; ``empty_map_cols`` (the ratings map) become an empty map."""
    out = header
    for p in parts:
        out = out.join(p, on=key, how="left")
    for c in empty_map_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.create_map().cast(out.schema[c].dataType)))
    return out


def unnest_list(df: DataFrame, key: str | Sequence[str], array_col: str,
                rank: str | None = "rank", sort: bool = False,
                value: str | None = None, extra: dict | None = None) -> DataFrame:
    """One row per element, 1-based ``rank`` from list position.

    ``sort=True`` sorts the list first (languages, keywords). NULL and empty
    lists give no rows. Struct elements are flattened; a scalar element is
    named ``value`` (default: the array column's name). ``extra`` adds
    literal columns (e.g. ``{"role": "cast"}``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    arr = F.array_sort(F.col(array_col)) if sort else F.col(array_col)
    out = df.select(*keys, F.posexplode(arr).alias("_pos", "_el"))
    el_type = out.schema["_el"].dataType
    if isinstance(el_type, StructType):
        vals = [F.col("_el")[f.name].alias(f.name) for f in el_type.fields]
    else:
        vals = [F.col("_el").alias(value or array_col)]
    lits = [F.lit(v).alias(k) for k, v in (extra or {}).items()]
    rank_col = [(F.col("_pos") + 1).alias(rank)] if rank else []
    return out.select(*keys, *lits, *vals, *rank_col)


def unnest_roles(df: DataFrame, key: str, role_lists: dict[str, str],
                 role: str = "role", rank: str = "rank", value: str = "value") -> DataFrame:
    """B2: several per-role lists (cast, director, writer) to one table with
    the role as a column and the rank per role, in ONE pass: the lists are
    paired with their role in a literal array and exploded twice (no union,
    so the nested input is computed and read once)."""
    pairs = F.array(*[F.struct(F.lit(r).alias("_role"), F.col(c).alias("_list")) for r, c in role_lists.items()])
    x = df.select(key, F.explode(pairs).alias("_rl"))
    x = x.select(key, F.col("_rl._role").alias(role), F.posexplode(F.col("_rl._list")).alias("_pos", "_el"))
    el_type = x.schema["_el"].dataType
    if isinstance(el_type, StructType):
        vals = [F.col("_el")[f.name].alias(f.name) for f in el_type.fields]
    else:
        vals = [F.col("_el").alias(value)]
    return x.select(key, role, *vals, (F.col("_pos") + 1).alias(rank))


def unnest_map(df: DataFrame, key: str, map_col: str, key_name: str,
               value_name: str = "value") -> DataFrame:
    """Map -> rows; struct values are flattened."""
    out = df.select(key, F.explode(F.col(map_col)).alias(key_name, "_v"))
    vt = out.schema["_v"].dataType
    if isinstance(vt, StructType):
        return out.select(key, key_name, *[F.col("_v")[f.name].alias(f.name) for f in vt.fields])
    return out.withColumnRenamed("_v", value_name)


def unnest_map2(df: DataFrame, key: str, map_col: str, k1: str, k2: str,
                value_name: str = "score") -> DataFrame:
    """Two-level map -> (key, k1, k2, value)."""
    lvl1 = df.select(key, F.explode(F.col(map_col)).alias(k1, "_inner"))
    return lvl1.select(key, k1, F.explode("_inner").alias(k2, value_name))
