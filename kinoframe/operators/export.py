"""Wide export: one flat row per header key.

Children are aggregated *before* the join (no fan-out), each child table in a
single pass: every ordered string list and every conditional average of one
child becomes one aggregate expression of one ``groupBy(key)``. The header is
then left-joined to the pre-aggregated parts; all parts are hash-partitioned
on the key, so the chain of joins reuses one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class ListAgg:
    """Ordered string aggregation ``value`` joined by ``sep``.

    ``order``: rank columns; the value itself is always the last tie-break so
    the result is deterministic even when ranks repeat. ``where``: SQL
    predicate (e.g. ``role = 'cast' AND rank <= 5``). NULL values are
    skipped; a group with no non-NULL value gives NULL.
    """

    alias: str
    value: str
    order: Sequence[str] = ()
    where: str | None = None
    sep: str = " / "
    cast_value: bool = True

    def column(self) -> Column:
        v = _q(self.value)
        if self.cast_value:
            v = f"CAST({v} AS STRING)"
        keys = [_q(c) for c in self.order] + [v]
        sep = self.sep.replace("\\", "\\\\").replace("'", "\\'")
        sql = f"listagg({v}, '{sep}') WITHIN GROUP (ORDER BY {', '.join(keys)})"
        if self.where:
            sql += f" FILTER (WHERE {self.where})"
        return F.expr(sql).alias(self.alias)


@dataclass(frozen=True)
class CondAvg:
    """``avg(value)`` over the rows satisfying ``where`` (a pivot cell): SQL
    text, or a Column where it holds a value from outside."""

    alias: str
    value: str
    where: str | Column

    def column(self) -> Column:
        if isinstance(self.where, Column):
            return F.avg(F.when(self.where, F.col(_q(self.value)))).alias(self.alias)
        return F.expr(f"avg({_q(self.value)}) FILTER (WHERE {self.where})").alias(self.alias)


@dataclass
class ChildPart:
    """One child table and the aggregates taken from it in one pass."""

    df: DataFrame
    aggs: list = field(default_factory=list)
    prefilter: str | None = None  # pushed to the scan; OR of all agg predicates


def aggregate_child(part: ChildPart, key: str) -> DataFrame:
    df = part.df
    if part.prefilter:
        df = df.filter(part.prefilter)
    else:
        wheres = [a.where for a in part.aggs]
        if wheres and all(w is not None for w in wheres):
            # Every aggregate is filtered: rows matching none of them can go
            # before the shuffle (and into the Parquet scan as a pushed filter).
            any_of = F.lit(False)
            for w in wheres:
                any_of = any_of | (w if isinstance(w, Column) else F.expr(w))
            df = df.filter(any_of)
    return df.groupBy(key).agg(*[a.column() for a in part.aggs])


def wide_export(header: DataFrame, key: str, parts: Sequence[ChildPart],
                header_cols: Sequence[str] | None = None) -> DataFrame:
    """Header left-joined to the pre-aggregated children on ``key``.

    A header row without children keeps NULL list/pivot columns.
    """
    out = header if header_cols is None else header.select(*dict.fromkeys([key, *header_cols]))
    for part in parts:
        out = out.join(aggregate_child(part, key), on=key, how="left")
    return out
