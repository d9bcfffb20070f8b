"""Value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ifnull(*cols: Column, floating: bool = False) -> Column:
    """The first value that is not NULL (and, for floating columns with
    ``floating=True``, not NaN). Timestamps and text pass through as they
    are, like the reference's type guard."""
    if floating:
        cols = tuple(F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in cols)
    return F.coalesce(*cols)
