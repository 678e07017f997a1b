"""Pages of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST = 200, 2000


def int_arg(value: object, default: int, least: int, most: int) -> int:
    """A number or numeric string within bounds; anything else is the default."""
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        number = default
    return max(least, min(most, number))


def page(df: DataFrame, *order: Column | str, offset: object = 0, limit: object = DEFAULT_LIMIT) -> DataFrame:
    """The rows of one page, each with the envelope: total, offset, limit, returned and has_more.

    ``order`` must order all rows. The offset echoed is the one used: no more than the total.
    """
    start, size = int_arg(offset, 0, 0, 1 << 31), int_arg(limit, DEFAULT_LIMIT, 1, MOST)
    rows = df.orderBy(*order).offset(start).limit(size)
    total = df.agg(F.count("*").alias("total"))  # one row
    at = F.least(F.lit(start).cast("long"), F.col("total"))
    returned = F.least(F.lit(size).cast("long"), F.col("total") - at)
    out = rows.join(F.broadcast(total))
    return out.withColumns({"offset": at, "limit": F.lit(size).cast("long"), "returned": returned, "has_more": at + returned < F.col("total")})


def first(df: DataFrame, limit: object, *order: Column | str, default: int = DEFAULT_LIMIT, most: int = MOST) -> DataFrame:
    """The first rows in a total order, so that a limit gives the same rows each time."""
    return df.orderBy(*order).limit(int_arg(limit, default, 1, most))
