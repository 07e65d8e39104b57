"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key beyond which its rows stay where they are.
HOT_ROWS = 1_000_000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to ``table``, which has each ``key`` once.

    Keys with over ``hot_rows`` rows are looked up by broadcast (there are at
    most as many as rows / ``hot_rows``), the others by shuffle, so that no
    task gets all rows of a key.  ``rows`` should be a stored table: it is
    counted first, and by key where it has more than ``hot_rows`` rows.
    """
    if rows.count() <= hot_rows:
        return rows.join(table, key, how)
    hot = [r[0] for r in rows.groupBy(key).count().where(F.col("count") > hot_rows).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    held = rows.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {rows.schema[key].dataType.simpleString()}")
    few = F.broadcast(table.join(F.broadcast(held), key, "left_semi"))
    rest = rows.join(F.broadcast(held), key, "left_anti").join(table, key, how)
    return rows.join(F.broadcast(held), key, "left_semi").join(few, key, how).unionByName(rest)
