"""Global numbers and running totals without a single-partition window.

Rows are range-partitioned and sorted; each partition numbers its own rows, and
the partitions' totals (one row each) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.plans.lineage import cut


def _placed(df: DataFrame, order: list) -> DataFrame:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"__o{i}": c for i, c in enumerate(cols)})
    keys = [f"__o{i}" for i in range(len(cols))]
    return cut(named.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))


def running(df: DataFrame, order: list, value: Column | None = None, name: str = "n") -> DataFrame:
    """``df`` with ``name``: the total of ``value`` (1 by default) over all rows up to and with this one, in the given order.

    The order must be total, or rows of equal keys get their places by chance.
    """
    value = F.lit(1) if value is None else value
    placed = _placed(df.withColumn("__v", value), order)
    keys = [c for c in placed.columns if c.startswith("__o")]
    sums = placed.groupBy("__p").agg(F.sum("__v").alias("s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("__p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, F.sum("__v").over(w) + F.col("__before")).drop("__p", "__v", "__before", *keys)
