"""Streams landed so that a replayed micro-batch changes nothing.

Every micro-batch overwrites a folder of its own, named by its number: the sink
is idempotent, and rows that come however late are kept.  What is read is the
union of the folders, each key once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Lands what there is of the stream, in as many micro-batches as its source makes of it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def landed(spark: SparkSession, path: str, key: str, latest: str) -> DataFrame:
    """The landed rows, of each key the one with the largest ``latest``; ties by the row's other columns."""
    t = spark.read.parquet(path).drop("batch")
    rest = [c for c in t.columns if c not in (key, latest)]
    return t.groupBy(key).agg(F.max(F.struct(latest, *rest)).alias("m")).select(key, "m.*")
