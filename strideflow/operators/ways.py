"""Ways as lists of node references: junctions, and links from junction to junction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(ways: DataFrame) -> DataFrame:
    """``(way, pos, ref, n)``: every reference with its position and the way's length."""
    return ways.where(F.size("refs") > 1).select("way", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))


def junction_marks(ways: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``(way, pos, ref)`` where a way is cut: its ends, references used more than once anywhere, and those in ``extra`` (``ref``)."""
    x = exploded(ways)
    many = x.groupBy("ref").count().where("count > 1").select("ref")
    if extra is not None:
        many = many.unionByName(extra.select("ref")).distinct()
    marked = x.join(many.withColumn("hit", F.lit(True)), "ref", "left")
    return marked.where(F.col("hit") | (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).select("way", "pos", "ref")


def split_ways(ways: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``(way, piece, u, v, first, last)``: the stretches between consecutive marks of a way."""
    w = Window.partitionBy("way").orderBy("pos")
    m = junction_marks(ways, extra).withColumns({"v": F.lead("ref").over(w), "last": F.lead("pos").over(w), "piece": F.row_number().over(w)})
    return m.where("v is not null").select("way", "piece", F.col("ref").alias("u"), "v", F.col("pos").alias("first"), "last")
