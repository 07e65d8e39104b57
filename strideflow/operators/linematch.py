"""Lines of one layer matched onto lines of another by samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions.geometry import point_segment, samples, segments
from strideflow.operators.nearness import CELL_ROWS, _cells, _own_cell, _salted

DECAY_M = 10.0


def line_claims(sources: DataFrame, targets: DataFrame, reach: float = 12.0, cos: float = 0.7071067811865476, spacing: float = 20.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(source, i, target, distance, forward)`` of every sample of a source and every target beside it.

    ``sources`` (``source``, ``geometry``), ``targets`` (``target``,
    ``geometry``).  Beside: at most ``reach`` away, running within the angle
    either way.  Samples meet targets in the cells of a grid, crowded cells
    being salted.  NULL, empty and pointlike geometries claim nothing.
    """
    w = reach * 1.5
    s = sources.withColumn("segs", segments("geometry")).where(F.size("segs") > 0).select("source", F.posexplode(samples(F.col("segs"), spacing)).alias("i", "p"))
    s = s.withColumns({"a_id": F.concat_ws(":", "source", "i"), "ax": F.col("p.x"), "ay": F.col("p.y")}).withColumn("cell", _own_cell(F.col("ax"), F.col("ay"), w))
    t = targets.withColumn("tsegs", segments("geometry")).where(F.size("tsegs") > 0).select("target", "tsegs")
    spots = F.concat(samples(F.col("tsegs"), reach), F.transform(F.col("tsegs"), lambda g: F.struct(g["bx"].alias("x"), g["by"].alias("y"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"))))
    keyed = t.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(spots, lambda p: _cells(p["x"], p["y"], w))))))
    left, right = _salted(s, keyed, cell_rows)
    best = F.array_min(F.transform("tsegs", lambda g: F.struct(F.coalesce(point_segment(F.col("p"), g, cos), F.lit(1e9)).alias("d"), (F.col("p.ux") * (g["bx"] - g["ax"]) + F.col("p.uy") * (g["by"] - g["ay"]) >= 0).alias("f"))))
    return left.join(right, ["cell", "salt"]).withColumn("b", best).where(F.col("b.d") <= reach).select("source", "i", "target", F.col("b.d").alias("distance"), F.col("b.f").alias("forward"))


def weighed(claims: DataFrame) -> DataFrame:
    """Per source and target: the claims' weight in all and in each direction, their number and mean distance."""
    w = F.exp(-F.col("distance") / DECAY_M)
    return claims.groupBy("source", "target").agg(F.sum(w).alias("weight"), F.sum(F.when(F.col("forward"), w).otherwise(0.0)).alias("along"), F.sum(F.when(~F.col("forward"), w).otherwise(0.0)).alias("against"), F.count("*").alias("samples"), F.avg("distance").alias("distance"))


def coverage(claims: DataFrame, sources: DataFrame, spacing: float = 20.0) -> DataFrame:
    """Share of each source's samples that have a target beside them."""
    n = sources.withColumn("segs", segments("geometry")).where(F.size("segs") > 0).select("source", F.size(samples(F.col("segs"), spacing)).alias("n"))
    got = claims.select("source", "i").distinct().groupBy("source").agg(F.count("*").alias("hit"))
    return n.join(got, "source", "left").select("source", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("coverage"))


def winners(weights: DataFrame, covered: DataFrame, least: float = 0.5) -> DataFrame:
    """The source with the most weight on each target, of the sources covered by ``least`` at least; ties to the smaller source."""
    ok = weights.join(covered.where(F.col("coverage") >= least), "source")
    return ok.groupBy("target").agg(F.min(F.struct((-F.round("weight", 9)).alias("w"), "source", "distance")).alias("m")).select("target", "m.source", "m.distance")
