"""Origin-destination tables as long DataFrames: alignment, overlay, stitching, summaries.

A cell that can't be reached is an absent row, never infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.sources.tables import read_table

KEYS = ["origin", "destination"]
#: Fixed value: upper edges of the trip-length bins in kilometres; the last bin is open.
BIN_EDGES_KM = (1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0)
#: Mean distance of two random points in a disc, in radii.
DISC_MEAN = 128 / (45 * 3.141592653589793)


def known(c: str) -> Column:
    """The value, NULL where it is NaN."""
    return F.when(~F.isnan(c), F.col(c))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip once, with NULL for unknown demand and for no path."""
    t = read_table(spark, sf_dir, "trip_lengths", ["trip_id", *KEYS, "demand", "length_m", "run_date"])
    return t.groupBy("trip_id").agg(*[F.first(c).alias(c) for c in (*KEYS, "run_date")], F.first(known("demand")).alias("demand"), F.first(known("length_m")).alias("length_m"))


def od_demand(t: DataFrame) -> DataFrame:
    """Demand a pair, duplicate rows added up; only what is above zero."""
    return t.where("demand > 0").groupBy(*KEYS).agg(F.sum("demand").alias("demand"))


def od_lengths(t: DataFrame) -> DataFrame:
    """Demand-weighted mean length a pair over the trips with a path."""
    ok = t.where("demand > 0 and length_m is not null")
    return ok.groupBy(*KEYS).agg((F.sum(F.col("demand") * F.col("length_m")) / F.sum("demand")).alias("length_m"), F.sum("demand").alias("demand"))


def threshold(od: DataFrame, least: float) -> DataFrame:
    """Pairs of at least so much demand; a threshold of zero or less does nothing."""
    return od.where(F.col("demand") >= least) if least > 0 else od


def place(od: DataFrame, ids: DataFrame) -> DataFrame:
    """``od`` with the positions of both ends in ``ids`` (``id``, ``position``); pairs with an unknown end are left out."""
    o = ids.select(F.col("id").alias("origin"), F.col("position").alias("o_pos"))
    d = ids.select(F.col("id").alias("destination"), F.col("position").alias("d_pos"))
    return od.join(o, "origin").join(d, "destination")


def overlay(base: DataFrame, model: DataFrame, value: str, cutoff: float | None = None) -> DataFrame:
    """``base`` with the model's value wherever it has one within the cutoff; ``replaced`` tells where."""
    m = model.select(*KEYS, F.col(value).alias("_m"))
    take = F.col("_m").isNotNull() & (F.lit(True) if cutoff is None else F.col("_m") <= cutoff)
    return base.join(m, KEYS, "left").select(*KEYS, F.when(take, F.col("_m")).otherwise(F.col(value)).alias(value), take.alias("replaced"))


def stitch(near: DataFrame, far: DataFrame, value: str) -> DataFrame:
    """The near tier where it has the pair, else the far tier."""
    both = near.select(*KEYS, F.col(value).alias("_n")).join(far.select(*KEYS, F.col(value).alias("_f")), KEYS, "full_outer")
    return both.select(*KEYS, F.coalesce("_n", "_f").alias(value), F.when(F.col("_n").isNotNull(), "near").otherwise("far").alias("tier"))


def difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``a`` minus ``b``; a missing pair counts as nothing."""
    both = a.select(*KEYS, F.col(value).alias("_a")).join(b.select(*KEYS, F.col(value).alias("_b")), KEYS, "full_outer")
    return both.select(*KEYS, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("difference"))


def compare(a: DataFrame, b: DataFrame, value: str, close: float) -> DataFrame:
    """Pairs of only one side, pairs in both, largest difference, and how many differ by more than ``close``."""
    both = a.select(*KEYS, F.col(value).alias("_a")).join(b.select(*KEYS, F.col(value).alias("_b")), KEYS, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    one = F.col("_a").isNull() != F.col("_b").isNull()
    return both.agg(F.count_if(one).alias("mismatched"), F.count(gap).alias("compared"), F.max(gap).alias("max_difference"), F.count_if(gap > close).alias("apart"))


def summary(od: DataFrame, value: str, zones: int | Column) -> DataFrame:
    """Pairs, share of all pairs that are reached, least, median and largest positive value."""
    v = F.when(F.col(value) > 0, F.col(value))
    return od.agg(F.count(value).alias("pairs"), F.min(v).alias("least"), F.expr(f"percentile(CASE WHEN {value} > 0 THEN {value} END, 0.5)").alias("median"), F.max(v).alias("largest"))


def bin_of(length_m: Column) -> Column:
    """The trip-length bin, from 0."""
    km, out = length_m / 1000, F.lit(len(BIN_EDGES_KM))
    for i in range(len(BIN_EDGES_KM) - 1, -1, -1):
        out = F.when(km < BIN_EDGES_KM[i], i).otherwise(out)
    return out
