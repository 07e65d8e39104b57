"""Files that come and go with the engine: point and demand CSV, networks, observation logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the stored network; others are refused.
NETWORK_VERSION = 1
DELIMITERS = ";\t,|"


def temporary(spark: SparkSession, path: str) -> None:
    """``path`` goes with the session's cuts: a written result that a query reads back at once."""
    from strideflow.plans.lineage import forget_later

    forget_later(spark, path)


def sniff_delimiter(header: str) -> str:
    """The delimiter that the header line holds most of."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).limit(1).collect()
    delimiter = sniff_delimiter(first[0][0]) if first else ","
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=False)


def number(c: Column) -> Column:
    """A number as people write it: blanks and no-break blanks in it, a decimal comma; else NULL."""
    return F.replace(F.translate(c, "   ", ""), F.lit(","), F.lit(".")).try_cast("double")


def read_points(spark: SparkSession, path: str, id_column: str, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """``(id, x, y, weight)`` of a CSV with any usual delimiter; weights that are missing count 1, negative or not finite ones 0."""
    t = _read_csv(spark, path)
    w = F.lit(1.0)
    if weight:
        v = number(F.col(weight))
        w = F.when(F.col(weight).isNull(), 1.0).when(v.isNull() | F.isnan(v) | (v < 0) | (v > 1e300), 0.0).otherwise(v)
    return t.select(F.col(id_column).alias("id"), number(F.col(x)).alias("x"), number(F.col(y)).alias("y"), w.alias("weight"))


def read_demand(spark: SparkSession, path: str, origin: str = "origin", destination: str = "destination", demand: str = "demand") -> DataFrame:
    """A long demand table under our names; rows without a number are left out."""
    t = _read_csv(spark, path)
    return t.select(F.col(origin).try_cast("bigint").alias("origin"), F.col(destination).try_cast("bigint").alias("destination"), number(F.col(demand)).alias("demand")).where("origin is not null and destination is not null and demand is not null")


def write_network(edges: DataFrame, path: str, mode: str) -> None:
    """Edges beside a note of version and mode; the note is written last, so that half a network is never read."""
    spark = edges.sparkSession
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame([(json.dumps({"version": NETWORK_VERSION, "mode": mode}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def read_network(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """The edges of a stored network; another version or mode is refused."""
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    if note["version"] != NETWORK_VERSION:
        raise ValueError(f"the network has version {note['version']}, wanted is {NETWORK_VERSION}")
    if note["mode"] != mode:
        raise ValueError(f"the network is for {note['mode']}, wanted is {mode}")
    return spark.read.parquet(f"{path}/edges")


def append_observations(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
