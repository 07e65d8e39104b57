"""Matrices as long tables in a store: a folder for each matrix, beside the ids that all of them share."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_matrix(matrix: DataFrame, ids: DataFrame, path: str, name: str, units: str = "", append: bool = False) -> None:
    """Writes ``matrix`` (``origin``, ``destination``, ``value``) as ``name``, single precision; NULL and not finite values are left out.

    ``ids`` (``id``) are whole numbers from 0 on and must be those of the store
    where it is appended to; ends that they lack are refused.
    """
    spark = matrix.sparkSession
    wanted = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    if wanted.where("id is null or id < 0").limit(1).count():
        raise ValueError("ids must be whole numbers from 0 on")
    ends = matrix.select(F.explode(F.array("origin", "destination")).alias("id")).distinct()
    if ends.join(wanted, "id", "left_anti").limit(1).count():
        raise ValueError("the matrix has ends that aren't among the ids")
    fs, p = _path(spark, f"{path}/ids")
    if append and fs.exists(p):
        old = spark.read.parquet(f"{path}/ids")
        if old.exceptAll(wanted).limit(1).count() or wanted.exceptAll(old).limit(1).count():
            raise ValueError("the store's ids are others")
    else:
        wanted.write.mode("overwrite").parquet(f"{path}/ids")
    value = F.col("value").cast("float")
    kept = matrix.select("origin", "destination", value.alias("value")).where("value is not null and not isnan(value) and abs(value) < 1e38")
    kept.write.mode("overwrite").parquet(f"{path}/matrix={name}")
    spark.createDataFrame([(json.dumps({"units": units}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/units-{name}")


def read_matrix(spark: SparkSession, path: str, name: str, least: float | None = None) -> DataFrame:
    """``(origin, destination, value)`` of a matrix; with ``least`` only values above it: the filter reaches the scan."""
    t = spark.read.parquet(f"{path}/matrix={name}").withColumn("value", F.col("value"))
    return t if least is None else t.where(F.col("value") > F.lit(least).cast("float"))


def read_units(spark: SparkSession, path: str, name: str) -> str:
    return json.loads(spark.read.text(f"{path}/units-{name}").first()[0])["units"]


def read_as(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A routed matrix in the units of reports: seconds as minutes, metres as kilometres."""
    per = {"s": 60.0, "m": 1000.0}.get(read_units(spark, path, name), 1.0)
    return read_matrix(spark, path, name).withColumn("value", F.col("value").cast("double") / per)


def origin_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(matrix, origin, total)`` over all matrices of the store."""
    return spark.read.option("basePath", path).parquet(f"{path}/matrix=*").groupBy("matrix", "origin").agg(F.sum(F.col("value").cast("double")).alias("total"))


def read_dense(spark: SparkSession, file: str, ids: str = "ids", matrix: str = "matrix") -> DataFrame:
    """The cells above zero of a square array file (``.npz``) with its ids, as a long table; the file is one driver's, of what fits its memory."""
    with np.load(file) as z:
        names, m = np.asarray(z[ids]), np.asarray(z[matrix], float)
    if m.shape != (len(names), len(names)):
        raise ValueError(f"the matrix is {m.shape}, its ids are {len(names)}")
    o, d = np.nonzero(np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0) > 0)
    return spark.createDataFrame(pa.table({"origin": pa.array(names[o]), "destination": pa.array(names[d]), "value": pa.array(m[o, d])}))


def write_dense(matrix: DataFrame, ids: list, file: str) -> None:
    """The long table as a square array file over ``ids``; what isn't there is infinite."""
    at = {k: i for i, k in enumerate(ids)}
    m = np.full((len(ids), len(ids)), np.inf)
    for r in matrix.select("origin", "destination", "value").toLocalIterator():
        if r.origin in at and r.destination in at:
            m[at[r.origin], at[r.destination]] = r.value
    np.savez_compressed(file, ids=np.array(ids), matrix=m)
