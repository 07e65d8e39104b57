"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only ``columns`` if given, so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table_stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a table's files: what a stored result of it must still agree with."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = status.listStatus(path)
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)
