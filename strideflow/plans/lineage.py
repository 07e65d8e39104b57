"""Cutting lineage between the rounds of iterative operators.

A round's table is written once to the folder the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so it survives the loss of
any of them) and read back as an ordinary parquet scan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode without the setting."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strideflow-")
        forget_later(spark, _own[app])
    return _own[app]


def _delete(spark_jvm, path: str) -> None:
    try:
        jvm, conf = spark_jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the folder goes with it
        pass


def cut(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, with no lineage behind it; in folders of their own for the values of ``by``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.append(((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()), path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget_later(spark: SparkSession, path: str) -> None:
    """``path`` is deleted when the program ends, as all cuts are."""
    _written.append(((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()), path))


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`cut` returned and that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    for item in [x for x in _written if x[1] == path]:
        _delete(*item)
        _written.remove(item)


@atexit.register
def _drop_all() -> None:
    for item in reversed(_written):
        _delete(*item)
    _written.clear()
