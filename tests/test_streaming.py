from strideflow.streaming.landing import land, landed
from tests.conftest import rows


def test_landing_is_idempotent_and_keeps_late_rows(spark, tmp_path):
    src, kind = str(tmp_path / "in"), "k long, t long, v string"
    put = lambda *r: spark.createDataFrame(list(r), kind).coalesce(1).write.mode("append").parquet(src)
    go = lambda: land(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "rows"), str(tmp_path / "check"))
    put((1, 10, "a"), (2, 10, "b"), (1, 11, "c"))
    go()
    go()
    put((2, 5, "late"), (3, 1, None))
    go()
    assert [tuple(r) for r in sorted(landed(spark, str(tmp_path / "rows"), "k", "t").collect())] == [(1, 11, "c"), (2, 10, "b"), (3, 1, None)]
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5
    assert rows(spark.read.parquet(str(tmp_path / "rows")).select("batch").distinct()) == [(0,), (1,)]
