import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.plans import routes as T
from strideflow.sources import matrices as M
from tests.conftest import rows

EDGE = "u long, v long, travel_time_s double, length_m double, link_id long, direction int"
GEOM = "array<struct<x:double,y:double>>"


def _line(spark):
    e = [(i, i + 1, 10.0, 100.0, i, 1) for i in range(5)] + [(i + 1, i, 10.0, 100.0, i, -1) for i in range(4)]
    g = [(i, [{"x": 100.0 * i, "y": 0.0}, {"x": 100.0 * i + 50, "y": 5.0}, {"x": 100.0 * i + 100, "y": 0.0}]) for i in range(5)]
    return spark.createDataFrame(e, EDGE), spark.createDataFrame(g, f"link_id long, geometry {GEOM}"), spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(6)], "node_id long, x double, y double")


def test_route_through_stops(spark):
    e, links, nodes = _line(spark)
    stops = spark.createDataFrame([(1, 1, 5.0, 3.0), (1, 2, 310.0, 0.0), (1, 3, 99.0, 0.0)], "route long, ord int, x double, y double")
    at = T.snapped_stops(stops, nodes)
    assert [(r.ord, r.node) for r in at.orderBy("ord").collect()] == [(1, 0), (2, 3), (3, 1)]
    steps = T.route_edges(e, at).cache()
    assert [(r.leg, r.link_id, r.direction) for r in steps.orderBy("step").collect()] == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 2, -1), (2, 1, -1)]
    assert rows(T.totals(steps, e)) == [(1, 50.0, 500.0, 5)]
    g = T.geometry_of(steps, links).first().geometry
    assert len(g) == 11 and (g[0].x, g[-1].x, g[6].x) == (0.0, 100.0, 300.0) and all(abs(a.x - b.x) == 50 for a, b in zip(g, g[1:]))


def test_routes_that_cannot_be(spark):
    e, _, nodes = _line(spark)
    kind = "route long, ord int, x double, y double"
    with pytest.raises(ValueError, match="no node within"):
        T.snapped_stops(spark.createDataFrame([(1, 1, 9999.0, 0.0)], kind), nodes)
    with pytest.raises(ValueError, match="same node"):
        T.route_edges(e, spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "route long, ord int, node long"))
    with pytest.raises(ValueError, match="has no way"):
        T.route_edges(e, spark.createDataFrame([(1, 1, 5), (1, 2, 0)], "route long, ord int, node long"))


def test_break_even(spark):
    t = spark.createDataFrame([(1, 1, 3.0, 0.0), (1, 1, 1.0, 0.0), (1, -1, 0.0, 10.0), (2, 1, 1.0, 0.0), (2, -1, 0.0, 99.0)], "pair long, side int, a double, b double")
    found = T.break_even(t, lambda c: F.col("a") * c * c + F.col("b"), 0.0, 5.0)
    got = {r.pair: r.value for r in found.collect()}
    assert abs(got[1] - 2.5**0.5) < 1e-6 and got[2] is None
    assert [r.pair for r in T.by_change(found, 1.0).collect()] == [1, 2]


def test_matrix_store(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    m = spark.createDataFrame([(1, 2, 120.0), (2, 5, float("inf")), (5, 5, None), (5, 1, 30.0)], "origin long, destination long, value double")
    M.write_matrix(m, ids, f"{tmp_path}/s", "time", "s")
    M.write_matrix(m, ids, f"{tmp_path}/s", "again", append=True)
    assert rows(M.read_matrix(spark, f"{tmp_path}/s", "time")) == [(1, 2, 120.0), (5, 1, 30.0)] and rows(M.read_matrix(spark, f"{tmp_path}/s", "time", 50.0)) == [(1, 2, 120.0)]
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in M.read_matrix(spark, f"{tmp_path}/s", "time", 50.0)._jdf.queryExecution().executedPlan().toString()
    assert rows(M.read_as(spark, f"{tmp_path}/s", "time")) == [(1, 2, 2.0), (5, 1, 0.5)]
    assert rows(M.origin_totals(spark, f"{tmp_path}/s")) == [("again", 1, 120.0), ("again", 5, 30.0), ("time", 1, 120.0), ("time", 5, 30.0)]
    for bad, message in ((spark.createDataFrame([(1,), (2,)], "id long"), "aren't among"), (spark.createDataFrame([(-1,), (1,), (2,), (5,)], "id long"), "from 0 on")):
        with pytest.raises(ValueError, match=message):
            M.write_matrix(m, bad, f"{tmp_path}/t", "x")
    with pytest.raises(ValueError, match="ids are others"):
        M.write_matrix(m, spark.createDataFrame([(1,), (2,), (5,), (6,)], "id long"), f"{tmp_path}/s", "x", append=True)
    M.write_dense(M.read_matrix(spark, f"{tmp_path}/s", "time"), [1, 2, 5], f"{tmp_path}/d.npz")
    with np.load(f"{tmp_path}/d.npz") as z:
        assert z["matrix"][0, 1] == 120.0 and np.isinf(z["matrix"][1, 2])
    assert rows(M.read_dense(spark, f"{tmp_path}/d.npz")) == [(1, 2, 120.0), (5, 1, 30.0)]
