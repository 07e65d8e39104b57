import random

import numpy as np
from pyspark.sql import functions as F

from strideflow.plans import graph as G
from strideflow.plans import zones as Z
from tests.conftest import rows

EDGE = "u long, v long, travel_time_s double, length_m double, link_id long, direction int"
POINT = "zone long, node_id long, weight double, access_s double, access_m double, cell_radius_m double"


def _grid(spark, n=6):
    """n x n nodes 100 m and 10 s apart."""
    e, k = [], 0
    for i in range(n * n):
        for j in ([i + 1] if i % n < n - 1 else []) + ([i + n] if i < n * n - n else []):
            e += [(i, j, 10.0, 100.0, k, 1), (j, i, 10.0, 100.0, k, -1)]
            k += 1
    return spark.createDataFrame(e, EDGE)


def test_zones_that_share_an_id(spark):
    sq = lambda x, y, w: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]
    kind = "id long, zone long, rings array<array<struct<x:double,y:double>>>"
    p = spark.createDataFrame([(1, 7, [sq(0, 0, 10), sq(2, 2, 2)]), (2, 3, [sq(50, 0, 4)]), (3, 7, [sq(100, 100, 1)]), (4, None, [sq(0, 0, 1)])], kind)
    d = Z.dissolved(p, "zone", "id")
    assert rows(d.select("zone", F.size("parts"), "area_m2", "position")) == [(3, 1, 16.0, 1), (7, 2, 97.0, 0)]
    got = {r.zone: (r.x, r.y) for r in Z.inner_points(p, "zone").collect()}
    assert got[3] == (52.0, 2.0) and 4 < got[7][0] < 10 and 0 < got[7][1] < 10


def _brute(x, y, w, k):
    if len(x) <= k:
        return len(x)
    x0, y0 = x.min(), y.min()
    occupied = lambda c: len(set(zip(np.floor((x - x0) / c).tolist(), np.floor((y - y0) / c).tolist())))
    cell = max(np.ptp(x), np.ptp(y)) / np.sqrt(k)
    while occupied(cell) > k:
        cell *= 1.3
    lo, hi = 0.0, cell
    for _ in range(16):
        mid = 0.5 * (lo + hi)
        n = occupied(mid)
        if n <= k:
            hi = mid
            if n == k:
                break
        else:
            lo = mid
    return hi


def test_fitted_cells_and_reduced_points(spark):
    r = random.Random(5)
    c = [(z, r.gauss(0, 50) + 400 * (k % 3), r.uniform(0, 90) ** 1.2, r.choice([0.0, 1.0, 3.5])) for z, n in ((1, 80), (2, 5), (3, 300), (4, 9)) for k in range(n)] + [(5, 1.0, 1.0, 0.5)] * 12 + [(6, float(k), 0.0, 0.0) for k in range(20)]
    df = spark.createDataFrame(c, "zone long, x double, y double, weight double").repartition(5)
    fit = {q.zone: q.cell for q in Z.fitted_cells(df, 8).collect()}
    got = Z.reduced_points(df, 8).toPandas()
    for z in (1, 3, 4, 6):
        x, y, w = (np.array([q[i] for q in c if q[0] == z]) for i in (1, 2, 3))
        w = w if w.sum() > 0 else np.ones(len(w))
        assert abs(fit[z] - _brute(x, y, w, 8)) < 1e-9 * fit[z]
        g = got[got.zone == z]
        assert len(g) <= 8 and abs(g.weight.sum() - w.sum()) < 1e-9 and abs((g.weight * g.x).sum() - (w * x).sum()) < 1e-6
        whole = (w * (x**2 + y**2)).sum()
        assert abs((g.weight * (g.moment + g.x**2 + g.y**2)).sum() - whole) < 1e-6 * whole
    assert len(got[got.zone == 2]) == 5 and len(got[got.zone == 5]) == 1 and got[got.zone == 5].weight.item() == 6.0
    assert Z.reduced_points(df.limit(0), 8).count() == 0


def test_points_of_a_zone_at_one_node_are_one(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.25, 10.0), (1, 4.0, 0.0, 0.25, 0.0), (1, 900.0, 0.0, 0.4, 0.0), (1, 9000.0, 0.0, 0.1, 0.0)], "zone long, x double, y double, weight double, moment double")
    n = spark.createDataFrame([(5, 2.0, 0.0), (6, 900.0, 3.0)], "node_id long, x double, y double")
    got = {r.node_id: r for r in Z.snapped_points(p, n, 100.0, 2.0).collect()}
    assert set(got) == {5, 6} and abs(got[5].weight - 0.5 / 0.9) < 1e-12 and got[5].x == 2.0 and got[5].access_m == 2.0 and got[5].access_s == 1.0
    assert abs(got[5].cell_radius_m - (2 * (5.0 + 4.0)) ** 0.5) < 1e-9 and got[6].cell_radius_m == 0.0


def test_runs_of_whole_zones(spark):
    assert list(Z.chunks(iter([(1, 3), (2, 4), (3, 9), (4, 1), (5, 1)]), 7)) == [(1, 2, 7), (3, 3, 9), (4, 5, 2)]
    assert list(Z.chunks(iter([]), 7)) == []


def test_self_pairs_are_priced_or_dropped(spark):
    e = _grid(spark)
    p = spark.createDataFrame([(1, 0, 0.5, 2.0, 8.0, 30.0), (1, 1, 0.5, 2.0, 8.0, 0.0), (2, 20, 1.0, 1.0, 4.0, 0.0)], POINT)
    got = {(r.origin, r.destination): r for r in Z.priced_matrix(e, p, 1000.0, 4.0).collect()}
    inside = 1.3 * Z.DISC_MEAN * 30.0
    pairs = [(0.25, 14.0), (0.25, 14.0), (0.25, 4.0 + inside / 4)]
    assert abs(got[1, 1].seconds - sum(w * s for w, s in pairs) / 0.75) < 1e-9 and abs(got[1, 1].fraction - 1) < 1e-9
    assert (2, 2) not in got and abs(got[1, 2].seconds - (0.5 * (50 + 3) + 0.5 * (40 + 3))) < 1e-9
    log = {(r.origin, r.destination): r.seconds for r in Z.priced_matrix(e, p, 1000.0, 4.0, rate=0.05).collect()}
    assert abs(log[1, 2] - (-np.log(0.5 * np.exp(-0.05 * 53) + 0.5 * np.exp(-0.05 * 43)) / 0.05)) < 1e-9


def test_no_demand_is_lost(spark):
    e = _grid(spark).unionByName(spark.createDataFrame([(900, 901, 5.0, 5.0, 77, 1)], EDGE))
    p = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 10.0), (1, 1, 0.5, 0.0, 0.0, 0.0), (2, 35, 0.6, 0.0, 0.0, 0.0), (2, 34, 0.4, 0.0, 0.0, 0.0), (3, 7, 1.0, 0.0, 0.0, 0.0), (4, 900, 1.0, 0.0, 0.0, 0.0), (5, 0, 0.5, 0.0, 0.0, 0.0), (5, 900, 0.5, 0.0, 0.0, 0.0)], POINT)
    r = random.Random(3)
    d = [(a, b, float(r.randrange(9))) for a in range(1, 7) for b in range(1, 7)]
    df = spark.createDataFrame(d, "origin long, destination long, demand double")
    x = Z.expanded(df, p).cache()
    total = sum(v for _, _, v in d)
    assert abs(x.agg(F.sum("demand")).first()[0] - total) < 1e-9
    kinds = {k: v for k, v in rows(x.groupBy("kind").agg(F.sum("demand")))}
    assert kinds["unplaced"] == sum(v for a, b, v in d if a == b and a in (3, 4)) and kinds["unknown"] == sum(v for a, b, v in d if 6 in (a, b))
    out = Z.assign_zones(e, df, p, 35.0, 95.0).cache()
    zone = {k: v for k, v in rows(out.where("kind <> 'volume'").groupBy("kind").agg(F.sum("value")))}
    assert abs(sum(zone.values()) - total) < 1e-9 and {"near", "far", "missed", "stranded", "within", "same_node", "unplaced", "unknown"} <= set(zone)
    near = x.where("kind = 'pair'").select("origin", "destination", "demand")
    vol = G.link_volumes(G.assign(e, near, 35.0)).agg(F.sum("volume")).first()[0]
    assert out.where("kind = 'volume'").agg(F.sum("value")).first()[0] > vol > 0
