import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.operators.nearness import TriangleTree, nearest_within, pairs_within, regions_of_points, triangulate
from tests.conftest import rows

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]


def _points(n, size, seed=1):
    r = random.Random(seed)
    return [(i, round(r.uniform(-size, size), 1), round(r.uniform(-size, size), 1)) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_pairs_against_brute_force(spark, cell_rows):
    p = _points(150, 120) + [(1000 + i, 5.0, 5.0) for i in range(20)]
    df = spark.createDataFrame([*p, (7, None, 1.0), (8, float("nan"), 1.0), (None, 1.0, 1.0), p[3]], "k long, x double, y double").withColumn("a_id", F.lit("clash")).withColumn("cell", F.lit(1))
    want = sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in p for b in p if a[0] != b[0] and math.dist(a[1:], b[1:]) <= 40})
    assert rows(pairs_within(df, "k", 40.0, cell_rows=cell_rows)) == want
    assert pairs_within(df.limit(0), "k", 40.0).count() == 0


def test_pairs_at_the_limit(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0), (3, 80.5, 0.0)], "k long, x double, y double")
    assert rows(pairs_within(df, "k", 40.0)) == [(1, 2)]


def test_nearest_against_brute_force(spark):
    p, t = _points(120, 300), _points(150, 300, 2)
    a, b = spark.createDataFrame(p, "k long, x double, y double"), spark.createDataFrame([*t, (900, *t[0][1:]), (901, None, 0.0)], "n long, x double, y double")
    got = {r[0]: (r[3], round(r[4], 9)) for r in nearest_within(a, "k", b, "n", 60.0, cell_rows=5).collect()}
    want = {}
    for k, x, y in p:
        best = min(((math.dist((x, y), q[1:]), q[0]) for q in [*t, (900, *t[0][1:])]))
        if best[0] <= 60:
            want[k] = (best[1], round(best[0], 9))
    assert got == want


def test_triangulation_areas():
    area = lambda t: sum(abs((b[2] - b[0]) * (b[5] - b[1]) - (b[3] - b[1]) * (b[4] - b[0])) / 2 for b in t)
    assert area(triangulate([SQUARE])) == 100 and area(triangulate([SQUARE[::-1]])) == 100
    assert area(triangulate([SQUARE, HOLE])) == 96 and area(triangulate([SQUARE, HOLE[::-1]])) == 96
    comb = [(0, 0), (9, 0), (9, 5), (7, 5), (7, 1), (5, 1), (5, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5)]
    assert area(triangulate([comb])) == 9 + 4 * (2 + 2 + 1)
    holes = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x in (1, 4, 7) for y in (1, 4, 7)]
    assert abs(area(triangulate([SQUARE, *holes])) - 91) < 1e-9
    assert len(triangulate([])) == len(triangulate([[(0, 0), (1, 1)]])) == len(triangulate([[(0, 0), (1, 1), (2, 2)]])) == 0


def test_tree_finds_all():
    r = random.Random(3)
    star = [(50 + (40 if i % 2 else 15) * math.cos(i * math.pi / 20), 50 + (40 if i % 2 else 15) * math.sin(i * math.pi / 20)) for i in range(40)]
    tri = triangulate([star])
    tree = TriangleTree(tri, np.ones(len(tri), int))
    x, y = np.array([r.uniform(0, 100) for _ in range(2000)]), np.array([r.uniform(0, 100) for _ in range(2000)])
    inside = np.zeros(2000, bool)
    for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1]):
        inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    assert set(tree.regions(x, y)[0].tolist()) == set(np.flatnonzero(inside).tolist())


@pytest.mark.parametrize("most", [200_000, 2])
def test_regions(spark, most):
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    move = lambda r, dx: [(x + dx, y) for x, y in r]
    polys = spark.createDataFrame([(2, [ring(SQUARE), ring(HOLE)]), (1, [ring(move(SQUARE, 10))]), (3, [ring(HOLE)]), (4, None), (None, [ring(SQUARE)]), (5, [])], "m long, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 5.0), (4, 15.0, 5.0), (5, 30.0, 5.0), (6, None, 5.0), (1, 1.0, 1.0), (7, 4.0, 5.0)], "k long, x double, y double").withColumn("region", F.lit("clash"))
    got = {r[0]: r[3] for r in regions_of_points(pts, "k", polys, "m", broadcast_triangles=most, tile_points=2).collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 1, 7: 2}
    assert regions_of_points(pts.limit(0), "k", polys, "m").count() == 0 and regions_of_points(pts, "k", polys.limit(0), "m").count() == 0


def test_invalid_rings_are_taken_by_the_even_odd_rule():
    import numpy as np

    from strideflow.operators.nearness import TriangleTree, triangulate

    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    shapes = {
        "uneven bow-tie": [[(0, 0), (10, 7), (10, 0), (0, 9), (0, 0)]], "overlapping holes": [sq(0, 0, 10), sq(2, 2, 4), sq(4, 4, 4)], "hole over the edge": [sq(0, 0, 10), sq(7, 3, 6)],
        "hole in a hole": [sq(0, 0, 10), sq(1, 1, 8), sq(3, 3, 3)], "star": [[(5, 0), (8, 10), (0, 4), (10, 4), (2, 10), (5, 0)]], "valid": [sq(0, 0, 10), sq(3, 3, 2)],
        "touching itself": [[(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)], sq(4, 1, 1)],
    }
    r = np.random.default_rng(3)
    x, y = r.uniform(-1, 14, 4000), r.uniform(-1, 11, 4000)
    for name, rings in shapes.items():
        inside = np.zeros(len(x), int)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                up = (ay > y) != (by > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside += up & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        t = triangulate(rings)
        p, _ = TriangleTree(t, np.zeros(len(t), int)).regions(x, y)
        assert set(p.tolist()) == set(np.flatnonzero(inside % 2).tolist()), name
