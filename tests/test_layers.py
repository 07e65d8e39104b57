import random

import pytest
from pyspark.sql import functions as F

from strideflow.plans import layers as Y
from tests.conftest import rows

GEOM = "array<struct<x:double,y:double>>"


def test_construction_sites_and_whole_ways(spark):
    ways = spark.createDataFrame([
        (1, [1, 2, 3], {"highway": "construction", "construction": "cycleway", "name": "x"}), (2, [3, 4], {"highway": "construction", "construction": "a;b"}), (3, [2, 5], {"highway": "path"}),
        (4, [1, 99], {"highway": "path"}), (5, [1], {"highway": "path"}), (6, [4, 5], {"name": "no road"}),
    ], "way long, refs array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 6)], "node_id long, x double, y double")
    built = {r.way: (r.tags["highway"] if "highway" in r.tags else None, r.under_construction) for r in Y.as_built(ways).collect()}
    assert built == {1: ("cycleway", True), 2: ("construction", False), 3: ("path", False), 4: ("path", False), 5: ("path", False), 6: (None, False)}
    e = Y.extract(ways, nodes, {"highway": ("construction",)}, tags=("highway", "oneway:bicycle"))
    assert rows(e.select("link_id", "way", "u", "v", "highway", "length_m", "under_construction")) == [(0, 1, 1, 2, "cycleway", 1.0, True), (1, 1, 2, 3, "cycleway", 1.0, True), (2, 3, 2, 5, "path", 3.0, False)]
    assert rows(Y.placed_ways(ways, nodes, (4.5, -1, 9, 1)).select("way")) == [(3,), (6,)]
    assert Y.extract(ways.limit(0), nodes, {}).count() == 0


def test_loose_ends_in_order(spark):
    r = random.Random(3)
    links = []
    for k in range(60):
        p = [(r.uniform(0, 25), r.uniform(0, 25)) for _ in range(2)]
        links.append((k, r.choice([None, 0, k + 1000]), r.choice([None, k + 2000]), [{"x": x, "y": y} for x, y in p]))
    df = spark.createDataFrame(links, f"link_row long, u long, v long, geometry {GEOM}")
    ends = [(0, k, u or 0, g[0]) for k, u, _, g in links] + [(1, k, v or 0, g[1]) for k, _, v, g in links]
    near = lambda a, b: (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2
    want, left = {}, []
    for side, k, node, p in ends:
        best = min(((near(p, q), n) for _, _, n, q in ends if n), default=(9e9, 0))
        if node or best[0] <= 4:
            want[side, k] = node or best[1]
        else:
            left.append((side, k, p))
    label = {}
    n = 0
    for side, k, p in left:
        if (side, k) not in label:
            n += 1
            for s2, k2, q in left:
                if near(p, q) <= 4 and (s2, k2) not in label:
                    label[s2, k2] = -n
    want |= label
    got = Y.resolve_ends(df).collect()
    assert {(0, x.link_row): x.u for x in got} | {(1, x.link_row): x.v for x in got} == want and n > 5


def test_connectors_merge_and_refuse(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 40.0, 0.0), (4, 50.0, 0.0), (5, 200.0, 0.0), (6, 210.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "u long, v long")
    c = Y.island_connectors(nodes, edges, 500.0, least_nodes=2)
    assert rows(c.select("link_id", "u", "v", "kind", "speed_override_kmh", "length_m", "u_part_nodes")) == [(-2, 4, 5, "island", 0.1, 150.0, 2), (-1, 2, 3, "gap", None, 30.0, 2)]
    assert rows(Y.island_ids(c)) == [(-2,)] and Y.island_ids(c.drop("kind")).count() == 2
    links = spark.createDataFrame([(7, 1, 2, "asphalt")], "link_id long, u long, v long, surface string")
    m = Y.merge_connectors(links, c)
    assert m.count() == 3 and m.where("surface is null").count() == 2 and "kind" in m.columns
    with pytest.raises(ValueError, match="also in the link layer"):
        Y.merge_connectors(links.withColumn("link_id", F.lit(-1).cast("long")), c)
    assert Y.island_connectors(nodes, edges, 500.0, least_nodes=3).count() == 0


def test_runs_new_and_old(spark):
    links = spark.createDataFrame([(0, 5, 1, 2), (1, 6, 2, 3), (2, 7, 1, 2), (3, 8, 3, 2)], "link_row long, link_id long, u long, v long")
    run = spark.createDataFrame([(5, 1, 1, 2, 4.0, 9.0), (5, -1, 2, 1, 2.0, 8.0), (6, 1, 2, 3, 1.0, 7.0), (99, 1, 8, 9, 5.0, 1.0)], "link_id long, direction int, u long, v long, volume double, travel_time_s double")
    got = {r.link_row: tuple(r)[1:] for r in Y.run_on_links(run, links).collect()}
    assert got == {0: (4.0, 2.0, 9.0, 8.0), 1: (1.0, 0.0, 7.0, None), 2: (0.0, 0.0, None, None), 3: (0.0, 0.0, None, None)}
    old = Y.run_on_links(run.select("u", "v", "volume"), links)
    assert {r.link_row: (r.forward, r.reverse) for r in old.collect()} == {0: (4.0, 2.0), 1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert abs(Y.placed_share(run, old).first().share - 7 / 12) < 1e-9
    with pytest.raises(KeyError):
        Y.measure(old, "speed")
