import random

import pytest
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.operators.linematch import coverage, line_claims, weighed, winners
from strideflow.operators.ways import junction_marks, split_ways
from strideflow.plans import graph as G
from strideflow.plans import links as L
from strideflow.plans.demand import overlay, stitch
from strideflow.plans.numbering import running
from strideflow.queries import network as N
from tests.conftest import rows

EDGE = "u long, v long, travel_time_s double, length_m double, link_id long, direction int"


def _line(spark, n=5):
    e = [(i, i + 1, 10.0, 100.0, i, 1) for i in range(n - 1)] + [(i + 1, i, 10.0, 100.0, i, -1) for i in range(n - 1)]
    return spark.createDataFrame(e, EDGE)


def _random(spark, n=60, seed=4):
    r = random.Random(seed)
    e = [(i, (i + 1) % n, r.uniform(1, 60), r.uniform(1, 60), i, 1) for i in range(n)] + [(r.randrange(n), r.randrange(n), r.uniform(1, 60), r.uniform(1, 60), n + k, 1) for k in range(2 * n)]
    return spark.createDataFrame([x for x in e if x[0] != x[1]], EDGE)


def test_matrix_on_a_line(spark):
    e = _line(spark)
    m = G.od_matrix(e, spark.createDataFrame([(0,), (77,), (None,)], "node_id long"), 30.0)
    assert rows(m) == [(0, 0, 0.0, 0.0), (0, 1, 10.0, 100.0), (0, 2, 20.0, 200.0), (0, 3, 30.0, 300.0)]


def test_distance_follows_the_fastest_way(spark):
    e = spark.createDataFrame([(1, 2, 10.0, 900.0, 1, 1), (2, 3, 10.0, 900.0, 2, 1), (1, 3, 60.0, 100.0, 3, 1)], EDGE)
    assert (1, 3, 20.0, 1800.0) in rows(G.od_matrix(e, spark.createDataFrame([(1,)], "node_id long"), 100.0))


def test_relational_twin_and_partitions_agree(spark):
    e = L.fastest_parallel(_random(spark))
    s = e.select(F.col("u").alias("node_id")).distinct()
    a = {(r[0], r[1]): round(r[2], 6) for r in G.od_matrix(e, s, 90.0).collect()}
    b = {(r[0], r[1]): round(r[2], 6) for r in G.relational_matrix(e, s, 90.0).collect()}
    assert a == b and len(a) > 500


def test_relational_search_never_ends_early(spark):
    e, s = _line(spark, 6), spark.createDataFrame([(0,)], "node_id long")
    assert rows(G.relational_matrix(e, s, 100.0)) == [(0, i, 10.0 * i) for i in range(6)]
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        G.relational_matrix(e, s, 100.0, rounds=3)


def test_assignment_conserves(spark):
    e = L.fastest_parallel(_random(spark))
    r = random.Random(5)
    dem = spark.createDataFrame([(r.randrange(60), r.randrange(66), float(r.randrange(4))) for _ in range(400)], "origin long, destination long, demand double")
    out = G.assign(e, dem, 120.0).cache()
    vol = G.link_volumes(out).join(e.select("link_id", "travel_time_s", "direction"), ["link_id", "direction"]).agg(F.sum(F.col("volume") * F.col("travel_time_s"))).first()[0]
    m = G.od_matrix(e, dem.select(F.col("origin").alias("node_id")).distinct(), 120.0)
    want = dem.groupBy("origin", "destination").agg(F.sum("demand").alias("demand")).join(m, ["origin", "destination"]).agg(F.sum(F.col("demand") * F.col("seconds"))).first()[0]
    assert abs(vol - want) < 1e-6
    ok = dem.where("demand > 0 and origin <> destination").agg(F.sum("demand")).first()[0]
    missed = out.where("kind = 'missed'").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    placed = dem.where("demand > 0 and origin <> destination").groupBy("origin", "destination").agg(F.sum("demand").alias("x")).join(out.where("kind = 'length'").select("origin", "destination"), ["origin", "destination"]).agg(F.sum("x")).first()[0]
    assert abs(missed + placed - ok) < 1e-9


def test_select_link_volume_is_the_links_full_volume(spark):
    e = L.fastest_parallel(_random(spark))
    dem = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(20, 40)], "origin long, destination long, demand double")
    full = {r.link_id: r.volume for r in G.link_volumes(G.assign(e, dem, 500.0)).collect()}
    link = max(full, key=full.get)
    some = {r.link_id: r.volume for r in G.link_volumes(G.assign(e, dem, 500.0, [link])).collect()}
    assert some[link] == full[link] and all(v <= full[k] + 1e-9 for k, v in some.items())


def test_zone_matrix_with_single_points_is_the_point_matrix(spark):
    e = _line(spark)
    p = spark.createDataFrame([(1, 0, 1.0, 0.0), (2, 3, 1.0, 5.0)], "zone long, node_id long, weight double, access_s double")
    assert rows(G.zone_matrix(e, p, 100.0)) == [(1, 2, 35.0, 1.0), (2, 1, 35.0, 1.0)]
    two = spark.createDataFrame([(1, 0, 0.5, 0.0), (1, 1, 0.5, 0.0), (2, 3, 1.0, 0.0)], "zone long, node_id long, weight double, access_s double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in G.zone_matrix(e, two, 20.0).collect()}
    assert got[1, 2] == (20.0, 0.5) and got[1, 1] == (10.0, 1.0)
    assert (1, 2) not in {(r[0], r[1]) for r in G.zone_matrix(e, two, 20.0, 0.6).collect()}


def test_zone_sums_of_sources_that_reach_nothing(spark):
    lone = [(1000 + 2 * i, 1001 + 2 * i, 10.0, 100.0, 1000 + i, 1) for i in range(20)]
    e = _line(spark, 20).unionByName(spark.createDataFrame(lone, EDGE))
    p = spark.createDataFrame([(i, i, 1.0, 0.0) for i in [*range(20), *(1000 + 2 * i for i in range(20))]], "zone long, node_id long, weight double, access_s double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # each source is a block
    try:
        got = rows(G.zone_matrix(e, p, float("inf")).select("origin", "destination", "seconds"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, j, 10.0 * abs(i - j)) for i in range(20) for j in range(20) if i != j]


def test_weak_components(spark):
    r = random.Random(6)
    perm = list(range(1000, 1300))
    r.shuffle(perm)
    edges = [(perm[i], perm[i + 1]) for i in range(199)] + [(r.choice(perm[200:]), r.choice(perm[200:])) for _ in range(60)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(G.weak_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {x: find(x) for x in list(parent)}
    assert G.weak_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_running_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("k"))
    got = {r.k: r.n for r in running(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}


def _links(spark, extra=()):
    g = "array<struct<x:double,y:double>>"
    pt = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows_ = [(0, 1, 1, 2, "residential", None, pt((0, 0), (3, 4))), (1, 1, 2, 3, "cycleway", "yes", pt((3, 4), (3, 14))), (2, 2, 3, 3, "path", None, pt((0, 0), (1, 0))), (3, 3, 4, 5, None, "-1", pt((0, 0), (6, 8))), (4, 4, 4, None, "path", None, pt((0, 0), (1, 1))), (5, None, 7, 8, "path", None, pt((0, 0), (0, 2))), (6, 9, 7, 8, "path", None, None)]
    return L.with_defaults(spark.createDataFrame([*rows_, *extra], f"link_row long, link_id long, u long, v long, highway string, oneway string, geometry {g}"))


def test_normalise_is_idempotent_and_renumbers(spark):
    n = L.normalise(_links(spark)).cache()
    assert rows(n.select("link_row", "link_id", "length_m")) == [(0, 1, 5.0), (1, 4, 10.0), (3, 3, 10.0), (5, 5, 2.0)]
    again = L.normalise(n)
    assert rows(again.select("link_row", "link_id", "length_m")) == rows(n.select("link_row", "link_id", "length_m"))


def test_directions_and_speeds(spark):
    n = L.priced(L.normalise(_links(spark)), sp.BIKE).cache()
    e = L.directed_edges(n, "bike")
    assert rows(e.select("u", "v", "direction")) == [(1, 2, 1), (2, 1, -1), (2, 3, 1), (5, 4, -1), (7, 8, 1), (8, 7, -1)]
    got = {r.link_row: r for r in n.collect()}
    assert got[1].speed_kmh == 18.0 and got[3].speed_kmh == 14.0
    cost = 4.96 + 2.61 * 1.927
    assert abs(got[0].speed_kmh - 18.0 / (cost / 7.57)) < 1e-9 and abs(got[0].travel_time_s - 5 / (got[0].speed_kmh / 3.6)) < 1e-9
    w = L.directed_edges(L.priced(L.normalise(_links(spark)), sp.WALK), "walk")
    assert w.count() == 8


def test_overlay_and_stitch(spark):
    s = "origin long, destination long, v double"
    base, model = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], s), spark.createDataFrame([(1, 2, 1.0), (2, 1, 99.0), (9, 9, 1.0)], s)
    assert rows(overlay(base, model, "v", 50.0)) == [(1, 1, 5.0, False), (1, 2, 1.0, True), (2, 1, 7.0, False)]
    assert rows(stitch(model, base, "v")) == [(1, 1, 5.0, "far"), (1, 2, 1.0, "near"), (2, 1, 99.0, "near"), (9, 9, 1.0, "near")]


def test_line_matching(spark):
    g = "array<struct<x:double,y:double>>"
    pt = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    src = spark.createDataFrame([(1, pt((0, 0), (200, 0))), (2, pt((0, 500), (200, 500))), (3, None), (4, pt((1, 1), (1, 1)))], f"source long, geometry {g}")
    tgt = spark.createDataFrame([(10, pt((100, 5), (0, 5))), (11, pt((100, 8), (200, 8))), (12, pt((50, -50), (50, 50))), (13, pt())], f"target long, geometry {g}")
    c = line_claims(src, tgt, cell_rows=3).cache()
    assert {(r.source, r.target) for r in c.collect()} == {(1, 10), (1, 11)} and not any(r.forward for r in c.collect() if r.target == 10)
    assert rows(coverage(c, src)) == [(1, 1.0), (2, 0.0)]
    assert [(r.target, r.source) for r in sorted(winners(weighed(c), coverage(c, src)).collect())] == [(10, 1), (11, 1)]


def test_ways(spark):
    w = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9, 3, 8]), (3, [7]), (4, None)], "way long, refs array<long>")
    assert rows(junction_marks(w)) == [(1, 0, 1), (1, 2, 3), (1, 3, 4), (2, 0, 9), (2, 1, 3), (2, 2, 8)]
    assert rows(split_ways(w, spark.createDataFrame([(2,)], "ref long"))) == [(1, 1, 1, 2, 0, 1), (1, 2, 2, 3, 1, 2), (1, 3, 3, 4, 2, 3), (2, 1, 9, 3, 0, 1), (2, 2, 3, 8, 1, 2)]


def test_connectors_are_a_shortest_forest(spark):
    r = random.Random(11)
    pts = [(i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(80)]
    group = {i: i // 4 for i, _, _ in pts}
    nodes = spark.createDataFrame(pts, "node_id long, x double, y double")
    groups = spark.createDataFrame(list(group.items()), "node_id long, component long")
    parent = {g: g for g in group.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = n = 0
    for gap, a, b in sorted((((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5, p[0], q[0]) for p in pts for q in pts if p[0] < q[0]):
        if gap <= 60 and find(group[a]) != find(group[b]):
            parent[find(group[a])] = find(group[b])
            total, n = total + gap, n + 1
    got = G.gap_connectors(nodes, groups, 60.0).collect()
    assert len(got) == n and abs(sum(x.gap_m for x in got) - total) < 1e-6


def test_projection(spark):
    from strideflow.functions import crs

    df = spark.createDataFrame([(24.9384, 60.1699), (27.0, 65.0), (21.5, 69.9)], "lon double, lat double")
    x, y = crs.to_grid(F.col("lon"), F.col("lat"))
    g = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.to_degrees(F.col("x"), F.col("y"))
    for r in g.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    mid = [r for r in g.collect() if r.lon == 27.0][0]
    assert abs(mid.x - 500_000) < 1e-6 and abs(mid.y - 0.9996 * 7_210_885) < 3000
    wx, wy = crs.to_web(F.lit(180.0), F.lit(85.0511287798066))
    one = df.limit(1).select(wx.alias("x"), wy.alias("y")).first()
    assert abs(one.x - 20037508.342789244) < 1e-3 and abs(one.y - 20037508.342789244) < 1e-2


def test_trips_are_assigned_whatever_their_length(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    net, od = N._trips(spark, d)
    monkeypatch.setattr(N, "_trips", lambda s, d: (net, od))
    total = od.agg(F.sum("demand")).first()[0]
    inside = od.where("o_node = d_node").agg(F.coalesce(F.sum("demand"), F.lit(0.0))).first()[0]
    missed = N.d29_missed_of_trips(spark, d).agg(F.coalesce(F.sum("demand"), F.lit(0.0))).first()[0]
    ways = N.i12_lengths_of_trips(spark, d).cache()
    placed = ways.agg(F.sum("demand")).first()[0]
    assert placed > 0 and abs(inside + missed + placed - total) < 1e-6 * total
    m = G.od_matrix(net, od.select(F.col("o_node").alias("node_id")), float("inf")).select(F.col("origin").alias("o_node"), F.col("destination").alias("d_node"), "seconds", "metres").cache()
    want = {(r.origin, r.destination): round(r.metres, 3) for r in od.where("o_node <> d_node").join(m, ["o_node", "d_node"]).collect()}
    assert {(r.origin, r.destination): r.metres for r in ways.collect()} == want
    assert od.join(m, ["o_node", "d_node"]).agg(F.max("seconds")).first()[0] > N.LIMIT
    vol = {(r.link_id, r.direction): r.volume for r in N.i10_volumes_of_trips(spark, d).collect()}
    two = {(r.link_id, r.direction): r.volume for r in N.i14_two_tier_volumes_of_trips(spark, d).collect()}
    assert vol.keys() == two.keys() and all(abs(vol[k] - two[k]) < 1e-3 for k in vol)
    run = sum(r.length_m * vol.get((r.link_id, r.direction), 0.0) for r in net.collect())
    assert abs(run - ways.agg(F.sum(F.col("demand") * F.col("metres"))).first()[0]) < 1e-5 * run


def test_reverse_search_runs_to_every_node(spark, monkeypatch):
    e = _line(spark, 12)
    monkeypatch.setattr(N, "_net", lambda s, d: e)
    want = [(a, b, 10.0 * abs(a - b)) for a in range(12) for b in range(12)]
    assert rows(N.i17_whole_reverse_matrix(spark, "").select("origin", "destination", "seconds")) == want


def test_twins_without_broadcast_agree(spark):
    e = L.fastest_parallel(_random(spark)).cache()
    r = random.Random(8)
    s = spark.createDataFrame([(k,) for k in range(0, 60, 4)] + [(900,), (None,)], "node_id long")
    near = lambda df: {tuple(x[:2]): tuple(round(y, 6) for y in x[2:]) for x in df.collect()}
    assert near(G.od_matrix(e, s, 90.0)) == near(G.od_matrix(e, s, 90.0, most=0))
    to = spark.createDataFrame([(k,) for k in range(0, 60, 7)] + [(901,), (None,)], "node_id long")
    some = near(G.od_matrix(e, s, 90.0, targets=to))
    assert some == near(G.od_matrix(e, s, 90.0, most=0, targets=to)) == {k: v for k, v in near(G.od_matrix(e, s, 90.0)).items() if k[1] % 7 == 0}
    assert dict(rows(G.least_cost(e, s, 60.0).select("destination", F.round("seconds", 6)))) == dict(rows(G.least_cost(e, s, 60.0, most=0).select("destination", F.round("seconds", 6))))
    m = near(G.od_matrix(e, s, 60.0))
    want = {}
    for (_, d), (x, _) in m.items():
        want[d] = min(x, want.get(d, 1e9))
    assert dict(rows(G.least_cost(e, s, 60.0).select("destination", F.round("seconds", 6)))) == want
    dem = spark.createDataFrame([(r.randrange(60), r.randrange(66), float(r.randrange(4))) for _ in range(300)], "origin long, destination long, demand double")
    for chosen in (None, [3, 70, 71, 90]):
        a, b = G.assign(e, dem, 120.0, chosen), G.assign(e, dem, 120.0, chosen, most=0)
        for kind in ("missed", "length", "via"):
            assert near(a.where(F.col("kind") == kind).select("origin", "destination", "value")) == near(b.where(F.col("kind") == kind).select("origin", "destination", "value"))
        va, vb = ({tuple(x)[:4]: round(x.volume, 6) for x in G.link_volumes(y).collect()} for y in (a, b))
        assert va == vb
    pairs = dem.select("origin", "destination").distinct()
    assert rows(G.paths(e, pairs, 120.0)) == rows(G.paths(e, pairs, 120.0, most=0))
    p = spark.createDataFrame([(k // 5, k, r.random(), 10.0, 5.0) for k in range(40)], "zone long, node_id long, weight double, access_s double, access_m double")
    for rate in (None, 0.01):
        assert near(G.zone_matrix(e, p, 90.0, 0.2, rate, True)) == near(G.zone_matrix(e, p, 90.0, 0.2, rate, True, most=0))


def test_search_against_a_heap(spark):
    import heapq

    import numpy as np

    r = random.Random(12)
    n = 300
    e = [(i, (i + 1) % n, r.uniform(1, 60), r.uniform(1, 60)) for i in range(n)] + [(r.randrange(n), r.randrange(n), r.uniform(1, 60), r.uniform(1, 60)) for _ in range(900)]
    u, v, s, m = (np.array(c) for c in zip(*e))
    g = G.Graph(u * 10, v * 10, s, m, np.arange(len(u)), np.ones(len(u), int))
    out = {}
    for a, b, x, y in e:
        out.setdefault(a, []).append((b, x, y))
    for limit in (np.inf, 80.0):
        for roots in ([0, 7, 99], [5]):
            t = g.search(np.array(roots), limit)
            for k, root in enumerate(roots):
                dist, metres, heap = {}, {}, [(0.0, root, 0.0)]
                while heap:
                    d, x, w = heapq.heappop(heap)
                    if x not in dist:
                        dist[x], metres[x] = d, w
                        for y, q, z in out.get(x, ()):
                            if d + q <= limit:
                                heapq.heappush(heap, (d + q, y, w + z))
                mine = t.source == k
                assert np.allclose([dist[x] for x in t.node[mine].tolist()], t.seconds[mine]) and mine.sum() == len(dist)
                assert np.allclose([metres[x] for x in t.node[mine].tolist()], t.along(g.metres)[mine])


def test_one_broadcast_for_all_searches_on_a_table(spark, monkeypatch):
    made, old = [], G.collect_graph
    monkeypatch.setattr(G, "collect_graph", lambda e: made.append(1) or old(e))
    e = _line(spark, 4)
    assert rows(G.od_matrix(e, spark.createDataFrame([(0,)], "node_id long"), 10.0)) == [(0, 0, 0.0, 0.0), (0, 1, 10.0, 100.0)]
    assert G.link_volumes(G.assign(e, spark.createDataFrame([(0, 2, 3.0)], "origin long, destination long, demand double"), 30.0)).agg(F.sum("volume")).first()[0] == 6.0
    assert len(made) == 1
    assert rows(G.od_matrix(e.where("u < 2 and v < 2"), spark.createDataFrame([(0,)], "node_id long"), 99.0)) == [(0, 0, 0.0, 0.0), (0, 1, 10.0, 100.0)]
    assert e._graph is None  # no more than one is kept


def test_blocks_are_large_where_sources_reach_few_nodes():
    import numpy as np

    n, r = 300_000, np.random.default_rng(3)  # islands of six nodes, in a ring both ways
    u = np.arange(n)
    v = u // 6 * 6 + (u + 1) % 6
    s = r.uniform(1, 20, 2 * n)
    g = G.Graph(np.concatenate([u, v]), np.concatenate([v, u]), s, 10 * s, np.arange(2 * n), np.ones(2 * n, int))
    roots = r.choice(n, 6000, replace=False)
    roots[::50] = -1  # not in the network
    for limit in (30.0, np.inf):
        got = list(g.trees(roots, limit))
        assert [i for i, _, _ in got] == [0, *[j for _, j, _ in got[:-1]]] and got[-1][1] == len(roots)
        assert limit == np.inf or len(got) < 10
        for i, j, t in got[:: max(1, len(got) // 40)]:
            known = np.flatnonzero(roots[i:j] >= 0)[::7]
            load = r.random(len(t.key))
            pushed = t.pushed(load)
            for k in known.tolist():
                one, mine = g.search(roots[i + k : i + k + 1], limit), np.flatnonzero(t.source == k)
                assert (one.node == t.node[mine]).all() and (one.seconds == t.seconds[mine]).all() and (one.edge == t.edge[mine]).all()
                assert np.allclose(one.along(g.metres), t.along(g.metres)[mine]) and np.allclose(one.pushed(load[mine]), pushed[mine])
                assert (t.find(np.full(6, k), one.node[0] // 6 * 6 + np.arange(6)) >= 0).sum() == len(mine)
    assert g.search(np.arange(600), 30.0, None, 100) is None  # more than it may reach


def test_blocks_shrink_where_sources_reach_many_nodes(monkeypatch):
    import numpy as np

    monkeypatch.setattr(G, "FEW", 4000)
    monkeypatch.setattr(G, "MOST", 8000)
    monkeypatch.setattr(G, "BLOCK", 1)
    n = 5000
    u = np.arange(n - 1)
    g = G.Graph(u, u + 1, np.ones(n - 1), np.ones(n - 1), u, np.ones(n - 1, int))
    roots = np.concatenate([np.arange(n - 100, n), np.arange(0, 40)])  # first the ends of a line, then its beginning
    got = list(g.trees(roots, 3000.0))
    assert sum(j - i for i, j, _ in got) == len(roots)
    assert sum(len(t.key) for _, _, t in got) == sum(min(3000, n - 1 - k) + 1 for k in roots.tolist())


def test_two_tiers_in_one_search(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    net, dem = N._demand(spark, d)
    dem = dem.cache()
    monkeypatch.setattr(N, "_demand", lambda s, d: (net, dem))
    near = G.assign(net, dem, N.LIMIT / 2).cache()
    missed = near.where("kind = 'missed'").select("origin", "destination", F.col("value").alias("demand"))
    both = G.link_volumes(near).unionByName(G.link_volumes(G.assign(net, missed, N.LIMIT)))
    want = rows(both.groupBy("link_id", "direction", "u", "v").agg(F.round(F.sum("volume"), 4)))
    assert missed.count() and rows(N.i14_two_tier_volumes(spark, d)) == want
    some = G.assign(net, dem, N.LIMIT, kinds=("missed",))
    assert [r[0] for r in some.select("kind").distinct().collect()] == ["missed"]
    assert rows(some) == rows(G.assign(net, dem, N.LIMIT).where("kind = 'missed'"))


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 9)], "u long, v long")
    assert rows(G.strong_components(e)) == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9)]
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(260)]
    reach = {a: {a} for a in range(200)}
    for a in reach:
        todo = [a]
        while todo:
            x = todo.pop()
            for p, q in pairs:
                if p == x and q not in reach[a]:
                    reach[a].add(q), todo.append(q)
    seen = {x for p in pairs for x in p}
    want = {a: max(b for b in seen if b in reach[a] and a in reach[b]) for a in seen}
    assert dict(rows(G.strong_components(spark.createDataFrame(pairs, "u long, v long")))) == want


def test_values_among_others_in_a_tag(spark):
    df = spark.createDataFrame([(1, "lane; track"), (2, "tracks"), (3, " track "), (4, None), (5, ""), (6, "a;separate;b")], "k long, t string")
    got = {r.k: (r.a, r.b, r.f) for r in df.select("k", sp.names(F.col("t"), "track").alias("a"), sp.names(F.col("t"), "separate").alias("b"), sp.facility(F.col("t")).alias("f")).collect()}
    assert got == {1: (True, False, sp.TRACK), 2: (False, False, sp.MIXED), 3: (True, False, sp.TRACK), 4: (False, False, sp.MIXED), 5: (False, False, sp.MIXED), 6: (False, True, sp.MIXED)}
