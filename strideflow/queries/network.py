"""Queries that search the network: matrices, assignment, zones, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideflow.functions import crs
from strideflow.functions import speeds as sp
from strideflow.operators.nearness import nearest_within, pairs_within, regions_of_points
from strideflow.plans import graph as G
from strideflow.plans.demand import od_demand, stitch, trips
from strideflow.plans.lineage import cut, forget_later, shared_folder
from strideflow.plans.links import network, normalise, read_links
from strideflow.queries.data import _IN
from strideflow.queries.links import _COST, _NORM, _SHARED, _TRAFFIC, _case, net_sql
from strideflow.sources.files import read_network, read_points, write_network
from strideflow.sources.tables import read_table, table_stamp

R = lambda c, n=4: F.round(c, n)
LIMIT = 120.0
#: Metres from a zone's centroid to its node at most, as the reference has it unless told otherwise.
SNAP = 1000.0
#: Seconds of the near tier of the trips' assignment; the far tier has no limit.
NEAR = 900.0


_NETS: dict[tuple, object] = {}


def _net(s, d):
    """The priced network, built once in a session for the same tables."""
    key = (s.sparkContext.applicationId, d, table_stamp(s, d, "links"))
    if key not in _NETS:
        _NETS[key] = cut(network(s, d, sp.BIKE))
    return _NETS[key]


def _sources(net):
    return net.select(F.col("u").alias("node_id")).distinct()


def _matrix(s, d):
    net = _net(s, d)
    return net, G.od_matrix(net, _sources(net), LIMIT)


def i03_point_matrix(s, d):
    """Seconds from every node to all nodes within two minutes by bike, and the metres of that way."""
    return _matrix(s, d)[1].select("origin", "destination", R("seconds").alias("seconds"), R("metres", 3).alias("metres"))


def i04_relational_matrix(s, d):
    """The same seconds by frontier relaxation with joins."""
    net = _net(s, d)
    return G.relational_matrix(net, _sources(net), LIMIT).select("origin", "destination", R("seconds").alias("seconds"))


def i19_least_cost(s, d):
    """Seconds to every node from the nearest node whose id divides by fifty."""
    net = _net(s, d)
    return G.least_cost(net, _sources(net).where("node_id % 50 = 0"), LIMIT).select("destination", R("seconds").alias("seconds"))


def i17_reverse_matrix(s, d):
    """Seconds to every node whose id divides by ten from all nodes within two minutes, searched on the reversed network."""
    net = _net(s, d)
    back = net.select(F.col("v").alias("u"), F.col("u").alias("v"), "travel_time_s", "length_m", "link_id", "direction")
    return G.od_matrix(back, _sources(back).where("node_id % 10 = 0"), LIMIT).select(F.col("origin").alias("destination"), F.col("destination").alias("origin"), R("seconds").alias("seconds"))


def i17_whole_reverse_matrix(s, d):
    """The same to every node."""
    net = _net(s, d)
    back = net.select(F.col("v").alias("u"), F.col("u").alias("v"), "travel_time_s", "length_m", "link_id", "direction")
    return G.od_matrix(back, _sources(back), LIMIT).select(F.col("origin").alias("destination"), F.col("destination").alias("origin"), R("seconds").alias("seconds"))


def _demand(s, d):
    """Demand between the nodes within two minutes of each other, and to one that no way leads to."""
    net, m = _matrix(s, d)
    near = m.select("origin", "destination", ((F.col("origin") + 3 * F.col("destination")) % 5).cast("double").alias("demand"))
    far = _sources(net).where("node_id % 100 = 7").select(F.col("node_id").alias("origin"), F.lit(-99).cast("bigint").alias("destination"), F.lit(2.0).alias("demand"))
    return net, near.unionByName(far)


def i10_link_volumes(s, d):
    """All-or-nothing volumes of every directed link."""
    net, dem = _demand(s, d)
    return G.link_volumes(G.assign(net, dem, LIMIT)).select("link_id", "direction", "u", "v", R("volume").alias("volume"))


def i12_trip_lengths(s, d):
    """Metres of every pair of the assigned demand."""
    net, dem = _demand(s, d)
    return G.assign(net, dem, LIMIT).where("kind = 'length'").select("origin", "destination", R("value", 3).alias("metres"))


def d29_missed_demand(s, d):
    net, dem = _demand(s, d)
    return G.assign(net, dem, LIMIT).where("kind = 'missed'").groupBy("destination").agg(F.count("*").alias("pairs"), R(F.sum("value")).alias("demand"))


def i13_select_link(s, d):
    """Pairs whose way uses a link whose id divides by 97."""
    net, dem = _demand(s, d)
    chosen = [r[0] for r in net.where("link_id % 97 = 0").select("link_id").distinct().collect()]
    return G.assign(net, dem, LIMIT, chosen).where("kind = 'via'").select("origin", "destination", R("value").alias("demand"))


def _trips(s, d):
    """The trips' demand by zones, with the network's nearest node of both; a zone without one gets a number that no node has."""
    net = _net(s, d)
    place = lambda t, k: read_table(s, d, t, [k, "x", "y"]).where("x is not null and y is not null").groupBy(k).agg(F.min(F.struct("x", "y")).alias("p")).select(k, "p.x", "p.y")
    used = net.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    at = cut(nearest_within(place("centroids", "centroid_id"), "centroid_id", place("nodes", "node_id").join(used, "node_id"), "node_id", SNAP).select(F.col("id").alias("zone"), F.col("target_id").alias("node")))
    od = od_demand(trips(s, d))
    for end, node in (("origin", "o_node"), ("destination", "d_node")):
        od = od.join(at.select(F.col("zone").alias(end), F.col("node").alias(node)), end, "left").withColumn(node, F.coalesce(node, -1 - F.col(end)))
    return net, cut(od.select("origin", "destination", "demand", "o_node", "d_node"))


def i03_hour_matrix(s, d):
    """Seconds and metres between the centroids' nodes within an hour by bike."""
    net, place = _net(s, d), lambda t, k: read_table(s, d, t, [k, "x", "y"]).where("x is not null and y is not null").groupBy(k).agg(F.min(F.struct("x", "y")).alias("p")).select(k, "p.x", "p.y")
    used = net.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    near = nearest_within(place("centroids", "centroid_id"), "centroid_id", place("nodes", "node_id").join(used, "node_id"), "node_id", SNAP)
    at = cut(near.select(F.col("target_id").alias("node_id")).distinct())
    return G.od_matrix(net, at, 3600.0, targets=at).select("origin", "destination", R("seconds").alias("seconds"), R("metres", 3).alias("metres"))


def _by_node(od):
    return od.select(F.col("o_node").alias("origin"), F.col("d_node").alias("destination"), "demand")


def _by_zone(assigned, od):
    """Values of pairs of nodes for all pairs of zones that have these nodes."""
    return od.join(assigned.select(F.col("origin").alias("o_node"), F.col("destination").alias("d_node"), "value"), ["o_node", "d_node"])


def i10_volumes_of_trips(s, d):
    """Volumes of every directed link from all the trips' demand, however long the way."""
    net, od = _trips(s, d)
    return G.link_volumes(G.assign(net, _by_node(od), float("inf"))).select("link_id", "direction", "u", "v", R("volume").alias("volume"))


def i12_lengths_of_trips(s, d):
    """Metres of the fastest way of every pair of zones with demand."""
    net, od = _trips(s, d)
    return _by_zone(G.assign(net, _by_node(od), float("inf")).where("kind = 'length'"), od).select("origin", "destination", R("demand").alias("demand"), R("value", 3).alias("metres"))


def d29_missed_of_trips(s, d):
    """Pairs of zones whose demand no way serves, or of which one has no node."""
    net, od = _trips(s, d)
    return _by_zone(G.assign(net, _by_node(od), float("inf")).where("kind = 'missed'"), od).select("origin", "destination", R("demand").alias("demand"))


def i13_select_link_of_trips(s, d):
    """Pairs of zones whose way uses a link whose id divides by 97, with their demand."""
    net, od = _trips(s, d)
    chosen = [r[0] for r in net.where("link_id % 97 = 0").select("link_id").distinct().collect()]
    return _by_zone(G.assign(net, _by_node(od), float("inf"), chosen).where("kind = 'via'"), od).select("origin", "destination", R("demand").alias("demand"))


def i14_two_tier_volumes_of_trips(s, d):
    """The trips' demand assigned within a quarter of an hour, and what that misses without limit; the volumes of both."""
    net, od = _trips(s, d)
    near = cut(G.assign(net, _by_node(od), NEAR))
    far = G.assign(net, near.where("kind = 'missed'").select("origin", "destination", F.col("value").alias("demand")), float("inf"))
    both = G.link_volumes(near).unionByName(G.link_volumes(far))
    return both.groupBy("link_id", "direction", "u", "v").agg(R(F.sum("volume")).alias("volume"))


def d08_components(s, d):
    """Nodes of every weak component of the network: its size by its smallest node."""
    return G.weak_components(_net(s, d)).groupBy("component").agg(F.count("*").alias("nodes"))


def d09_largest_component(s, d):
    """Nodes of the largest weak component; of equally large ones the one with the smallest node."""
    lab = cut(G.weak_components(_net(s, d)))
    top = lab.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return lab.join(F.broadcast(top), "component").select("node_id")


def i25_gap_connectors(s, d):
    """Of every component the shortest gap of under 50 m to another one."""
    net = _net(s, d)
    lab = cut(G.weak_components(net))
    xy = read_table(s, d, "nodes").where("x is not null and y is not null").groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y").join(lab, "node_id")
    xy = cut(xy)
    near = pairs_within(xy, "node_id", 49.999)
    a = xy.select(F.col("node_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("component").alias("ac"))
    b = xy.select(F.col("node_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("component").alias("bc"))
    gap = near.join(a, "a_id").join(b, "b_id").where("ac <> bc").withColumn("gap", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    each = gap.select("a_id", "b_id", "gap", F.explode(F.array("ac", "bc")).alias("component"))
    return each.groupBy("component").agg(F.min(F.struct(R("gap", 3).alias("g"), "a_id", "b_id")).alias("m")).select("component", F.col("m.a_id").alias("u"), F.col("m.b_id").alias("v"), F.col("m.g").alias("gap_m"))


def i25_island_connectors(s, d):
    """The gaps of at most 2 km that join the network's components into a forest."""
    net = _net(s, d)
    xy = read_table(s, d, "nodes").where("x is not null and y is not null").groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y")
    return G.gap_connectors(xy, cut(G.weak_components(net)), 2000.0).select("u", "v", R("gap_m", 3).alias("gap_m"))


def i09_two_tier_matrix(s, d):
    """Cells within a minute by their access points, others within two minutes by their heaviest nodes, access legs added."""
    net, p = _net(s, d), cut(_cell_points(s, d))
    near = G.zone_matrix(net, p, LIMIT / 2).select("origin", "destination", "seconds")
    rep = cut(p.groupBy("zone").agg(F.min(F.struct(-F.round("weight", 12), "node_id")).alias("m")).select("zone", F.col("m.node_id").alias("node_id")))
    m = G.od_matrix(net, rep, LIMIT)
    far = m.select("seconds", F.col("origin").alias("node_id"), F.col("destination").alias("n2")).join(rep.withColumnRenamed("zone", "origin"), "node_id").join(rep.select(F.col("zone").alias("destination"), F.col("node_id").alias("n2")), "n2").where("origin <> destination").select("origin", "destination", (F.col("seconds") + 60).alias("seconds"))
    return stitch(near, far, "seconds").select("origin", "destination", R("seconds", 3).alias("seconds"), "tier")


def h21_grid_to_degrees(s, d):
    """The centroids' longitude and latitude, their spherical Mercator metres and their map tile at zoom 12."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x between 0 and 1000000 and y between 6000000 and 8000000").distinct()
    lon, lat = crs.to_degrees(F.col("x"), F.col("y"))
    g = c.select("centroid_id", "x", "y", lon.alias("lon"), lat.alias("lat"))
    wx, wy = crs.to_web(F.col("lon"), F.col("lat"))
    tx, ty = crs.tile(F.col("lon"), F.col("lat"), 12)
    bx, by = crs.to_grid(F.col("lon"), F.col("lat"))
    return g.select("centroid_id", "x", "y", R("lon", 8).alias("lon"), R("lat", 8).alias("lat"), R(wx, 2).alias("web_x"), R(wy, 2).alias("web_y"), tx.alias("tile_x"), ty.alias("tile_y"), (F.hypot(bx - F.col("x"), by - F.col("y")) < 1e-3).alias("returns"))


# ----------------------------------------------------------------- zones


def _weighted_nodes(s, d):
    links = normalise(read_links(s, d))
    w = links.select(F.explode(F.array("u", "v")).alias("node_id"), "length_m").where("node_id <> 0").groupBy("node_id").agg((F.sum("length_m") / 2).alias("w"))
    xy = read_table(s, d, "nodes").where("x is not null and y is not null").groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y")
    return w.join(xy, "node_id")


def _access(s, d):
    """Weighted centroids of the 10 km cells of each municipality's nodes, snapped to the nearest node and normalised."""
    n = cut(_weighted_nodes(s, d))
    zone = regions_of_points(n, "node_id", read_table(s, d, "municipality_polygons", ["municipality_id", "rings"]), "municipality_id").select(F.col("id").alias("node_id"), F.col("region").alias("zone"))
    c = n.join(zone, "node_id").withColumns({"cx": F.floor(F.col("x") / 10000), "cy": F.floor(F.col("y") / 10000)})
    cell = c.groupBy("zone", "cx", "cy").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.min_by("node_id", F.struct("x", "y", "node_id")).alias("node_id"))
    return cell


def d11_cell_centroids(s, d):
    return _access(s, d).select("zone", "cx", "cy", R("w", 3).alias("w"), R("x", 2).alias("x"), R("y", 2).alias("y"))


def c08_zone_of_nodes(s, d):
    """The municipality of every node with a street."""
    n = _weighted_nodes(s, d)
    return regions_of_points(n, "node_id", read_table(s, d, "municipality_polygons", ["municipality_id", "rings"]), "municipality_id").select(F.col("id").alias("node_id"), F.col("region").alias("zone"))


def c09_links_by_municipality(s, d):
    """Links and kilometres by the municipality around the middle between their ends."""
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 1")
    mid = lambda c: (F.element_at("geometry", 1)[c] + F.element_at("geometry", -1)[c]) / 2
    p = t.select("link_row", mid("x").alias("x"), mid("y").alias("y"))
    z = regions_of_points(p, "link_row", read_table(s, d, "municipality_polygons", ["municipality_id", "rings"]), "municipality_id")
    return z.groupBy(F.col("region").alias("municipality_id")).agg(F.count("*").alias("links"))


def _points(s, d):
    c = _access(s, d)
    total = c.groupBy("zone").agg(F.sum("w").alias("t"))
    return c.join(total, "zone").select("zone", "node_id", (F.col("w") / F.col("t")).alias("weight"), F.lit(30.0).alias("access_s"))


def d15_access_points(s, d):
    """Access points of the municipalities with their share of the street length."""
    return _points(s, d).select("zone", "node_id", R("weight", 8).alias("weight"))


def d17_self_weight(s, d):
    return _points(s, d).groupBy("zone").agg(R(F.sum(F.col("weight") * F.col("weight")), 8).alias("self_weight"), F.count("*").alias("points"))


def d16_representative(s, d):
    """The access point of each municipality with the least weighted distance to the others; of its at most hundred cells."""
    c = cut(_access(s, d))
    a, b = c.select("zone", "node_id", "x", "y"), c.select("zone", F.col("w").alias("w2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    cost = a.join(b, "zone").groupBy("zone", "node_id").agg(F.sum(F.col("w2") * F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("cost"))
    return cost.groupBy("zone").agg(F.min(F.struct(R("cost", 2).alias("cost"), "node_id")).alias("m")).select("zone", F.col("m.node_id").alias("node_id"))


def _cell_points(s, d):
    """The nodes of 1.5 km cells as access points, weighted by their share of the cell's street length."""
    n = _weighted_nodes(s, d).withColumn("zone", (F.floor(F.col("x") / 1500) * 100000 + F.floor(F.col("y") / 1500)).cast("bigint"))
    return n.join(n.groupBy("zone").agg(F.sum("w").alias("t")), "zone").select("zone", "node_id", (F.col("w") / F.col("t")).alias("weight"), F.lit(30.0).alias("access_s"))


def i07_zone_matrix(s, d):
    """Mean seconds between cells over their access points within two minutes of each other, and the share of the weight that is."""
    return G.zone_matrix(_net(s, d), cut(_cell_points(s, d)), LIMIT).select("origin", "destination", R("seconds", 3).alias("seconds"), R("fraction", 6).alias("fraction"))


def i07_gated_zone_matrix(s, d):
    """The same where at least three tenths of the weight is reached."""
    return G.zone_matrix(_net(s, d), cut(_cell_points(s, d)), LIMIT, 0.3).select("origin", "destination", R("seconds", 3).alias("seconds"))


def j01_point_demand(s, d):
    """Demand between cells spread over pairs of their nodes by both weights."""
    p = cut(_cell_points(s, d))
    z = G.zone_matrix(_net(s, d), p, LIMIT).where("origin <> destination").select("origin", "destination", F.lit(10.0).alias("demand"))
    a, b = p.select(F.col("zone").alias("origin"), F.col("node_id").alias("a"), F.col("weight").alias("wa")), p.select(F.col("zone").alias("destination"), F.col("node_id").alias("b"), F.col("weight").alias("wb"))
    x = z.join(a, "origin").join(b, "destination")
    return x.groupBy("a").agg(R(F.sum(F.col("demand") * F.col("wa") * F.col("wb")), 6).alias("demand"))


def i18_paths(s, d):
    """The links of the fastest ways from every fiftieth node."""
    net, m = _matrix(s, d)
    return G.paths(net, m.where("origin % 50 = 0 and origin <> destination").select("origin", "destination"), LIMIT).select("origin", "destination", "left", "link_id", "direction")


def e14_route_stretches(s, d):
    """Stretches of one highway class along these ways: consecutive links of a class are one."""
    net, m = _matrix(s, d)
    p = G.paths(net, m.where("origin % 50 = 0 and origin <> destination").select("origin", "destination"), LIMIT)
    h = normalise(read_links(s, d)).select("link_id", F.coalesce("highway", F.lit("")).alias("class"), "length_m")
    w = Window.partitionBy("origin", "destination").orderBy(F.desc("left"))
    j = p.join(h, "link_id").withColumn("new", F.when(F.lag("class").over(w).eqNullSafe(F.col("class")), 0).otherwise(1))
    k = j.withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("origin", "destination", "stretch").agg(F.first("class").alias("class"), R(F.sum("length_m"), 3).alias("metres"))


def i14_two_tier_volumes(s, d):
    """Demand assigned within one minute, and what that misses within two; the volumes of both."""
    # both tiers go between the same nodes: the near one's ways are those of the far one's search that end within a minute, so one search loads both
    net, dem = _demand(s, d)
    return G.link_volumes(G.assign(net, dem, LIMIT, kinds=("volume",))).select("link_id", "direction", "u", "v", R("volume").alias("volume"))


def d39_select_link_totals(s, d):
    """The selected links' demand by origin and by destination."""
    return _ends(cut(i13_select_link(s, d)))


def d39_select_link_totals_of_trips(s, d):
    """The selected links' demand of the trips by zone."""
    return _ends(cut(i13_select_link_of_trips(s, d))).withColumnRenamed("node_id", "zone")


def _ends(v):
    o = v.groupBy(F.col("origin").alias("node_id")).agg(F.sum("demand").alias("as_origin"))
    e = v.groupBy(F.col("destination").alias("node_id")).agg(F.sum("demand").alias("as_destination"))
    return o.join(e, "node_id", "full_outer").select("node_id", F.coalesce("as_origin", F.lit(0.0)).alias("as_origin"), F.coalesce("as_destination", F.lit(0.0)).alias("as_destination"))


def c29_candidate_pairs(s, d):
    """Pairs that can use a node whose id divides by 97 within two minutes: the way there and on from there is no longer."""
    _, m = _matrix(s, d)
    m = cut(m.select("origin", "destination", "seconds"))
    to, on = m.where("destination % 97 = 0").select("origin", F.col("destination").alias("via"), F.col("seconds").alias("s1")), m.where("origin % 97 = 0").select(F.col("origin").alias("via"), "destination", F.col("seconds").alias("s2"))
    return to.join(on, "via").where((F.col("s1") + F.col("s2") <= LIMIT) & (F.col("origin") != F.col("destination"))).select("origin", "destination").distinct()


def d32_municipality_speed(s, d):
    """Volume-weighted speed by the municipality of the link's middle, and for all of them."""
    net, dem = _demand(s, d)
    return _speed(s, d, net, G.assign(net, dem, LIMIT))


def d32_municipality_speed_of_trips(s, d):
    """The same under all the trips' demand."""
    net, od = _trips(s, d)
    return _speed(s, d, net, G.assign(net, _by_node(od), float("inf")))


def _speed(s, d, net, assigned):
    vol = G.link_volumes(assigned).select("link_id", "direction", "volume")
    links = normalise(read_links(s, d))
    mid = lambda c: (F.element_at("geometry", 1)[c] + F.element_at("geometry", -1)[c]) / 2
    z = regions_of_points(links.select("link_id", mid("x").alias("x"), mid("y").alias("y")), "link_id", read_table(s, d, "municipality_polygons", ["municipality_id", "rings"]), "municipality_id").select(F.col("id").alias("link_id"), F.col("region").alias("municipality_id"))
    j = vol.join(net.select("link_id", F.col("direction").cast("int").alias("direction"), "length_m", "travel_time_s"), ["link_id", "direction"]).join(z, "link_id")
    return j.rollup("municipality_id").agg(R(F.sum(F.col("volume") * F.col("length_m")) / F.sum(F.col("volume") * F.col("travel_time_s")) * 3.6).alias("kmh"), F.count_distinct("link_id").alias("links"))


def j06_gravity_demand(s, d):
    """A thousand trips between the cells' centres within 30 km, by their street lengths and exp(-distance / 5 km)."""
    n = _weighted_nodes(s, d).withColumns({"cx": F.floor(F.col("x") / 1500), "cy": F.floor(F.col("y") / 1500)})
    c = cut(n.groupBy("cx", "cy").agg(F.sum("w").alias("p"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y")).withColumn("zone", (F.col("cx") * 100000 + F.col("cy")).cast("bigint")))
    near = pairs_within(c, "zone", 30_000.0)
    a, b = c.select(F.col("zone").alias("a_id"), F.col("p").alias("pa"), F.col("x").alias("ax"), F.col("y").alias("ay")), c.select(F.col("zone").alias("b_id"), F.col("p").alias("pb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    t = near.join(a, "a_id").join(b, "b_id").withColumn("t", F.col("pa") * F.col("pb") * F.exp(-F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / 5000))
    whole = t.agg(F.sum("t").alias("all"))
    return t.crossJoin(F.broadcast(whole)).select("a_id", "b_id", R(F.col("t") / F.col("all") * 1000, 5).alias("trips"))


def f03_heaviest_nodes(s, d):
    """The three nodes of every municipality with the most street length."""
    n = cut(_weighted_nodes(s, d))
    z = c08_zone_of_nodes(s, d)
    w = Window.partitionBy("zone").orderBy(F.desc(F.round("w", 4)), "node_id")
    return n.join(z, "node_id").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("zone", "rank", "node_id", R("w").alias("w"))


def f04_largest_polygon(s, d):
    """Every municipality's largest polygon by its box."""
    t = read_table(s, d, "municipality_polygons", ["polygon_id", "municipality_id", "rings"])
    o = F.element_at("rings", 1)
    box = (F.array_max(o["x"]) - F.array_min(o["x"])) * (F.array_max(o["y"]) - F.array_min(o["y"]))
    return t.groupBy("municipality_id").agg(F.max(F.struct(F.round(box, 3).alias("a"), (-F.col("polygon_id")).alias("k"))).alias("m")).select("municipality_id", (-F.col("m.k")).alias("polygon_id"))


def c21_stitched_nodes(s, d):
    """Two overlapping halves of the nodes put together, each node once as its first position."""
    n = read_table(s, d, "nodes").where("x is not null and y is not null")
    both = n.where("x < 300000").unionByName(n.where("x >= 250000"))
    return both.groupBy("node_id").agg(F.min(F.struct("node_index", "x", "y")).alias("m")).select("node_id", "m.node_index", "m.x", "m.y")


def a11_point_file(s, d):
    """The centroids through a CSV file with semicolons."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").distinct()
    path = f"{shared_folder(s)}/points-{uuid.uuid4().hex}"
    forget_later(s, path)
    c.write.csv(path, header=True, sep=";")
    return read_points(s, path, "centroid_id").select(F.col("id").cast("bigint").alias("centroid_id"), "x", "y")


def a23_network_file(s, d):
    """The network through its stored form."""
    path = f"{shared_folder(s)}/network-{uuid.uuid4().hex}"
    forget_later(s, path)
    write_network(network(s, d, sp.BIKE), path, "bike")
    return read_network(s, path, "bike").select("u", "v", "link_id", F.col("direction").cast("int").alias("direction"))


def d41_cost_causes(s, d):
    """How much of each link's bike time comes from surface, carriageway, shared path and traffic: shares of the logarithm of its slow-down."""
    t = read_table(s, d, "links", ["link_row", "highway", "surface", "segregated", "car_volume"])
    cost = sp.disutility(F.col("highway"))
    part = {"surface": sp.lookup(sp.BIKE_SURFACE, F.col("surface"), 1.0), "carriageway": 1 / F.greatest(cost / sp.REFERENCE_COST, F.lit(1.0)), "shared": sp.shared_path(F.col("highway"), F.col("segregated")), "traffic": sp.traffic_factor(cost, F.col("car_volume"))}
    logs = t.select("link_row", *[(-F.log(v)).alias(k) for k, v in part.items()]).withColumn("all", sum((F.col(k) for k in list(part)[1:]), F.col("surface")))
    return logs.where("all > 1e-12").select("link_row", *[R(F.col(k) / F.col("all"), 6).alias(k) for k in part])


def c06_snap_statistics(s, d):
    """Centroids with and without a node within 100 m, and the median distance."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").distinct()
    near = nearest_within(c, "centroid_id", read_table(s, d, "nodes", ["node_index", "x", "y"]), "node_index", 100.0)
    j = c.join(near.select(F.col("id").alias("centroid_id"), "x", "y", "distance"), ["centroid_id", "x", "y"], "left")
    return j.agg(F.count("distance").alias("snapped"), F.count_if(F.col("distance").isNull()).alias("unsnapped"), R(F.expr("percentile(distance, 0.5)"), 4).alias("median_m"))


# ------------------------------------------------------------------ SQL

_DIST = f"""{net_sql(sp.BIKE)}, src AS (SELECT DISTINCT u AS node FROM net),
r(hop, src, node, d) AS (SELECT 0, node, node, 0.0::DOUBLE FROM src UNION ALL SELECT hop + 1, r.src, n.v, min(r.d + n.travel_time_s) FROM r JOIN net n ON n.u = r.node WHERE hop < 40 AND r.d + n.travel_time_s <= {LIMIT} GROUP BY hop, r.src, n.v),
dist AS (SELECT src, node, min(d) AS d FROM r GROUP BY 1, 2),
pred AS (SELECT src, node, arg_min((u, length_m, link_id, direction), (gap, link_id)) AS e FROM (SELECT b.src, b.node, n.u, n.length_m, n.link_id, n.direction, abs(a.d + n.travel_time_s - b.d) AS gap FROM dist b JOIN net n ON n.v = b.node JOIN dist a ON a.src = b.src AND a.node = n.u WHERE b.node <> b.src) WHERE gap < 1e-7 GROUP BY 1, 2),
walk(src, dest, node, len, hops) AS (SELECT src, node, node, 0.0::DOUBLE, 0 FROM dist UNION ALL SELECT w.src, w.dest, p.e[1], w.len + p.e[2], hops + 1 FROM walk w JOIN pred p ON p.src = w.src AND p.node = w.node WHERE hops < 200),
ways AS (SELECT src, dest, len FROM walk WHERE node = src),
dem AS (SELECT src, node AS dest, ((src + 3 * node) % 5)::DOUBLE AS demand FROM dist WHERE src <> node AND (src + 3 * node) % 5 > 0)"""
_USED = "used AS (SELECT w.src, w.dest, p.e AS e, w.node FROM walk w JOIN pred p ON p.src = w.src AND p.node = w.node)"
_WN = f"{_NORM}, xy AS (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), ww AS (SELECT node_id, sum(length_m) / 2 AS w FROM (SELECT u AS node_id, length_m FROM norm WHERE u <> 0 UNION ALL SELECT v, length_m FROM norm WHERE v <> 0) GROUP BY 1), pts AS (SELECT node_id AS centroid_id, w, x, y FROM ww JOIN xy USING (node_id)), {_IN.strip()}, zo AS (SELECT centroid_id, min(municipality_id) AS zone FROM inside GROUP BY 1)"
_CELLS = f"{_WN}, cell AS (SELECT zone, CAST(floor(x / 10000) AS BIGINT) AS cx, CAST(floor(y / 10000) AS BIGINT) AS cy, sum(w) AS w, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, arg_min(centroid_id, (x, y, centroid_id)) AS node_id FROM pts JOIN zo USING (centroid_id) GROUP BY 1, 2, 3), points AS (SELECT zone, node_id, w / sum(w) OVER (PARTITION BY zone) AS weight FROM cell)"
_ZP = """xy AS (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), ww AS (SELECT node_id, sum(length_m) / 2 AS w FROM (SELECT u AS node_id, length_m FROM norm WHERE u <> 0 UNION ALL SELECT v, length_m FROM norm WHERE v <> 0) GROUP BY 1),
zw AS (SELECT CAST(floor(x / 1500) * 100000 + floor(y / 1500) AS BIGINT) AS zone, node_id, w FROM ww JOIN xy USING (node_id)), zp AS (SELECT zone, node_id, w / sum(w) OVER (PARTITION BY zone) AS weight FROM zw),
own AS (SELECT zone, sum(weight * weight) AS self FROM zp GROUP BY 1), zs AS (SELECT a.zone AS origin, b.zone AS destination, sum(a.weight * b.weight * (d + 60)) AS num, sum(a.weight * b.weight) AS den, any_value(CASE WHEN a.zone = b.zone THEN 1 - o.self ELSE 1 END) AS whole
FROM dist JOIN zp a ON a.node_id = src JOIN zp b ON b.node_id = dist.node JOIN own o ON o.zone = a.zone WHERE src <> dist.node GROUP BY 1, 2)"""

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
_COMP = f"{net_sql(sp.BIKE)}, two AS (SELECT u AS a, v AS b FROM net UNION SELECT v, u FROM net), reach(a, b) AS (SELECT a, a FROM two UNION SELECT r.a, e.b FROM reach r JOIN two e ON e.a = r.b), comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY 1)"
SQL = {
    "i25_gap_connectors": f"WITH RECURSIVE {_COMP}, xy AS (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), cx AS (SELECT * FROM comp JOIN xy USING (node_id)), gap AS (SELECT a.component AS ac, b.component AS bc, a.node_id AS a, b.node_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS g FROM cx a JOIN cx b ON a.node_id < b.node_id AND a.component <> b.component AND abs(a.x - b.x) < 50 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 49.999), e AS (SELECT ac AS component, a, b, g FROM gap UNION ALL SELECT bc, a, b, g FROM gap) SELECT component, m[2] AS u, m[3] AS v, m[1] AS gap_m FROM (SELECT component, min((round(g, 3), a, b)) AS m FROM e GROUP BY 1)",
    "d08_components": f"WITH RECURSIVE {_COMP} SELECT component, count(*) AS nodes FROM comp GROUP BY 1",
    "d09_largest_component": f"WITH RECURSIVE {_COMP}, largest AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node_id FROM comp WHERE component = (SELECT component FROM largest)",
    "i03_point_matrix": f"WITH RECURSIVE {_DIST} SELECT d.src AS origin, d.node AS destination, round(d.d, 4) AS seconds, round(w.len, 3) AS metres FROM dist d JOIN ways w ON w.src = d.src AND w.dest = d.node",
    "i04_relational_matrix": f"WITH RECURSIVE {_DIST} SELECT src AS origin, node AS destination, round(d, 4) AS seconds FROM dist",
    "i19_least_cost": f"WITH RECURSIVE {_DIST} SELECT node AS destination, round(min(d), 4) AS seconds FROM dist WHERE src % 50 = 0 GROUP BY 1",
    "i17_reverse_matrix": f"WITH RECURSIVE {_DIST.replace('SELECT DISTINCT u AS node FROM net', 'SELECT u AS node FROM net UNION SELECT v FROM net')} SELECT src AS origin, node AS destination, round(d, 4) AS seconds FROM dist WHERE node % 10 = 0 AND node IN (SELECT v FROM net)",
    "i17_whole_reverse_matrix": f"WITH RECURSIVE {_DIST.replace('SELECT DISTINCT u AS node FROM net', 'SELECT u AS node FROM net UNION SELECT v FROM net')} SELECT src AS origin, node AS destination, round(d, 4) AS seconds FROM dist WHERE node IN (SELECT v FROM net)",
    "i10_link_volumes": f"WITH RECURSIVE {_DIST}, {_USED} SELECT e[3] AS link_id, CAST(e[4] AS INTEGER) AS direction, e[1] AS u, node AS v, round(sum(demand), 4) AS volume FROM used JOIN dem USING (src, dest) GROUP BY 1, 2, 3, 4",
    "i12_trip_lengths": f"WITH RECURSIVE {_DIST} SELECT src AS origin, dest AS destination, round(len, 3) AS metres FROM dem JOIN ways USING (src, dest)",
    "d29_missed_demand": f"WITH {net_sql(sp.BIKE)} SELECT -99::BIGINT AS destination, count(DISTINCT u) AS pairs, round(2.0 * count(DISTINCT u), 4)::DOUBLE AS demand FROM net WHERE u % 100 = 7",
    "i13_select_link": f"WITH RECURSIVE {_DIST}, {_USED}, via AS (SELECT DISTINCT src, dest FROM used WHERE e[3] % 97 = 0) SELECT src AS origin, dest AS destination, demand FROM via JOIN dem USING (src, dest)",
    "i07_zone_matrix": f"WITH RECURSIVE {_DIST}, {_ZP} SELECT origin, destination, round(num / den, 3) AS seconds, round(den / whole, 6) AS fraction FROM zs",
    "i07_gated_zone_matrix": f"WITH RECURSIVE {_DIST}, {_ZP} SELECT origin, destination, round(num / den, 3) AS seconds FROM zs WHERE den / whole >= 0.3 - 1e-9",
    "j01_point_demand": f"WITH RECURSIVE {_DIST}, {_ZP} SELECT p.node_id AS a, round(sum(10.0 * p.weight), 6) AS demand FROM zs JOIN zp p ON p.zone = origin WHERE origin <> destination GROUP BY 1",
    "i09_two_tier_matrix": f"WITH RECURSIVE {_DIST}, {_ZP.replace('WHERE src <> dist.node', 'WHERE src <> dist.node AND dist.d <= ' + str(LIMIT / 2))}, rep AS (SELECT zone, min((-round(weight, 12), node_id))[2] AS node_id FROM zp GROUP BY 1), far AS (SELECT a.zone AS origin, b.zone AS destination, d + 60 AS seconds FROM dist JOIN rep a ON a.node_id = src JOIN rep b ON b.node_id = dist.node WHERE a.zone <> b.zone), near AS (SELECT origin, destination, num / den AS seconds FROM zs) SELECT coalesce(n.origin, f.origin) AS origin, coalesce(n.destination, f.destination) AS destination, round(coalesce(n.seconds, f.seconds), 3) AS seconds, CASE WHEN n.origin IS NOT NULL THEN 'near' ELSE 'far' END AS tier FROM near n FULL JOIN far f ON n.origin = f.origin AND n.destination = f.destination",
    "i18_paths": f"WITH RECURSIVE {_DIST} SELECT w.src AS origin, w.dest AS destination, w.hops AS \"left\", p.e[3] AS link_id, CAST(p.e[4] AS INTEGER) AS direction FROM walk w JOIN pred p ON p.src = w.src AND p.node = w.node WHERE w.src % 50 = 0",
    "e14_route_stretches": f"WITH RECURSIVE {_DIST}, st AS (SELECT w.src, w.dest, w.hops, coalesce(n.highway, '') AS class, n.length_m FROM walk w JOIN pred p ON p.src = w.src AND p.node = w.node JOIN norm n ON n.link_id = p.e[3] WHERE w.src % 50 = 0), ch AS (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY src, dest ORDER BY hops DESC) = class THEN 0 ELSE 1 END AS fresh FROM st), k AS (SELECT *, sum(fresh) OVER (PARTITION BY src, dest ORDER BY hops DESC) AS stretch FROM ch) SELECT src AS origin, dest AS destination, CAST(stretch AS BIGINT) AS stretch, any_value(class) AS class, round(sum(length_m), 3) AS metres FROM k GROUP BY 1, 2, 3",
    "i14_two_tier_volumes": f"WITH RECURSIVE {_DIST}, {_USED} SELECT e[3] AS link_id, CAST(e[4] AS INTEGER) AS direction, e[1] AS u, node AS v, round(sum(demand), 4) AS volume FROM used JOIN dem USING (src, dest) GROUP BY 1, 2, 3, 4",
    "d39_select_link_totals": f"WITH RECURSIVE {_DIST}, {_USED}, via AS (SELECT DISTINCT src, dest FROM used WHERE e[3] % 97 = 0), vd AS (SELECT src, dest, demand FROM via JOIN dem USING (src, dest)), o AS (SELECT src AS node_id, sum(demand) AS x FROM vd GROUP BY 1), q AS (SELECT dest AS node_id, sum(demand) AS x FROM vd GROUP BY 1) SELECT coalesce(o.node_id, q.node_id) AS node_id, coalesce(o.x, 0) AS as_origin, coalesce(q.x, 0) AS as_destination FROM o FULL JOIN q ON o.node_id = q.node_id",
    "c29_candidate_pairs": f"WITH RECURSIVE {_DIST} SELECT DISTINCT a.src AS origin, b.node AS destination FROM dist a JOIN dist b ON a.node = b.src WHERE a.node % 97 = 0 AND a.d + b.d <= {LIMIT} AND a.src <> b.node",
    "d32_municipality_speed": f"WITH RECURSIVE {_DIST}, {_USED}, vol AS (SELECT e[3] AS link_id, e[4] AS direction, sum(demand) AS volume FROM used JOIN dem USING (src, dest) GROUP BY 1, 2), pts AS (SELECT link_id AS centroid_id, (geometry[1].x + geometry[-1].x) / 2 AS x, (geometry[1].y + geometry[-1].y) / 2 AS y FROM norm), {_IN.strip().replace("edges", "ring_edges")}, zo AS (SELECT centroid_id AS link_id, min(municipality_id) AS municipality_id FROM inside GROUP BY 1) SELECT municipality_id, round(sum(volume * length_m) / sum(volume * travel_time_s) * 3.6, 4) AS kmh, count(DISTINCT link_id) AS links FROM vol JOIN net USING (link_id, direction) JOIN zo USING (link_id) GROUP BY ROLLUP (municipality_id)",
    "j06_gravity_demand": f"WITH {_WN}, c AS (SELECT CAST(floor(x / 1500) * 100000 + floor(y / 1500) AS BIGINT) AS zone, sum(w) AS p, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM pts GROUP BY 1), t AS (SELECT a.zone AS a_id, b.zone AS b_id, a.p * b.p * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 5000) AS t FROM c a JOIN c b ON a.zone < b.zone WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 900000000) SELECT a_id, b_id, round(t / sum(t) OVER () * 1000, 5) AS trips FROM t",
    "f03_heaviest_nodes": f"WITH {_WN}, r AS (SELECT zone, centroid_id AS node_id, w, row_number() OVER (PARTITION BY zone ORDER BY round(w, 4) DESC, centroid_id) AS rank FROM pts JOIN zo USING (centroid_id)) SELECT zone, CAST(rank AS INTEGER) AS rank, node_id, round(w, 4) AS w FROM r WHERE rank <= 3",
    "f04_largest_polygon": "WITH b AS (SELECT municipality_id, polygon_id, round((list_max(list_transform(rings[1], lambda p: p.x)) - list_min(list_transform(rings[1], lambda p: p.x))) * (list_max(list_transform(rings[1], lambda p: p.y)) - list_min(list_transform(rings[1], lambda p: p.y))), 3) AS a FROM municipality_polygons) SELECT municipality_id, -max((a, -polygon_id))[2] AS polygon_id FROM b GROUP BY 1",
    "c21_stitched_nodes": "SELECT node_id, m[1] AS node_index, m[2] AS x, m[3] AS y FROM (SELECT node_id, min((node_index, x, y)) AS m FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)",
    "a11_point_file": "SELECT DISTINCT centroid_id, x, y FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL",
    "a23_network_file": f"WITH {net_sql(sp.BIKE)} SELECT u, v, link_id, CAST(direction AS INTEGER) AS direction FROM net",
    "d41_cost_causes": f"WITH l AS (SELECT link_row, -ln({_case(sp.BIKE_SURFACE, 'surface', '1.0')}) AS surface, ln(greatest({_COST} / {sp.REFERENCE_COST}, 1.0)) AS carriageway, -ln({_SHARED}) AS shared, -ln({_TRAFFIC}) AS traffic FROM links) SELECT link_row, round(surface / a, 6) AS surface, round(carriageway / a, 6) AS carriageway, round(shared / a, 6) AS shared, round(traffic / a, 6) AS traffic FROM (SELECT *, surface + carriageway + shared + traffic AS a FROM l) WHERE a > 1e-12",
    "d11_cell_centroids": f"WITH {_CELLS} SELECT zone, cx, cy, round(w, 3) AS w, round(x, 2) AS x, round(y, 2) AS y FROM cell",
    "c08_zone_of_nodes": f"WITH {_WN} SELECT centroid_id AS node_id, zone FROM zo",
    "c09_links_by_municipality": f"WITH pts AS (SELECT link_row AS centroid_id, (geometry[1].x + geometry[-1].x) / 2 AS x, (geometry[1].y + geometry[-1].y) / 2 AS y FROM links WHERE len(geometry) > 1), {_IN.strip()}, zo AS (SELECT centroid_id, min(municipality_id) AS municipality_id FROM inside GROUP BY 1) SELECT municipality_id, count(*) AS links FROM zo GROUP BY 1",
    "d15_access_points": f"WITH {_CELLS} SELECT zone, node_id, round(weight, 8) AS weight FROM points",
    "d17_self_weight": f"WITH {_CELLS} SELECT zone, round(sum(weight * weight), 8) AS self_weight, count(*) AS points FROM points GROUP BY 1",
    "d16_representative": f"WITH {_CELLS}, cost AS (SELECT a.zone, a.node_id, sum(b.w * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS cost FROM cell a JOIN cell b USING (zone) GROUP BY 1, 2) SELECT zone, arg_min(node_id, (round(cost, 2), node_id)) AS node_id FROM cost GROUP BY 1",
    "c06_snap_statistics": "WITH c AS (SELECT DISTINCT centroid_id, x, y FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT *, CAST(floor(x / 100) AS BIGINT) + dx AS jx, CAST(floor(y / 100) AS BIGINT) + dy AS jy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)), n AS (SELECT DISTINCT x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT k.centroid_id, k.x, k.y, min(sqrt((k.x - n.x) ** 2 + (k.y - n.y) ** 2)) AS d FROM k JOIN n ON n.cx = jx AND n.cy = jy WHERE (k.x - n.x) ** 2 + (k.y - n.y) ** 2 <= 10000 GROUP BY 1, 2, 3) SELECT (SELECT count(*) FROM m) AS snapped, (SELECT count(*) FROM c) - (SELECT count(*) FROM m) AS unsnapped, (SELECT round(quantile_cont(d, 0.5), 4) FROM m) AS median_m",
}
