"""Queries of routes, stored matrices and fuller forms of earlier operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.operators.nearness import nearest_within, pairs_within, usable
from strideflow.plans import demand as D
from strideflow.plans import graph as G
from strideflow.plans import links as L
from strideflow.plans import routes as T
from strideflow.plans import zones as Z
from strideflow.plans.graph import weak_components
from strideflow.plans.lineage import cut, forget_later, shared_folder
from strideflow.queries.demand import _DAYS, _KEY, _OD, _T, _days, _od, name_key
from strideflow.queries.links import _case, _COST, _NORM, _priced_sql, _SHARED, _TRAFFIC
from strideflow.queries.matching import raster_height
from strideflow.queries.network import _DIST, _USED, LIMIT, _demand, _net, _sources
from strideflow.sources import matrices as M
from strideflow.sources.files import number
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)


def _stops(s, d):
    """A route from every fiftieth node: to the farthest node within two minutes, and from there on likewise."""
    net = _net(s, d)
    m = cut(G.od_matrix(net, _sources(net), LIMIT).select("origin", "destination", R("seconds", 6).alias("seconds")))
    far = cut(m.where("origin <> destination").groupBy("origin").agg(F.max(F.struct("seconds", "destination")).alias("m")).select("origin", F.col("m.destination").alias("to")))
    a = far.where("origin % 50 = 0").select(F.col("origin").alias("route"), "origin", "to")
    b = a.join(far.select(F.col("origin").alias("to"), F.col("to").alias("end")), "to", "left")
    stop = lambda k, c: b.where(f"{c} is not null").select("route", F.lit(k).alias("ord"), F.col(c).alias("node"))
    return net, cut(stop(1, "origin").unionByName(stop(2, "to")).unionByName(stop(3, "end")))


def i20_routes(s, d):
    """Seconds, metres and links of the routes over their stops."""
    net, stops = _stops(s, d)
    t = T.totals(T.route_edges(net, stops), net)
    return t.select("route", R("seconds").alias("seconds"), R("metres", 3).alias("metres"), "links")


def i21_route_geometry(s, d):
    """The routes' lines in travel order: how many points, where they begin and end."""
    net, stops = _stops(s, d)
    g = T.geometry_of(T.route_edges(net, stops), L.normalise(L.read_links(s, d)))
    e = lambda k, c: F.element_at("geometry", k)[c]
    return g.select("route", F.size("geometry").alias("points"), e(1, "x").alias("x_from"), e(1, "y").alias("y_from"), e(-1, "x").alias("x_to"), e(-1, "y").alias("y_to"))


def d40_route_totals(s, d):
    """Metres of each route by highway."""
    net, stops = _stops(s, d)
    h = L.normalise(L.read_links(s, d)).select("link_id", F.coalesce("highway", F.lit("")).alias("highway"), "length_m")
    return T.route_edges(net, stops).join(h, "link_id").groupBy("route", "highway").agg(F.count("*").alias("links"), R(F.sum("length_m"), 3).alias("metres"))


def h36_times_without_traffic(s, d):
    """What each link's bike time would be without the penalty for cars, beside the time with it."""
    links = L.normalise(L.read_links(s, d))
    with_, without = L.priced(links, sp.BIKE), L.priced(links, sp.Profile(**{**sp.BIKE.__dict__, "traffic": 0.0}))
    return with_.select("link_row", R("travel_time_s", 6).alias("seconds")).join(without.select("link_row", R("travel_time_s", 6).alias("without_traffic")), "link_row")


def i30_break_even(s, d):
    """The traffic coefficient at which each link with cars takes as long as the same length of cycleway, up to 0.2, with its change; the smallest change first."""
    t = read_table(s, d, "links", ["link_row", "highway", "car_volume", "length_m"]).where("car_volume > 0 and not isnan(car_volume) and length_m > 0").where(F.col("highway").isin(*sp.ROAD_BETA))
    both = t.select(F.col("link_row").alias("pair"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "highway", "car_volume", "length_m")
    cost = sp.disutility(F.col("highway"))

    def seconds(c):
        road = sp.lookup(sp.BIKE_HIGHWAY, F.col("highway"), sp.BIKE.base) / F.greatest(cost / sp.REFERENCE_COST, F.lit(1.0)) * (cost / (cost + c * F.col("car_volume") / sp.ROUTE_KM))
        return F.when(F.col("side") > 0, F.col("length_m") / (road / 3.6)).otherwise(F.col("length_m") / (11.0 / 3.6))

    found = T.by_change(T.break_even(both, seconds, 0.0, 0.2), sp.TRAFFIC)
    return found.select(F.col("pair").alias("link_row"), R("value", 6).alias("value"), R("change_pct", 2).alias("change_pct"))


def i22_pruned_select_link(s, d):
    """The selected links' pairs of i13, of which only those are assigned whose way there and on from there is within the limit."""
    net, dem = _demand(s, d)
    dem = cut(dem)
    chosen = [r[0] for r in net.where("link_id % 97 = 0").select("link_id").distinct().collect()]
    e = net.join(F.broadcast(s.createDataFrame([(k,) for k in chosen], "link_id bigint")), "link_id", "left_semi").select("u", "v", "travel_time_s")
    heads = cut(e.select(F.col("u").alias("node_id")).distinct())
    back = net.select(F.col("v").alias("u"), F.col("u").alias("v"), "travel_time_s", "length_m", "link_id", "direction")
    to = G.od_matrix(back, heads, LIMIT).select(F.col("origin").alias("u"), F.col("destination").alias("origin"), F.col("seconds").alias("s1"))
    on = G.od_matrix(net, e.select(F.col("v").alias("node_id")).distinct(), LIMIT).select(F.col("origin").alias("v"), "destination", F.col("seconds").alias("s2"))
    able = cut(to.join(e, "u").join(on, "v").where(F.col("s1") + F.col("travel_time_s") + F.col("s2") <= LIMIT + 1e-6).select("origin", "destination").distinct())
    pruned = dem.join(able, ["origin", "destination"], "left_semi")
    return G.assign(net, pruned, LIMIT, chosen).where("kind = 'via'").select("origin", "destination", R("value").alias("demand"))


# ---------------------------------------------------------- stored matrices


def _store(s, d):
    path = f"{shared_folder(s)}/matrices-{uuid.uuid4().hex}"
    forget_later(s, path)
    od = cut(D.od_lengths(D.trips(s, d)))
    ids = od.select(F.explode(F.array("origin", "destination")).alias("id")).distinct()
    M.write_matrix(od.select("origin", "destination", F.col("demand").alias("value")), ids, path, "demand")
    M.write_matrix(od.select("origin", "destination", F.col("length_m").alias("value")), ids, path, "length", "m", append=True)
    return path


def a16_stored_demand(s, d):
    """The demand above five trips from a stored matrix; the threshold reaches the scan."""
    return M.read_matrix(s, _store(s, d), "demand", 5.0).select("origin", "destination", R(F.col("value").cast("double"), 2).alias("demand"))


def a18_stored_ids(s, d):
    """The ids that a store's matrices share."""
    return s.read.parquet(f"{_store(s, d)}/ids")


def a17_stored_totals(s, d):
    """Origin totals of every stored matrix."""
    t = M.origin_totals(s, _store(s, d))
    return t.select("matrix", "origin", R(F.col("total"), 1).alias("total"))


def a20_lengths_in_km(s, d):
    return M.read_as(s, _store(s, d), "length").select("origin", "destination", R("value", 6).alias("km"))


def a41_matrix_sink(s, d):
    """The stored lengths, single precision, by origin."""
    return M.read_matrix(s, _store(s, d), "length").groupBy("origin").agg(F.count("*").alias("cells"), R(F.max(F.col("value").cast("double")), 1).alias("largest"))


# ------------------------------------------------- fuller forms of operators


def d21_reachable_share(s, d):
    """Pairs with a way, and their share of all pairs of the centroids' ids."""
    m = D.od_lengths(D.trips(s, d))
    n = read_table(s, d, "centroids", ["centroid_id"]).where("centroid_id is not null").agg(F.count_distinct("centroid_id").alias("zones"))
    return m.agg(F.count("*").alias("pairs")).crossJoin(F.broadcast(n)).select("pairs", "zones", R(F.col("pairs") / (F.col("zones") * F.col("zones")), 9).alias("reachable"))


def f02_exported_pairs(s, d):
    """All pairs by falling demand, with their place."""
    from strideflow.plans.numbering import running

    t = running(_od(s, d).withColumn("r", -F.round("demand", 6)), ["r", "origin", "destination"], name="place")
    return t.select("place", "origin", "destination", R("demand").alias("demand"))


def f04_largest_by_area(s, d):
    """Every municipality's largest polygon by its area, holes taken off."""
    t = read_table(s, d, "municipality_polygons", ["polygon_id", "municipality_id", "rings"])
    area = F.aggregate(F.transform("rings", lambda r, k: Z.ring_area(r) * F.when(k == 0, 1).otherwise(-1)), F.lit(0.0), lambda a, v: a + v)
    return t.groupBy("municipality_id").agg(F.max(F.struct(F.round(area, 3).alias("a"), (-F.col("polygon_id")).alias("k"))).alias("m")).select("municipality_id", (-F.col("m.k")).alias("polygon_id"))


def d37_merged_counters(s, d):
    """Count lines of a city within 1.1 km of each other, directly or through others, as one: the first of them, and how many they are."""
    t = read_table(s, d, "count_lines", ["line_id", "city", "geometry"]).select("line_id", F.lower(F.trim("city")).alias("city"), F.element_at("geometry", 1)["x"].alias("x"), F.element_at("geometry", 1)["y"].alias("y"))
    t = cut(t)
    p = pairs_within(t, "line_id", 1100.0)
    c = t.select("line_id", "city")
    near = p.join(c.withColumnsRenamed({"line_id": "a_id", "city": "ca"}), "a_id").join(c.withColumnsRenamed({"line_id": "b_id", "city": "cb"}), "b_id").where("ca = cb").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    lab = weak_components(near)
    return t.join(lab, t.line_id == lab.node_id, "left").groupBy(F.coalesce("component", "line_id").alias("line_id")).agg(F.count("*").alias("merged"))


def c25_nearest_counter(s, d):
    """The count line of the same name nearest to each observation with a place."""
    mid = lambda c: (F.element_at("geometry", 1)[c] + F.element_at("geometry", -1)[c]) / 2
    lines = read_table(s, d, "count_lines").select("line_id", name_key(F.col("counter")).alias("name"), mid("x").alias("lx"), mid("y").alias("ly"))
    seen = read_table(s, d, "observed", ["obs_id", "counter_name", "x", "y"]).where(usable()).select("obs_id", name_key(F.col("counter_name")).alias("name"), "x", "y").distinct()
    gap = F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))
    return seen.join(lines, "name").groupBy("obs_id").agg(F.min(F.struct(F.round(gap, 3).alias("m"), "line_id")).alias("m")).select("obs_id", "m.line_id", F.col("m.m").alias("metres"))


def a30_unpivoted_counts(s, d):
    """A sheet with a column for each city turned into rows again: bikes by day and city, cells without a number left out."""
    t = read_table(s, d, "observed", ["city", "obs_date", "bikes"]).where("city is not null and obs_date is not null and bikes >= 0 and not isnan(bikes)")
    t = t.withColumn("city", F.lower(F.trim("city")))
    cities = [r[0] for r in t.groupBy("city").count().orderBy(F.desc("count"), "city").limit(5).collect()]
    wide = t.groupBy(F.col("obs_date").alias("day")).pivot("city", cities).agg(F.sum("bikes"))
    return wide.unpivot(["day"], cities, "city", "bikes").where("bikes is not null").select("day", "city", R("bikes", 2).alias("bikes"))


def j06_gravity_by_direction(s, d):
    """A thousand trips between municipalities of up to 200 km, each direction by itself: by nodes, and exp(-distance / 50 km), by origin."""
    p = read_table(s, d, "municipality_polygons", ["municipality_id", "rings"])
    a = Z.inner_points(p, "municipality_id").join(p.groupBy(F.col("municipality_id").alias("zone")).agg(F.sum(F.size(F.flatten("rings"))).alias("p")), "zone")
    a = cut(a)
    near = pairs_within(a, "zone", 200_000.0)
    one = lambda k, z: a.select(F.col("zone").alias(z), F.col("p").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = near.unionByName(near.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))
    t = both.join(one("a", "a_id"), "a_id").join(one("b", "b_id"), "b_id").withColumn("t", F.col("pa") * F.col("pb") * F.exp(-F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) / 50_000))
    whole = t.agg(F.sum("t").alias("all"))
    return t.crossJoin(F.broadcast(whole)).groupBy(F.col("a_id").alias("origin")).agg(F.count("*").alias("destinations"), R(F.sum(F.col("t") / F.col("all")) * 1000).alias("trips"))


def _heights(s, d):
    """Heights every 25 m at most along the links, both ends among them; pixels whose number divides by 29 have no data."""
    from strideflow.functions.geometry import along, segments

    t = L.normalise(L.read_links(s, d)).select("link_row", "length_m", segments("geometry").alias("segs"))
    n = F.greatest(F.ceil(F.col("length_m") / 25) + 1, F.lit(2)).cast("int")
    p = t.withColumn("n", n).select("link_row", "length_m", "n", "segs", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("p", along(F.col("segs"), F.col("length_m") * F.col("i") / (F.col("n") - 1)))
    px, py = F.floor(F.col("p.x") / 50), F.floor(F.col("p.y") / 50)
    z = F.when((px + py) % 29 != 0, raster_height(px, py).cast("double"))
    return p.select("link_row", "i", "length_m", (F.col("length_m") / (F.col("n") - 1)).alias("step"), z.alias("z"))


def e05_spikes_by_grade(s, d):
    """Heights with spikes gone: inner samples both of whose steps are steeper than a fifth and in opposite directions take their neighbours' mean; without data none."""
    w = Window.partitionBy("link_row").orderBy("i")
    before, after, most = F.col("z") - F.lag("z").over(w), F.lead("z").over(w) - F.col("z"), sp.GRADE_MAX * F.col("step")
    spike = (F.abs(before) > most) & (F.abs(after) > most) & (F.signum(before) != F.signum(after))
    return _heights(s, d).withColumn("smooth", F.when(spike, (F.lag("z").over(w) + F.lead("z").over(w)) / 2).otherwise(F.col("z"))).select("link_row", "i", "smooth")


def d04_ascent_by_grade(s, d):
    """Ascent and descent of the links all of whose samples have a height; a step counts at most a fifth of its length."""
    w = Window.partitionBy("link_row").orderBy("i")
    most = sp.GRADE_MAX * F.col("step")
    z = _heights(s, d).withColumn("up", F.greatest(F.least(F.col("z") - F.lag("z").over(w), most), -most))
    g = z.groupBy("link_row").agg(F.sum(F.greatest(F.coalesce("up", F.lit(0.0)), F.lit(0.0))).alias("a"), F.sum(F.greatest(-F.coalesce("up", F.lit(0.0)), F.lit(0.0))).alias("b"), F.count_if(F.col("z").isNull()).alias("holes"))
    return g.where("holes = 0").select("link_row", R("a").alias("ascent_m"), R("b").alias("descent_m"))


def d05_ascent_per_km(s, d):
    a = d04_ascent_by_grade(s, d).join(L.normalise(L.read_links(s, d)).select("link_row", "length_m"), "link_row")
    return a.agg(R(F.sum("ascent_m") / F.sum("length_m") * 1000).alias("ascent_per_km"))


def b28_measured(s, d):
    """Links whose heights are known, and those that a hand-set climb covers in both directions (here: the primary roads)."""
    a = d04_ascent_by_grade(s, d).select("link_row", F.lit(True).alias("measured"))
    t = L.normalise(L.read_links(s, d)).select("link_row", F.coalesce(F.col("highway") == "primary", F.lit(False)).alias("overridden"))
    return t.join(a, "link_row", "left").groupBy(F.coalesce("measured", F.lit(False)).alias("measured"), "overridden").count().withColumnRenamed("count", "links")


def b19_overridden_times(s, d):
    """Bike times with a hand-set climb of 8 m and a speed of 12 km/h where a link is tertiary, and cars beside it where it is a path."""
    h = F.col("highway")
    links = L.normalise(L.read_links(s, d)).withColumns({
        "ascent_m": F.lit(3.0), "descent_m": F.lit(2.0), "ascent_override_m": F.when(h == "tertiary", 8.0), "speed_override_kmh": F.when(h == "tertiary", 12.0),
        "adjacent_car_volume": F.when(h == "path", 50.0),
    })
    return L.priced(links, sp.BIKE).where(h.isin("tertiary", "path")).select("link_row", R("travel_time_s", 6).alias("along"), R("travel_time_reverse_s", 6).alias("against"))


def b17_sidepaths(s, d):
    """Bike speeds where the cycleway is beside the road: on the right of secondary roads, and one must use it on tertiary ones."""
    h = F.col("highway")
    links = L.normalise(L.read_links(s, d)).withColumns({"cycleway_right": F.when(h == "secondary", "separate"), "bicycle_forward": F.when(h == "tertiary", "use_sidepath"), "oneway": F.lit(None).cast("string"), "oneway_bicycle": F.lit(None).cast("string"), "junction": F.lit(None).cast("string")})
    p = L.priced(links, sp.BIKE).where(h.isin("secondary", "tertiary"))
    return p.select("link_row", R("speed_kmh", 6).alias("along"), R("speed_reverse_kmh", 6).alias("against"))


def b16_cycleway_factors(s, d):
    """Cost of the road by the best facility named for it: a track on secondary, a lane among others on tertiary roads."""
    t = read_table(s, d, "links", ["link_row", "highway"]).where(F.col("highway").isin("secondary", "tertiary", "residential"))
    way = F.when(F.col("highway") == "secondary", "lane; track").when(F.col("highway") == "tertiary", "shared; lane")
    return t.select("link_row", R(sp.disutility(F.col("highway"), F.coalesce(way, F.lit(""))), 6).alias("cost"))


def d03_length_share(s, d):
    """Each link's share of its way's length; of a way without length every link the same."""
    t = L.normalise(L.read_links(s, d)).where("osm_way_id is not null and osm_way_id <> -1").select("link_row", "osm_way_id", "length_m")
    w = Window.partitionBy("osm_way_id")
    whole = F.sum("length_m").over(w)
    return t.select("link_row", R(F.when(whole > 0, F.col("length_m") / whole).otherwise(1 / F.count("*").over(w)), 8).alias("share"))


def h04_parsed_numbers(s, d):
    """Numbers as people write them, read back: with blanks for thousands and a decimal comma; what is none is NULL."""
    t = read_table(s, d, "orders", ["o_orderkey", "o_totalprice"])
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.translate(F.format_number("o_totalprice", 2), ",.", " ,"))
    return t.select("o_orderkey", number(text).alias("value"))


def h05_parsed_places(s, d):
    """Pairs of coordinates in one text, read back."""
    t = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").distinct()
    text = F.concat(F.lit(" "), F.col("x").cast("string"), F.lit(" ; "), F.col("y").cast("string"))
    part = lambda k: F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?(?:E\d+)?)\s*[;,\s]\s*(-?\d+(?:[.,]\d+)?(?:E\d+)?)", k).try_cast("double")
    return t.select("centroid_id", part(1).alias("x"), part(2).alias("y"))


def a39_length_sink(s, d):
    """The trips' lengths by the ids of their zones, single precision, in a file and back."""
    path = f"{shared_folder(s)}/lengths-{uuid.uuid4().hex}"
    forget_later(s, path)
    t = D.trips(s, d).where("length_m is not null and demand > 0")
    t.select("origin", "destination", F.col("demand"), F.col("length_m").cast("float").alias("length_m")).write.parquet(path)
    return s.read.parquet(path).groupBy("origin").agg(F.count("*").alias("trips"), R(F.max(F.col("length_m").cast("double")), 1).alias("longest"))


def h29_counter_features(s, d):
    """Count lines as features of a map: their line and properties as one text."""
    t = read_table(s, d, "count_lines", ["line_id", "city", "counter", "geometry"])
    line = F.transform("geometry", lambda p: F.array(p["x"], p["y"]))
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct("line_id", "city", "counter").alias("properties")))
    return t.select("line_id", F.get_json_object(f, "$.geometry.type").alias("kind"), F.get_json_object(f, "$.properties.counter").alias("counter"), F.get_json_object(f, "$.geometry.coordinates[0][0]").cast("double").alias("x"))


def h30_link_explained(s, d):
    """Why a link has its bike speed: base, surface, carriageway, shared path and traffic, which multiply to it before the limits."""
    t = read_table(s, d, "links", ["link_row", "highway", "surface", "segregated", "car_volume"])
    cost = sp.disutility(F.col("highway"))
    parts = {"base": sp.lookup(sp.BIKE_HIGHWAY, F.col("highway"), sp.BIKE.base), "surface_factor": sp.lookup(sp.BIKE_SURFACE, F.col("surface"), 1.0), "carriageway": 1 / F.greatest(cost / sp.REFERENCE_COST, F.lit(1.0)), "shared": sp.shared_path(F.col("highway"), F.col("segregated")), "traffic": sp.traffic_factor(cost, F.col("car_volume"))}
    whole = None
    for v in parts.values():
        whole = v if whole is None else whole * v
    return t.select("link_row", *[R(v, 6).alias(k) for k, v in parts.items()], R(F.least(F.greatest(whole, F.lit(sp.BIKE.least)), F.lit(sp.BIKE.most)), 6).alias("speed_kmh"))


def c30_links_in_tile(s, d):
    """Links whose box meets the busiest 20 km tile's window, padded by 100 m."""
    b = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 0").select("link_row", *[g("geometry." + c).alias(c + n) for c in "xy" for n, g in (("0", F.array_min), ("1", F.array_max))])
    tile = b.groupBy(F.floor(F.col("x0") / 20_000).alias("tx"), F.floor(F.col("y0") / 20_000).alias("ty")).count().agg(F.max(F.struct("count", "tx", "ty")).alias("m")).select("m.tx", "m.ty")
    return b.crossJoin(F.broadcast(tile)).where("x1 >= tx * 20000 - 100 and x0 <= tx * 20000 + 20100 and y1 >= ty * 20000 - 100 and y0 <= ty * 20000 + 20100").select("link_row")


def b29_snapped_centroids(s, d):
    """Centroids with a node within 100 m; the others are dropped."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").distinct()
    return nearest_within(c, "centroid_id", read_table(s, d, "nodes", ["node_index", "x", "y"]), "node_index", 100.0).select(F.col("id").alias("centroid_id")).distinct()


def b27_structures(s, d):
    """Links on a structure, as their junction tag stands in for it: known, and not 'no'."""
    return read_table(s, d, "links", ["link_row", "junction"]).where("junction is not null and junction <> 'no'").select("link_row")


def f06_sorted_counters(s, d):
    """Counters in the order of city and name."""
    from strideflow.plans.numbering import running

    t = read_table(s, d, "count_lines", ["line_id", "city", "counter"])
    return running(t, ["city", "counter", "line_id"], name="place").select("place", "line_id")


_ST = f"{_DIST}, far AS (SELECT src AS origin, max((round(d, 6), node))[2] AS too FROM dist WHERE src <> node GROUP BY 1), rt AS (SELECT a.origin AS route, a.origin AS s1, a.too AS s2, b.too AS s3 FROM far a LEFT JOIN far b ON b.origin = a.too WHERE a.origin % 50 = 0), lg AS (SELECT route, 1 AS leg, s1 AS src, s2 AS dest FROM rt UNION ALL SELECT route, 2, s2, s3 FROM rt WHERE s3 IS NOT NULL), se AS (SELECT route, leg, w.hops, p.e AS e, w.node FROM lg JOIN walk w ON w.src = lg.src AND w.dest = lg.dest JOIN pred p ON p.src = w.src AND p.node = w.node)"
_PLACES = f"{_NORM}, cum AS (SELECT link_row, ax, ay, zx, zy, len, sum(len) OVER (PARTITION BY link_row ORDER BY i) AS upto, row_number() OVER (PARTITION BY link_row ORDER BY i DESC) AS last FROM seg WHERE len > 0), nn AS (SELECT link_row, length_m, greatest(CAST(ceil(length_m / 25) AS INTEGER) + 1, 2) AS n FROM norm), pl AS (SELECT link_row, n, length_m, k, length_m * k / (n - 1) AS place FROM nn, LATERAL (SELECT unnest(range(0, n)) AS k)), pt AS (SELECT p.link_row, k AS i, length_m, length_m / (n - 1) AS step, ax + (zx - ax) * least((place - upto + len) / len, 1) AS x, ay + (zy - ay) * least((place - upto + len) / len, 1) AS y FROM pl p JOIN cum c ON c.link_row = p.link_row AND place >= upto - len AND (place <= upto OR last = 1) QUALIFY row_number() OVER (PARTITION BY p.link_row, k ORDER BY upto) = 1), hz AS (SELECT link_row, i, length_m, step, CASE WHEN (CAST(floor(x / 50) AS BIGINT) + CAST(floor(y / 50) AS BIGINT)) % 29 <> 0 THEN ((CAST(floor(x / 50) AS BIGINT) * 31 + CAST(floor(y / 50) AS BIGINT) * 17) % 23)::DOUBLE END AS z FROM pt)"
_GRADE = f"{_PLACES}, st AS (SELECT *, greatest(least(z - lag(z) OVER w, 0.2 * step), -0.2 * step) AS up FROM hz WINDOW w AS (PARTITION BY link_row ORDER BY i)), asc_ AS (SELECT link_row, any_value(length_m) AS length_m, sum(greatest(coalesce(up, 0), 0)) AS a, sum(greatest(-coalesce(up, 0), 0)) AS b FROM st GROUP BY 1 HAVING count(*) FILTER (z IS NULL) = 0)"
_AREA = "area AS (SELECT polygon_id, municipality_id, sum(CASE WHEN k = 1 THEN 1 ELSE -1 END * abs(list_sum(list_transform(range(1, len(r)), lambda i: r[i].x * r[i + 1].y - r[i + 1].x * r[i].y))) / 2) AS a FROM (SELECT polygon_id, municipality_id, unnest(rings) AS r, unnest(range(1, len(rings) + 1)) AS k FROM municipality_polygons) GROUP BY 1, 2)"
_STORE = f"WITH {_T}, od AS (SELECT origin, destination, sum(demand) AS demand, sum(demand * length_m) / sum(demand) AS length_m FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1, 2)"
_ROAD_BETA = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sp.ROAD_BETA.items()) + " END"

_BESIDE = _priced_sql(sp.BIKE).replace(", fast AS", ", norm2 AS (SELECT * REPLACE (CASE WHEN highway = 'path' AND (car_volume IS NULL OR isnan(car_volume)) THEN 50 ELSE car_volume END AS car_volume) FROM norm), fast AS").replace("FROM norm), priced", "FROM norm2), priced")
_CLIMB = lambda up: f"CASE WHEN {up} / length_m >= {sp.GRADE_MAX} THEN 0 WHEN {up} / length_m > {sp.GRADE_STEEP} THEN {sp.STEEP_FACTOR} * {up} ELSE {sp.GRADE_FACTOR} * {up} END"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "i20_routes": f"WITH RECURSIVE {_ST} SELECT route, round(sum(n.travel_time_s), 4) AS seconds, round(sum(n.length_m), 3) AS metres, count(*) AS links FROM se JOIN net n ON n.u = e[1] AND n.v = se.node GROUP BY 1",
    "i21_route_geometry": f"WITH RECURSIVE {_ST}, g AS (SELECT route, leg, hops, e[4] AS direction, geometry FROM se JOIN norm ON norm.link_id = e[3]), o AS (SELECT route, len(geometry) AS n, CASE WHEN direction < 0 THEN geometry[-1] ELSE geometry[1] END AS f, CASE WHEN direction < 0 THEN geometry[1] ELSE geometry[-1] END AS t, row_number() OVER (PARTITION BY route ORDER BY leg, hops DESC) AS step FROM g) SELECT route, CAST(sum(n - 1) + 1 AS INTEGER) AS points, arg_min(f, step).x AS x_from, arg_min(f, step).y AS y_from, arg_max(t, step).x AS x_to, arg_max(t, step).y AS y_to FROM o GROUP BY 1",
    "d40_route_totals": f"WITH RECURSIVE {_ST} SELECT route, coalesce(highway, '') AS highway, count(*) AS links, round(sum(n.length_m), 3) AS metres FROM se JOIN norm n ON n.link_id = e[3] GROUP BY 1, 2",
    "h36_times_without_traffic": f"WITH {_priced_sql(sp.BIKE)}, calm AS (SELECT link_row, least(greatest({_case(sp.BIKE_HIGHWAY, 'highway', repr(sp.BIKE.base))} * {_case(sp.BIKE_SURFACE, 'surface', '1.0')} / greatest({_COST} / {sp.REFERENCE_COST}, 1.0) * ({_SHARED}), {sp.BIKE.least}), {sp.BIKE.most}) AS free FROM priced) SELECT link_row, round(secs, 6) AS seconds, round(length_m / (free / 3.6) + secs - length_m / (speed / 3.6), 6) AS without_traffic FROM priced JOIN calm USING (link_row)",
    "h30_link_explained": f"WITH f AS (SELECT link_row, {_case(sp.BIKE_HIGHWAY, 'highway', repr(sp.BIKE.base))} AS base, {_case(sp.BIKE_SURFACE, 'surface', '1.0')} AS surface_factor, 1 / greatest({_COST} / {sp.REFERENCE_COST}, 1.0) AS carriageway, {_SHARED} AS shared, {_TRAFFIC} AS traffic FROM links) SELECT link_row, round(base, 6) AS base, round(surface_factor, 6) AS surface_factor, round(carriageway, 6) AS carriageway, CAST(round(shared, 6) AS DOUBLE) AS shared, CAST(round(traffic, 6) AS DOUBLE) AS traffic, round(least(greatest(base * surface_factor * carriageway * shared * traffic, {sp.BIKE.least}), {sp.BIKE.most}), 6) AS speed_kmh FROM f",
    "i22_pruned_select_link": f"WITH RECURSIVE {_DIST}, {_USED}, via AS (SELECT DISTINCT src, dest FROM used WHERE e[3] % 97 = 0) SELECT src AS origin, dest AS destination, demand FROM via JOIN dem USING (src, dest)",
    "a16_stored_demand": f"{_STORE} SELECT origin, destination, round(demand::FLOAT::DOUBLE, 2) AS demand FROM od WHERE demand::FLOAT > 5",
    "a18_stored_ids": f"{_STORE} SELECT origin AS id FROM od UNION SELECT destination FROM od",
    "a17_stored_totals": f"{_STORE} SELECT 'demand' AS matrix, origin, round(sum(demand::FLOAT::DOUBLE), 1) AS total FROM od GROUP BY 2 UNION ALL SELECT 'length', origin, round(sum(length_m::FLOAT::DOUBLE), 1) FROM od GROUP BY 2",
    "a20_lengths_in_km": f"{_STORE} SELECT origin, destination, round(length_m::FLOAT::DOUBLE / 1000, 6) AS km FROM od",
    "a41_matrix_sink": f"{_STORE} SELECT origin, count(*) AS cells, round(max(length_m::FLOAT::DOUBLE), 1) AS largest FROM od GROUP BY 1",
    "d21_reachable_share": f"{_STORE}, z AS (SELECT count(DISTINCT centroid_id) AS zones FROM centroids) SELECT (SELECT count(*) FROM od) AS pairs, zones, round((SELECT count(*) FROM od) / (zones * zones), 9) AS reachable FROM z",
    "f02_exported_pairs": f"WITH {_OD} SELECT row_number() OVER (ORDER BY -round(demand, 6), origin, destination) AS place, origin, destination, round(demand, 4) AS demand FROM od",
    "f04_largest_by_area": f"WITH {_AREA} SELECT municipality_id, -max((round(a, 3), -polygon_id))[2] AS polygon_id FROM area GROUP BY 1",
    "d37_merged_counters": "WITH RECURSIVE p AS (SELECT line_id, lower(trim(city)) AS city, geometry[1].x AS x, geometry[1].y AS y FROM count_lines), near AS (SELECT a.line_id AS a, b.line_id AS b FROM p a JOIN p b ON a.city = b.city AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1210000), reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), lab AS (SELECT a, min(b) AS c FROM reach GROUP BY 1) SELECT coalesce(c, line_id) AS line_id, count(*) AS merged FROM p LEFT JOIN lab ON a = line_id GROUP BY 1",
    "c25_nearest_counter": f"WITH l AS (SELECT line_id, {_KEY.replace('counter_name', 'counter')} AS name, (geometry[1].x + geometry[-1].x) / 2 AS lx, (geometry[1].y + geometry[-1].y) / 2 AS ly FROM count_lines), o AS (SELECT DISTINCT obs_id, {_KEY} AS name, x, y FROM observed WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)) SELECT obs_id, m[2] AS line_id, m[1] AS metres FROM (SELECT obs_id, min((round(sqrt((x - lx) ** 2 + (y - ly) ** 2), 3), line_id)) AS m FROM o JOIN l USING (name) GROUP BY 1)",
    "a30_unpivoted_counts": "WITH t AS (SELECT lower(trim(city)) AS city, obs_date AS day, bikes FROM observed WHERE city IS NOT NULL AND obs_date IS NOT NULL AND bikes >= 0 AND NOT isnan(bikes)), top5 AS (SELECT city FROM t GROUP BY 1 ORDER BY count(*) DESC, city LIMIT 5) SELECT day, city, round(sum(bikes), 2) AS bikes FROM t JOIN top5 USING (city) GROUP BY 1, 2",
    "e05_spikes_by_grade": f"WITH {_PLACES}, n AS (SELECT *, lag(z) OVER w AS b, lead(z) OVER w AS a FROM hz WINDOW w AS (PARTITION BY link_row ORDER BY i)) SELECT link_row, CAST(i AS INTEGER) AS i, CASE WHEN abs(z - b) > 0.2 * step AND abs(a - z) > 0.2 * step AND sign(z - b) <> sign(a - z) THEN (b + a) / 2 ELSE z END AS smooth FROM n",
    "d04_ascent_by_grade": f"WITH {_GRADE} SELECT link_row, round(a, 4) AS ascent_m, round(b, 4) AS descent_m FROM asc_",
    "d05_ascent_per_km": f"WITH {_GRADE} SELECT round(sum(round(a, 4)) / sum(length_m) * 1000, 4) AS ascent_per_km FROM asc_",
    "b28_measured": f"WITH {_GRADE} SELECT n.link_row IN (SELECT link_row FROM asc_) AS measured, coalesce(highway = 'primary', false) AS overridden, count(*) AS links FROM norm n GROUP BY 1, 2",
    "b19_overridden_times": f"WITH {_BESIDE}, t AS (SELECT link_row, length_m, highway, CASE WHEN highway = 'tertiary' THEN length_m / (12 / 3.6) ELSE secs END AS secs FROM priced WHERE highway IN ('tertiary', 'path')) SELECT link_row, round(secs + CASE WHEN highway = 'tertiary' THEN {_CLIMB('8.0')} ELSE {_CLIMB('3.0')} END, 6) AS along, round(secs + {_CLIMB('2.0')}, 6) AS against FROM t",
    "b17_sidepaths": f"WITH {_priced_sql(sp.BIKE)} SELECT link_row, round(speed / {sp.SIDEPATH}, 6) AS along, round(speed, 6) AS against FROM priced WHERE highway IN ('secondary', 'tertiary')",
    "b16_cycleway_factors": "SELECT link_row, round(" + _ROAD_BETA + " + 2.61 * CASE highway WHEN 'secondary' THEN 0.966::DOUBLE WHEN 'tertiary' THEN 1.142 ELSE 1.927 END, 6) AS cost FROM links WHERE highway IN ('secondary', 'tertiary', 'residential')",
    "d03_length_share": f"WITH {_NORM}, w AS (SELECT n.link_row, l.osm_way_id, n.length_m FROM norm n JOIN links l USING (link_row) WHERE osm_way_id IS NOT NULL AND osm_way_id <> -1) SELECT link_row, round(CASE WHEN sum(length_m) OVER p > 0 THEN length_m / sum(length_m) OVER p ELSE 1 / count(*) OVER p END, 8) AS share FROM w WINDOW p AS (PARTITION BY osm_way_id)",
    "h04_parsed_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS value FROM orders",
    "h05_parsed_places": "SELECT DISTINCT centroid_id, x, y FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL",
    "a39_length_sink": f"WITH {_T} SELECT origin, count(*) AS trips, round(max(length_m::FLOAT::DOUBLE), 1) AS longest FROM t WHERE demand > 0 AND length_m IS NOT NULL GROUP BY 1",
    "h29_counter_features": "SELECT line_id, 'LineString' AS kind, counter, geometry[1].x AS x FROM count_lines",
    "c30_links_in_tile": "WITH b AS (SELECT link_row, list_min(list_transform(geometry, lambda p: p.x)) AS x0, list_max(list_transform(geometry, lambda p: p.x)) AS x1, list_min(list_transform(geometry, lambda p: p.y)) AS y0, list_max(list_transform(geometry, lambda p: p.y)) AS y1 FROM links WHERE len(geometry) > 0), m AS (SELECT max((n, tx, ty)) AS m FROM (SELECT count(*) AS n, CAST(floor(x0 / 20000) AS BIGINT) AS tx, CAST(floor(y0 / 20000) AS BIGINT) AS ty FROM b GROUP BY 2, 3)) SELECT link_row FROM b, m WHERE x1 >= m[2] * 20000 - 100 AND x0 <= m[2] * 20000 + 20100 AND y1 >= m[3] * 20000 - 100 AND y0 <= m[3] * 20000 + 20100",
    "b29_snapped_centroids": "WITH c AS (SELECT DISTINCT centroid_id, x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL), n AS (SELECT x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL) SELECT DISTINCT centroid_id FROM (SELECT *, cx + dx AS jx, cy + dy AS jy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c JOIN n ON n.cx = jx AND n.cy = jy WHERE (c.x - n.x) ** 2 + (c.y - n.y) ** 2 <= 10000",
    "b27_structures": "SELECT link_row FROM links WHERE junction IS NOT NULL AND junction <> 'no'",
    "f06_sorted_counters": "SELECT row_number() OVER (ORDER BY city, counter, line_id) AS place, line_id FROM count_lines",
}
