"""Queries of the single steps that larger operators are made of, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.functions.geometry import line_length
from strideflow.operators.nearness import nearest_within
from strideflow.plans import demand as D
from strideflow.plans import graph as G
from strideflow.plans import layers as Y
from strideflow.plans import links as L
from strideflow.plans.lineage import cut, forget_later, shared_folder
from strideflow.plans.numbering import running
from strideflow.queries.demand import _OD, _od, _T
from strideflow.queries.links import _case, _COST, _in, _NORM, _SEGS, _TRAFFIC, net_sql
from strideflow.queries.network import _cell_points, _demand, _DIST, _net, _sources, _ZP, LIMIT
from strideflow.queries.routes import _heights, _PLACES
from strideflow.queries.signals import _tables
from strideflow.sources.files import read_demand, read_points
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)


def _links(s, d, *c):
    return read_table(s, d, "links", ["link_row", *c])


def b08_effective_oneway(s, d):
    """The tag that rules a bike's direction."""
    return _links(s, d, "oneway", "oneway_bicycle").select("link_row", sp.effective_oneway("bike", F.col("oneway"), F.col("oneway_bicycle")).alias("oneway"))


def b10_profile_speeds(s, d):
    """Walking and riding speeds by class and surface alone."""
    v = lambda p, h, f: R(sp.lookup(h, F.col("highway"), p.base) * sp.lookup(f, F.col("surface"), 1.0), 6)
    return _links(s, d, "highway", "surface").select("link_row", v(sp.WALK, sp.WALK_HIGHWAY, sp.WALK_SURFACE).alias("walk_kmh"), v(sp.BIKE, sp.BIKE_HIGHWAY, sp.BIKE_SURFACE).alias("bike_kmh"))


def b11_profile_times(s, d):
    """Walking times without any penalty."""
    t = L.normalise(L.read_links(s, d))
    return t.select("link_row", R(sp.travel_time(F.col("length_m"), F.least(F.greatest(sp.lookup(sp.WALK_HIGHWAY, F.col("highway"), sp.WALK.base) * sp.lookup(sp.WALK_SURFACE, F.col("surface"), 1.0), F.lit(sp.WALK.least)), F.lit(sp.WALK.most))), 6).alias("seconds"))


def b13_disutilities(s, d):
    return _links(s, d, "highway").select("link_row", R(sp.disutility(F.col("highway")), 6).alias("cost"))


def b14_traffic_factors(s, d):
    """What the cars leave of the speed, where their number is known."""
    t = _links(s, d, "highway", "car_volume").where("car_volume is not null and not isnan(car_volume)")
    return t.select("link_row", R(sp.traffic_factor(sp.disutility(F.col("highway")), F.col("car_volume")), 8).alias("factor"))


def b22_wait_table(s, d):
    """Seconds of every signal code."""
    t = s.range(0, 9).select(F.col("id").cast("int").alias("code"))
    return t.select("code", sp.signal_wait(F.col("code")).alias("seconds"))


def b25_car_links(s, d):
    return _links(s, d, "highway").where(F.col("highway").isin(*sp.CARS)).select("link_row")


def b31_positive_demand(s, d):
    """Trips whose demand is a number above zero."""
    return D.trips(s, d).where("demand > 0").select("trip_id", R("demand").alias("demand"))


def b32_matrix_cutoff(s, d):
    """The cells of the point matrix of at most 45 seconds, the limit included."""
    net = _net(s, d)
    return G.od_matrix(net, _sources(net), 45.0).select("origin", "destination", R("seconds").alias("seconds"))


def c05_nearest_nodes(s, d):
    """The node nearest to each centroid within 100 m."""
    c = read_table(s, d, "centroids", ["centroid_id", "x", "y"])
    n = nearest_within(c, "centroid_id", read_table(s, d, "nodes", ["node_index", "x", "y"]), "node_index", 100.0)
    return n.select(F.col("id").alias("centroid_id"), "x", "y", F.col("target_id").alias("node_index"), R("distance").alias("metres"))


def c15_raster_lookup(s, d):
    """Heights of the links' places; pixels without data give none."""
    return _heights(s, d).select("link_row", "i", "z")


def d02_link_lengths(s, d):
    return _links(s, d, "geometry").where("size(geometry) > 1").select("link_row", R(line_length("geometry")).alias("length_m"))


def d18_zone_sums(s, d):
    """Numerator and denominator of the cells' mean times."""
    z = G.zone_sums(_net(s, d), cut(_cell_points(s, d)), LIMIT)
    return z.select("origin", "destination", R("num").alias("num"), R("den", 8).alias("den"))


def e03_vertex_places(s, d):
    """Every vertex of every link with its place in the link."""
    return _links(s, d, "geometry").where("size(geometry) > 0").select("link_row", F.posexplode("geometry").alias("pos", "p")).select("link_row", "pos", F.col("p.x").alias("x"))


def e04_height_steps(s, d):
    w = Window.partitionBy("link_row").orderBy("i")
    return _heights(s, d).withColumn("step_z", F.col("z") - F.lag("z").over(w)).where("step_z is not null").select("link_row", "i", "step_z")


def e06_end_heights(s, d):
    """Heights of the links' first and last places."""
    return _heights(s, d).groupBy("link_row").agg(F.min_by("z", "i").alias("z_u"), F.max_by("z", "i").alias("z_v"))


def e08_first_of_parallels(s, d):
    """Of directed edges with the same ends the first in the order of time, link and direction."""
    e = _net(s, d)
    return e.select("u", "v", "link_id", F.col("direction").cast("int").alias("direction"))


def e09_filled_ids(s, d):
    """Rows that got a link id of their own, as theirs was missing or taken."""
    t = L.normalise(L.read_links(s, d)).select("link_row", "link_id")
    old = _links(s, d, "link_id").select("link_row", F.col("link_id").alias("old"))
    return t.join(old, "link_row").where(~F.col("link_id").eqNullSafe(F.col("old"))).select("link_row", "link_id")


def e11_running_offsets(s, d):
    """Where each volume line's vertices begin among all of them."""
    t = read_table(s, d, "volumes", ["source_row", "geometry"]).where("geometry is not null").select("source_row", F.size("geometry").alias("n"))
    return running(t, ["source_row"], F.col("n"), "upto").select("source_row", (F.col("upto") - F.col("n")).alias("first"))


def h08_surface_tokens(s, d):
    """Links one of whose surface's ``;``-parts is asphalt."""
    parts = F.transform(F.split("surface", ";"), lambda p: F.trim(p))
    return _links(s, d, "surface").where(F.array_contains(parts, "asphalt")).select("link_row")


def h09_coerced_numbers(s, d):
    """Counter names' last word as a number, where it is one."""
    t = read_table(s, d, "observed", ["obs_id", "counter_name"]).where("counter_name is not null").distinct()
    return t.select("obs_id", F.element_at(F.split(F.trim("counter_name"), " "), -1).try_cast("bigint").alias("value")).where("value is not null")


def h12_maths(s, d):
    """Root, exponential, logarithm, limits and rounding of the volumes."""
    t = read_table(s, d, "volumes", ["source_row", "volume"]).where("volume > 0 and not isnan(volume)")
    v = F.col("volume")
    return t.select("source_row", R(F.sqrt(v), 6).alias("root"), R(F.exp(-v / 10000), 8).alias("decay"), R(F.log(v), 8).alias("log"), F.least(F.greatest(v, F.lit(100.0)), F.lit(5000.0)).alias("clipped"), F.floor(v / 7).alias("sevenths"))


def h15_cell_keys(s, d):
    """The nodes' cells of 250 m, counted from the south-western corner."""
    n = read_table(s, d, "nodes", ["node_index", "x", "y"]).where("x is not null and y is not null").groupBy("node_index").agg(F.min(F.struct("x", "y")).alias("p")).select("node_index", "p.x", "p.y")
    c = n.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return n.crossJoin(F.broadcast(c)).select("node_index", F.floor((F.col("x") - F.col("x0")) / 250).alias("cx"), F.floor((F.col("y") - F.col("y0")) / 250).alias("cy"))


def h02_tag_columns(s, d):
    tags = ["highway", "cycleway:left", "oneway:bicycle", "surface"]
    return s.createDataFrame([(t, Y.column_name(t)) for t in tags], "tag string, name string")


def h26_rectangles(s, d):
    """Polygons that are an upright rectangle."""
    r = F.element_at("rings", 1)
    t = read_table(s, d, "municipality_polygons", ["polygon_id", "rings"])
    at = lambda p: ((p["x"] == F.array_min(r["x"])) | (p["x"] == F.array_max(r["x"]))) & ((p["y"] == F.array_min(r["y"])) | (p["y"] == F.array_max(r["y"])))
    return t.select("polygon_id", ((F.size("rings") == 1) & F.forall(r, at) & (F.size(F.array_distinct(r)) == 4)).alias("rectangle"))


def h31_text_digests(s, d):
    """SHA-256 of every document's text."""
    return read_table(s, d, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


def h32_durations(s, d):
    """The links' walking times as people say them."""
    t = b11_profile_times(s, d).withColumn("s", F.round("seconds").cast("bigint"))
    m, sec = F.floor(F.col("s") / 60), F.col("s") % 60
    return t.select("link_row", F.when(F.col("s") < 60, F.concat(F.col("s").cast("string"), F.lit(" s"))).otherwise(F.concat(m.cast("string"), F.lit(" min "), sec.cast("string"), F.lit(" s"))).alias("duration"))


def i01_search_from_many(s, d):
    """Seconds from the nearest signalled node, within a minute."""
    _, _, signals, _, _ = _tables(s, d)
    return G.least_cost(_net(s, d), signals, 60.0).select("destination", R("seconds").alias("seconds"))


def i11_assignment_kinds(s, d):
    """How many pairs were assigned and missed, and their metres and demand."""
    net, dem = _demand(s, d)
    return G.assign(net, dem, LIMIT).where("kind <> 'volume'").groupBy("kind").agg(F.count("*").alias("pairs"), R(F.sum("value"), 2).alias("value"))


def i23_compressed_edges(s, d):
    """Edges by the positions of their ends among the network's nodes."""
    net = _net(s, d)
    ids = cut(running(net.select(F.explode(F.array("u", "v")).alias("n")).distinct(), ["n"], name="k").select("n", (F.col("k") - 1).alias("k")))
    a, b = ids.select(F.col("n").alias("u"), F.col("k").alias("tail")), ids.select(F.col("n").alias("v"), F.col("k").alias("head"))
    return net.join(a, "u").join(b, "v").select("link_id", F.col("direction").cast("int").alias("direction"), "tail", "head")


def j03_summed_cells(s, d):
    """Demand of equal cells added up, cells of nothing left out."""
    t = D.trips(s, d).where("demand is not null")
    return t.groupBy(*D.KEYS).agg(F.sum("demand").alias("x")).where("x <> 0").select(*D.KEYS, R("x").alias("demand"))


def j05_sub_matrix(s, d):
    """The demand from the twenty zones with the most to the ten that receive the most."""
    od = cut(_od(s, d))
    top = lambda end, n: od.groupBy(end).agg(F.round(F.sum("demand"), 6).alias("x")).orderBy(F.desc("x"), end).limit(n).select(end)
    return od.join(F.broadcast(top("origin", 20)), "origin", "left_semi").join(F.broadcast(top("destination", 10)), "destination", "left_semi").select(*D.KEYS, R("demand").alias("demand"))


def _csv(s, df):
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    forget_later(s, path)
    df.write.csv(path, header=True, sep=";")
    return path


def a13_weighted_points(s, d):
    """Volume lines' first points with their volume as weight, through a file: missing weights count 1, negative ones and those that aren't numbers 0."""
    t = read_table(s, d, "volumes", ["source_row", "volume", "geometry"]).where("size(geometry) > 0")
    p = t.select("source_row", F.element_at("geometry", 1)["x"].alias("x"), F.element_at("geometry", 1)["y"].alias("y"), F.when(F.col("source_row") % 5 != 0, F.col("volume") - 1000).alias("w"))
    return read_points(s, _csv(s, p), "source_row", weight="w").select(F.col("id").cast("bigint").alias("source_row"), R("weight").alias("weight"))


def a14_demand_file(s, d):
    """The demand through a file with other column names."""
    od = _od(s, d).select(F.col("origin").alias("from"), F.col("destination").alias("to"), F.round("demand", 4).alias("trips"))
    return read_demand(s, _csv(s, od), "from", "to", "trips").select("origin", "destination", "demand")


_WALK_V = f"{_case(sp.WALK_HIGHWAY, 'highway', repr(sp.WALK.base))} * {_case(sp.WALK_SURFACE, 'surface', '1.0')}"
_SIG = "sig AS (SELECT u AS node_id FROM links WHERE crossing = 'traffic_signals' AND u <> 0 UNION SELECT v FROM links WHERE crossing = 'traffic_signals' AND v <> 0)"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "b08_effective_oneway": "SELECT link_row, coalesce(oneway_bicycle, oneway) AS oneway FROM links",
    "b10_profile_speeds": f"SELECT link_row, round({_WALK_V}, 6) AS walk_kmh, round({_case(sp.BIKE_HIGHWAY, 'highway', repr(sp.BIKE.base))} * {_case(sp.BIKE_SURFACE, 'surface', '1.0')}, 6) AS bike_kmh FROM links",
    "b11_profile_times": f"WITH {_NORM} SELECT link_row, round(length_m / (least(greatest({_WALK_V}, {sp.WALK.least}), {sp.WALK.most}) / 3.6), 6) AS seconds FROM norm",
    "b13_disutilities": f"SELECT link_row, round({_COST}, 6) AS cost FROM links",
    "b14_traffic_factors": f"SELECT link_row, round({_TRAFFIC}, 8) AS factor FROM links WHERE car_volume IS NOT NULL AND NOT isnan(car_volume)",
    "b22_wait_table": "SELECT CAST(code AS INTEGER) AS code, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES (0, 0), (1, 15), (2, 15), (3, 8), (4, 15), (5, 19), (6, 14), (7, 10), (8, 7)) t(code, seconds)",
    "b25_car_links": f"SELECT link_row FROM links WHERE highway IN {_in(sp.CARS)}",
    "b31_positive_demand": "SELECT DISTINCT trip_id, round(demand, 4) AS demand FROM trip_lengths WHERE demand > 0 AND NOT isnan(demand)",
    "b32_matrix_cutoff": f"WITH RECURSIVE {_DIST} SELECT src AS origin, node AS destination, round(d, 4) AS seconds FROM dist WHERE d <= 45",
    "c05_nearest_nodes": "WITH c AS (SELECT DISTINCT centroid_id, x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL), n AS (SELECT node_index, x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL) SELECT centroid_id, x, y, m[2] AS node_index, round(sqrt(m[1]), 4) AS metres FROM (SELECT centroid_id, c.x, c.y, min(((c.x - n.x) ** 2 + (c.y - n.y) ** 2, node_index)) AS m FROM (SELECT *, cx + dx AS jx, cy + dy AS jy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c JOIN n ON n.cx = jx AND n.cy = jy WHERE (c.x - n.x) ** 2 + (c.y - n.y) ** 2 <= 10000 GROUP BY 1, 2, 3)",
    "c15_raster_lookup": f"WITH {_PLACES} SELECT link_row, CAST(i AS INTEGER) AS i, z FROM hz",
    "d02_link_lengths": f"WITH {_SEGS} SELECT link_row, round(sum(len), 4) AS length_m FROM seg GROUP BY 1",
    "d18_zone_sums": f"WITH RECURSIVE {_DIST}, {_ZP} SELECT origin, destination, round(num, 4) AS num, round(den, 8) AS den FROM zs",
    "e03_vertex_places": "SELECT link_row, CAST(i - 1 AS INTEGER) AS pos, geometry[i].x AS x FROM links, LATERAL (SELECT unnest(range(1, len(geometry) + 1)) AS i)",
    "e04_height_steps": f"WITH {_PLACES}, n AS (SELECT link_row, i, z - lag(z) OVER (PARTITION BY link_row ORDER BY i) AS step_z FROM hz) SELECT link_row, CAST(i AS INTEGER) AS i, step_z FROM n WHERE step_z IS NOT NULL",
    "e06_end_heights": f"WITH {_PLACES}, k AS (SELECT link_row, min(i) AS a, max(i) AS b FROM hz GROUP BY 1) SELECT k.link_row, p.z AS z_u, q.z AS z_v FROM k JOIN hz p ON p.link_row = k.link_row AND p.i = a JOIN hz q ON q.link_row = k.link_row AND q.i = b",
    "e08_first_of_parallels": f"WITH {net_sql(sp.BIKE)} SELECT u, v, link_id, CAST(direction AS INTEGER) AS direction FROM net",
    "e09_filled_ids": f"WITH {_NORM} SELECT n.link_row, n.link_id FROM norm n JOIN links l USING (link_row) WHERE n.link_id IS DISTINCT FROM l.link_id",
    "e11_running_offsets": "SELECT source_row, CAST(sum(len(geometry)) OVER (ORDER BY source_row) - len(geometry) AS BIGINT) AS first FROM volumes WHERE geometry IS NOT NULL",
    "h08_surface_tokens": "SELECT link_row FROM links WHERE list_contains(list_transform(string_split(surface, ';'), lambda p: trim(p)), 'asphalt')",
    "h09_coerced_numbers": "SELECT DISTINCT obs_id, TRY_CAST(w AS BIGINT) AS value FROM (SELECT obs_id, string_split(trim(counter_name), ' ')[-1] AS w FROM observed WHERE counter_name IS NOT NULL) WHERE regexp_full_match(w, '[+-]?[0-9]+')",
    "h12_maths": "SELECT source_row, round(sqrt(volume), 6) AS root, round(exp(-volume / 10000), 8) AS decay, round(ln(volume), 8) AS log, least(greatest(volume, 100.0), 5000.0)::DOUBLE AS clipped, CAST(floor(volume / 7) AS BIGINT) AS sevenths FROM volumes WHERE volume > 0 AND NOT isnan(volume)",
    "h15_cell_keys": "WITH n AS (SELECT node_index, p[1] AS x, p[2] AS y FROM (SELECT node_index, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), c AS (SELECT min(x) AS x0, min(y) AS y0 FROM n) SELECT node_index, CAST(floor((x - x0) / 250) AS BIGINT) AS cx, CAST(floor((y - y0) / 250) AS BIGINT) AS cy FROM n, c",
    "h02_tag_columns": "SELECT tag, replace(tag, ':', '_') AS name FROM (VALUES ('highway'), ('cycleway:left'), ('oneway:bicycle'), ('surface')) t(tag)",
    "h26_rectangles": "WITH r AS (SELECT polygon_id, rings, list_min(list_transform(rings[1], lambda p: p.x)) AS x0, list_max(list_transform(rings[1], lambda p: p.x)) AS x1, list_min(list_transform(rings[1], lambda p: p.y)) AS y0, list_max(list_transform(rings[1], lambda p: p.y)) AS y1 FROM municipality_polygons) SELECT polygon_id, len(rings) = 1 AND len(list_filter(rings[1], lambda p: NOT ((p.x = x0 OR p.x = x1) AND (p.y = y0 OR p.y = y1)))) = 0 AND len(list_distinct(rings[1])) = 4 AS rectangle FROM r",
    "h31_text_digests": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
    "h32_durations": f"WITH {_NORM}, t AS (SELECT link_row, CAST(round(round(length_m / (least(greatest({_WALK_V}, {sp.WALK.least}), {sp.WALK.most}) / 3.6), 6)) AS BIGINT) AS s FROM norm) SELECT link_row, CASE WHEN s < 60 THEN s || ' s' ELSE (s // 60) || ' min ' || (s % 60) || ' s' END AS duration FROM t",
    "i01_search_from_many": f"WITH RECURSIVE {_DIST}, {_SIG} SELECT node AS destination, round(min(d), 4) AS seconds FROM (SELECT src, node, d FROM dist WHERE d <= 60 UNION ALL SELECT v, v, 0 FROM net) WHERE src IN (SELECT node_id FROM sig) GROUP BY 1",
    "i11_assignment_kinds": f"WITH RECURSIVE {_DIST}, len_ AS (SELECT count(*) AS n, sum(len) AS x FROM dem JOIN ways USING (src, dest)), miss AS (SELECT count(DISTINCT u) AS n FROM net WHERE u % 100 = 7) SELECT 'length' AS kind, n AS pairs, round(x, 2) AS value FROM len_ UNION ALL SELECT 'missed', n, round(2.0 * n, 2)::DOUBLE FROM miss WHERE n > 0",
    "i23_compressed_edges": f"WITH {net_sql(sp.BIKE)}, ids AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k FROM (SELECT u AS n FROM net UNION SELECT v FROM net)) SELECT link_id, CAST(direction AS INTEGER) AS direction, a.k AS tail, b.k AS head FROM net JOIN ids a ON a.n = u JOIN ids b ON b.n = v",
    "j03_summed_cells": f"WITH {_T} SELECT origin, destination, round(sum(demand), 4) AS demand FROM t WHERE demand IS NOT NULL GROUP BY 1, 2 HAVING sum(demand) <> 0",
    "j05_sub_matrix": f"WITH {_OD}, o AS (SELECT origin FROM od GROUP BY 1 ORDER BY round(sum(demand), 6) DESC, origin LIMIT 20), e AS (SELECT destination FROM od GROUP BY 1 ORDER BY round(sum(demand), 6) DESC, destination LIMIT 10) SELECT origin, destination, round(demand, 4) AS demand FROM od JOIN o USING (origin) JOIN e USING (destination)",
    "a13_weighted_points": "SELECT source_row, CASE WHEN source_row % 5 = 0 OR volume IS NULL THEN 1.0 WHEN isnan(volume) OR volume < 1000 OR volume > 1e300 THEN 0.0 ELSE round(volume - 1000, 4) END::DOUBLE AS weight FROM volumes WHERE len(geometry) > 0",
    "a14_demand_file": f"WITH {_OD} SELECT origin, destination, round(demand, 4) AS demand FROM od",
}
