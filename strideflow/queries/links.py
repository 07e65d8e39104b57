"""Queries over the link layer and the network built from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.functions.geometry import along, hilbert_key, grid_index, samples, segments
from strideflow.plans import links as L
from strideflow.plans.numbering import running
from strideflow.sources.tables import read_table


def _norm(s, d):
    return L.normalise(L.read_links(s, d))


def b06_normalised(s, d):
    """Unique ids and measured lengths of the links with a geometry and two different ends."""
    return _norm(s, d).select("link_row", "link_id", "u", "v", F.round("length_m", 4).alias("length_m"))


def h20_link_ends(s, d):
    return L.ends(read_table(s, d, "links", ["link_row", "geometry"]).where("geometry is not null"))


def _speeds(s, d, p):
    return L.priced(_norm(s, d), p).select("link_row", *[F.round(c, 6).alias(c) for c in ("speed_kmh", "speed_reverse_kmh", "travel_time_s", "travel_time_reverse_s")])


def b09_bike_speeds(s, d):
    return _speeds(s, d, sp.BIKE)


def b09_walk_speeds(s, d):
    return _speeds(s, d, sp.WALK)


def b12_factors(s, d):
    """Facility cost, traffic and shared-path factor of each link, before they are multiplied."""
    cost = sp.disutility(F.col("highway"))
    return read_table(s, d, "links", ["link_row", "highway", "segregated", "car_volume"]).select(
        "link_row", F.round(cost, 6).alias("disutility"), F.round(sp.traffic_factor(cost, F.col("car_volume")), 6).alias("traffic"), sp.shared_path(F.col("highway"), F.col("segregated")).alias("shared_path"),
    )


def b18_car_volumes(s, d):
    """Cars an hour: matched, else the class' default where the road carries cars."""
    t = read_table(s, d, "links", ["link_row", "highway", "car_volume"])
    matched = sp.car_volume(F.col("car_volume"))
    return t.where(F.col("highway").isin(*sp.CARS)).select("link_row", F.coalesce(matched, sp.lookup(sp.DEFAULT_CARS, F.col("highway"), None)).alias("cars"), matched.isNotNull().alias("matched"))


def b20_grade_penalty(s, d):
    """Penalty of climbs from 0 to 9 metres over every link's length."""
    t = read_table(s, d, "links", ["link_row", "length_m"]).where("length_m > 0")
    return t.select("link_row", F.round(sp.grade_penalty((F.col("link_row") % 10).cast("double"), F.col("length_m")), 6).alias("penalty_s"))


def b21_signal_waits(s, d):
    t = read_table(s, d, "links", ["link_row"])
    return t.select("link_row", sp.signal_wait((F.col("link_row") % 11 - 1).cast("int")).alias("wait_s"))


def b26_one_way(s, d):
    """Whether a bike and a car may go along and against each link, and whether it is one carriageway of a divided road."""
    t = read_table(s, d, "links", ["link_row", "oneway", "oneway_bicycle", "junction"])
    bike = sp.directions("bike", F.col("oneway"), F.col("oneway_bicycle"), F.col("junction"))
    car = sp.directions("bike", F.col("oneway"), F.lit(None).cast("string"), F.col("junction"))
    single = F.coalesce(F.col("oneway").isin("yes", "true", "1", "F", "-1", "T"), F.lit(False)) & ~F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    has = lambda a, w: F.array_contains(a, w)
    return t.select("link_row", has(bike, 1).alias("bike_along"), has(bike, -1).alias("bike_against"), has(car, 1).alias("car_along"), has(car, -1).alias("car_against"), single.alias("one_carriageway"))


EXCLUDED = {"highway": ("motorway", "motorway_link", "construction", "proposed", "steps"), "crossing": ("no",), "oneway_bicycle": ("dismount",)}


def b01_kept_ways(s, d):
    """Links with a highway none of whose ``;``-parts in the listed fields is listed."""
    t = read_table(s, d, "links", ["link_row", *EXCLUDED])
    bad = None
    for c, values in EXCLUDED.items():
        x = F.coalesce(F.exists(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p.isin(*values)), F.lit(False))
        bad = x if bad is None else bad | x
    return t.where(F.col("highway").isNotNull() & ~bad).select("link_row")


def b33_min_zoom(s, d):
    """The map zoom from which a link is drawn: by its cars, else its class."""
    t = read_table(s, d, "links", ["link_row", "highway", "car_volume"])
    cars, h = sp.car_volume(F.col("car_volume")), F.col("highway")
    zoom = F.when(cars >= 500, 8).when(cars >= 100, 10).when(cars >= 20, 12).when(h.isin("primary", "trunk"), 9).when(h.isin("secondary", "tertiary"), 11).when(h.isin("residential", "cycleway"), 13).otherwise(14)
    return t.select("link_row", zoom.alias("min_zoom"))


def g01_directed_edges(s, d):
    return L.directed_edges(L.priced(_norm(s, d), sp.BIKE), "bike").select("link_id", "u", "v", F.round("travel_time_s", 6).alias("travel_time_s"), F.col("direction").cast("int").alias("direction"))


def d06_fastest_parallel(s, d):
    return L.network(s, d, sp.BIKE).select("u", "v", "link_id", F.round("travel_time_s", 6).alias("travel_time_s"), F.round("length_m", 4).alias("length_m"))


def d07_out_degree(s, d):
    """Edges leaving each node and the offset of its first one when edges are sorted by node."""
    deg = L.network(s, d, sp.WALK).groupBy("u").agg(F.count("*").alias("degree"))
    return running(deg, ["u"], F.col("degree"), "upto").select(F.col("u").alias("node_id"), "degree", (F.col("upto") - F.col("degree")).alias("first_edge"))


def d10_node_weights(s, d):
    """Half the street length of the links at each node."""
    links = _norm(s, d).where(F.coalesce(F.col("highway").isin(*sp.CARS, "pedestrian"), F.lit(False)))
    return links.select(F.explode(F.array("u", "v")).alias("node_id"), "length_m").groupBy("node_id").agg(F.round(F.sum("length_m") / 2, 4).alias("weight")).where("weight > 0")


def _known_nodes(s, d):
    return read_table(s, d, "nodes").where("x is not null and y is not null").groupBy("node_id").agg(F.min(F.struct("node_index", "x", "y")).alias("n")).select("node_id", "n.*")


def e10_hilbert_order(s, d):
    """Nodes numbered along the Hilbert curve; ties by node id."""
    n = _known_nodes(s, d)
    box = n.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda c: grid_index(F.col(c), F.col(c + "0"), F.col(c + "1"), 1 << 16)
    keyed = n.crossJoin(F.broadcast(box)).select("node_id", hilbert_key(cell("x"), cell("y")).alias("key"))
    return running(keyed, ["key", "node_id"], name="n").select("node_id", "key", (F.col("n") - 1).alias("position"))


def c20_resolved_edges(s, d):
    """Edges both of whose ends are known nodes, with the nodes' positions."""
    n = _known_nodes(s, d).select("node_id", "node_index")
    e = L.network(s, d, sp.BIKE)
    return e.join(n.withColumnsRenamed({"node_id": "u", "node_index": "u_index"}), "u").join(n.withColumnsRenamed({"node_id": "v", "node_index": "v_index"}), "v").select("link_id", "u_index", "v_index", F.col("direction").cast("int").alias("direction"))


def c01_edge_geometry(s, d):
    """Edges with the shape of their link, reversed where they run against it; checked that none is without."""
    links = _norm(s, d)
    e = L.network(s, d, sp.BIKE).join(links.select("link_id", "geometry"), "link_id", "left")
    g = F.when(F.col("direction") < 0, F.reverse("geometry")).otherwise(F.col("geometry"))
    g = F.when(g.isNull(), F.raise_error(F.lit("an edge has no link")).cast(links.schema["geometry"].dataType)).otherwise(g)
    return e.select("u", "v", "link_id", F.size(g).alias("vertices"), F.element_at(g, 1)["x"].alias("x_from"), F.element_at(g, -1)["x"].alias("x_to"))


def h22_samples(s, d):
    """Samples at the middles of 10-metre cells along every link."""
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 1")
    return t.select("link_row", F.posexplode(samples(segments("geometry"), 10.0)).alias("i", "p")).select("link_row", "i", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def c14_line_points(s, d):
    """The points at a quarter, half and three quarters of every link's length."""
    t = _norm(s, d).select("link_row", segments("geometry").alias("segs"), "length_m").select("*", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("part"))
    p = along(F.col("segs"), F.col("part") * F.col("length_m"))
    return t.select("link_row", "part", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def h16_tiles(s, d):
    """Tiles of 8 km that the links' boxes touch, with the number of links."""
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 0")
    lo = lambda c: F.floor(F.array_min(F.col("geometry." + c)) / 8000)
    hi = lambda c: F.floor(F.array_max(F.col("geometry." + c)) / 8000)
    b = t.select("link_row", F.explode(F.sequence(lo("x"), hi("x"))).alias("tile_x"), lo("y").alias("y0"), hi("y").alias("y1"))
    return b.select("tile_x", F.explode(F.sequence("y0", "y1")).alias("tile_y")).groupBy("tile_x", "tile_y").agg(F.count("*").alias("links"))


def h34_bounds(s, d):
    t = read_table(s, d, "links", ["geometry"]).where("size(geometry) > 0")
    mm = lambda f, g, c: f(g("geometry." + c))
    return t.agg(mm(F.min, F.array_min, "x").alias("x_min"), mm(F.max, F.array_max, "x").alias("x_max"), mm(F.min, F.array_min, "y").alias("y_min"), mm(F.max, F.array_max, "y").alias("y_max"))


def d40_length_by_highway(s, d):
    return _norm(s, d).groupBy(F.lower(F.trim("highway")).alias("class")).agg(F.count("*").alias("links"), F.round(F.sum("length_m") / 1000, 3).alias("km"))


# ------------------------------------------------------------------ SQL


def _case(table: dict, key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_SEGS = "seg AS (SELECT link_row, i, g[i].x AS ax, g[i].y AS ay, g[i + 1].x AS zx, g[i + 1].y AS zy, sqrt((g[i + 1].x - g[i].x) ** 2 + (g[i + 1].y - g[i].y) ** 2) AS len FROM (SELECT link_row, geometry AS g FROM links WHERE len(geometry) > 1), LATERAL (SELECT unnest(range(1, len(g))) AS i))"
_NORM = f"""{_SEGS}, lens AS (SELECT link_row, sum(len) AS length FROM seg GROUP BY 1),
ok AS (SELECT l.* EXCLUDE (length_m), n.length AS length_m, row_number() OVER (PARTITION BY link_id ORDER BY link_row) AS nth FROM links l JOIN lens n USING (link_row) WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v),
top AS (SELECT coalesce(max(link_id), 0) AS t FROM ok),
norm AS (SELECT * EXCLUDE (nth) FROM ok WHERE nth = 1 UNION ALL SELECT * EXCLUDE (link_id, nth) REPLACE (u AS u), FROM ok WHERE false)"""
_NORM = _NORM[: _NORM.index("norm AS")] + "norm AS (SELECT link_row, CASE WHEN nth = 1 THEN link_id ELSE t + sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (ORDER BY link_row) END::BIGINT AS link_id, u, v, highway, surface, segregated, crossing, oneway, oneway_bicycle, junction, car_volume, geometry, length_m FROM ok, top)"
_COST = f"coalesce({_case(sp.ROAD_BETA, 'highway')} + {sp.SEPARATED_BETA * sp.MIXED}, {sp.REFERENCE_COST})"
_TRAFFIC = f"CASE WHEN car_volume IS NOT NULL AND NOT isnan(car_volume) THEN {_COST} / ({_COST} + {sp.TRAFFIC} * car_volume / {sp.ROUTE_KM}) ELSE 1 END"
_SHARED = f"CASE WHEN highway IN ('cycleway', 'path') AND segregated = 'no' THEN {sp.SHARED_PATH} ELSE 1.0 END"


def _speed_sql(p: sp.Profile) -> str:
    v = f"{_case(p.highway, 'highway', repr(p.base))} * {_case(p.surface, 'surface', '1.0')}"
    if p.mode == "bike":
        v += f" / greatest({_COST} / {sp.REFERENCE_COST}, 1.0) * ({_SHARED}) * ({_TRAFFIC})"
    return f"least(greatest({v}, {p.least}), {p.most})"


def _priced_sql(p: sp.Profile) -> str:
    y = f"CASE WHEN highway IN {_in(sp.PATHS)} AND crossing IS NOT NULL AND crossing NOT IN ('', 'traffic_signals', 'no') THEN {sp.YIELD_S} ELSE 0 END" if p.mode == "bike" else "0"
    return f"{_NORM}, fast AS (SELECT *, {_speed_sql(p)} AS speed FROM norm), priced AS (SELECT *, length_m / (speed / 3.6) + {y} AS secs FROM fast)"


def _edges_sql(p: sp.Profile) -> str:
    if p.mode == "walk":
        fwd = back = "true"
    else:
        o = "coalesce(oneway_bicycle, oneway)"
        rev = f"coalesce({o} IN ('-1', 'T'), false)"
        one = f"(coalesce({o} IN ('yes', 'true', '1', 'F'), false) OR coalesce(junction = 'roundabout', false))"
        fwd, back = f"NOT {rev}", f"({rev} OR NOT {one})"
    return f"""{_priced_sql(p)}, edges AS (SELECT link_id, u, v, secs AS travel_time_s, length_m, 1 AS direction FROM priced WHERE {fwd} UNION ALL SELECT link_id, v, u, secs, length_m, -1 FROM priced WHERE {back})"""


def net_sql(p: sp.Profile) -> str:
    return f"""{_edges_sql(p)}, net AS (SELECT u, v, m[1] AS travel_time_s, m[2] AS link_id, m[3] AS direction, m[4] AS length_m FROM (SELECT u, v, min((travel_time_s, link_id, direction, length_m)) AS m FROM edges WHERE u <> 0 AND v <> 0 GROUP BY u, v))"""


_DIR = lambda o, w: (f"NOT coalesce({o} IN ('-1', 'T'), false)" if w > 0 else f"(coalesce({o} IN ('-1', 'T'), false) OR NOT (coalesce({o} IN ('yes', 'true', '1', 'F'), false) OR coalesce(junction = 'roundabout', false)))")
_NODES = "known AS (SELECT node_id, m[1] AS node_index, m[2] AS x, m[3] AS y FROM (SELECT node_id, min((node_index, x, y)) AS m FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1))"


def _hilbert_sql() -> str:
    out = [f"WITH {_NODES}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM known)",
           "h16 AS (SELECT node_id, least(greatest(floor((x - x0) / (x1 - x0) * 65536), 0), 65535)::BIGINT AS x, least(greatest(floor((y - y0) / (y1 - y0) * 65536), 0), 65535)::BIGINT AS y, 0::BIGINT AS d FROM known, box)"]
    for k in range(15, -1, -1):
        n = 1 << k
        out.append(f"q{k} AS (SELECT node_id, x & {n - 1} AS x, y & {n - 1} AS y, (x & {n}) > 0 AS rx, (y & {n}) > 0 AS ry, d FROM h{k + 1})")
        out.append(f"h{k} AS (SELECT node_id, CASE WHEN ry THEN x WHEN rx THEN {n - 1} - y ELSE y END AS x, CASE WHEN ry THEN y WHEN rx THEN {n - 1} - x ELSE x END AS y, d + {n * n}::BIGINT * xor(3 * rx::BIGINT, ry::BIGINT) AS d FROM q{k})")
    return ", ".join(out) + " SELECT node_id, d AS key, row_number() OVER (ORDER BY d, node_id) - 1 AS position FROM h0"


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:3].lower()[1:3].isdigit()}
SQL = {
    "b06_normalised": f"WITH {_NORM} SELECT link_row, link_id, u, v, round(length_m, 4) AS length_m FROM norm",
    "h20_link_ends": "SELECT link_row, geometry[1].x AS x_u, geometry[1].y AS y_u, geometry[-1].x AS x_v, geometry[-1].y AS y_v FROM links WHERE geometry IS NOT NULL",
    **{f"b09_{p.mode}_speeds": f"WITH {_priced_sql(p)} SELECT link_row, round(speed, 6) AS speed_kmh, round(speed, 6) AS speed_reverse_kmh, round(secs, 6) AS travel_time_s, round(secs, 6) AS travel_time_reverse_s FROM priced" for p in (sp.BIKE, sp.WALK)},
    "b12_factors": f"SELECT link_row, round({_COST}, 6) AS disutility, round({_TRAFFIC}, 6) AS traffic, CAST({_SHARED} AS DOUBLE) AS shared_path FROM links",
    "b18_car_volumes": f"SELECT link_row, coalesce(CASE WHEN NOT isnan(car_volume) THEN car_volume END, {_case(sp.DEFAULT_CARS, 'highway')}) AS cars, (car_volume IS NOT NULL AND NOT isnan(car_volume)) AS matched FROM links WHERE highway IN {_in(sp.CARS)}",
    "b20_grade_penalty": f"SELECT link_row, round(CASE WHEN (link_row % 10) / length_m >= {sp.GRADE_MAX} THEN 0 WHEN (link_row % 10) / length_m > {sp.GRADE_STEEP} THEN {sp.STEEP_FACTOR} * (link_row % 10) ELSE {sp.GRADE_FACTOR} * (link_row % 10) END, 6)::DOUBLE AS penalty_s FROM links WHERE length_m > 0",
    "b21_signal_waits": f"SELECT link_row, CASE WHEN link_row % 11 - 1 BETWEEN 0 AND 8 THEN [{', '.join(str(w) for w in sp.SIGNAL_WAITS)}][link_row % 11]::DOUBLE ELSE 0.0::DOUBLE END AS wait_s FROM links",
    "b26_one_way": f"SELECT link_row, {_DIR('coalesce(oneway_bicycle, oneway)', 1)} AS bike_along, {_DIR('coalesce(oneway_bicycle, oneway)', -1)} AS bike_against, {_DIR('oneway', 1)} AS car_along, {_DIR('oneway', -1)} AS car_against, coalesce(oneway IN ('yes', 'true', '1', 'F', '-1', 'T'), false) AND NOT coalesce(junction = 'roundabout', false) AS one_carriageway FROM links",
    "b01_kept_ways": "SELECT link_row FROM links WHERE highway IS NOT NULL AND " + " AND ".join(f"coalesce(len(list_intersect(list_transform(string_split({c}, ';'), lambda p: trim(p)), [{', '.join(repr(v) for v in vs)}])), 0) = 0" for c, vs in EXCLUDED.items()),
    "b33_min_zoom": "SELECT link_row, CAST(CASE WHEN car_volume >= 500 AND NOT isnan(car_volume) THEN 8 WHEN car_volume >= 100 AND NOT isnan(car_volume) THEN 10 WHEN car_volume >= 20 AND NOT isnan(car_volume) THEN 12 WHEN highway IN ('primary', 'trunk') THEN 9 WHEN highway IN ('secondary', 'tertiary') THEN 11 WHEN highway IN ('residential', 'cycleway') THEN 13 ELSE 14 END AS INTEGER) AS min_zoom FROM links",
    "g01_directed_edges": f"WITH {_edges_sql(sp.BIKE)} SELECT link_id, u, v, round(travel_time_s, 6) AS travel_time_s, CAST(direction AS INTEGER) AS direction FROM edges",
    "d06_fastest_parallel": f"WITH {net_sql(sp.BIKE)} SELECT u, v, link_id, round(travel_time_s, 6) AS travel_time_s, round(length_m, 4) AS length_m FROM net",
    "d07_out_degree": f"WITH {net_sql(sp.WALK)}, deg AS (SELECT u AS node_id, count(*) AS degree FROM net GROUP BY 1) SELECT node_id, degree, CAST(sum(degree) OVER (ORDER BY node_id) - degree AS BIGINT) AS first_edge FROM deg",
    "d10_node_weights": f"WITH {_NORM} SELECT node_id, round(sum(length_m) / 2, 4) AS weight FROM (SELECT u AS node_id, length_m FROM norm WHERE highway IN {_in([*sp.CARS, 'pedestrian'])} UNION ALL SELECT v, length_m FROM norm WHERE highway IN {_in([*sp.CARS, 'pedestrian'])}) GROUP BY 1 HAVING sum(length_m) > 0",
    "e10_hilbert_order": _hilbert_sql(),
    "c20_resolved_edges": f"WITH {net_sql(sp.BIKE)}, {_NODES} SELECT link_id, a.node_index AS u_index, b.node_index AS v_index, CAST(direction AS INTEGER) AS direction FROM net JOIN known a ON a.node_id = u JOIN known b ON b.node_id = v",
    "c01_edge_geometry": f"WITH {net_sql(sp.BIKE)} SELECT n.u, n.v, link_id, CAST(len(geometry) AS INTEGER) AS vertices, CASE WHEN direction < 0 THEN geometry[-1].x ELSE geometry[1].x END AS x_from, CASE WHEN direction < 0 THEN geometry[1].x ELSE geometry[-1].x END AS x_to FROM net n JOIN norm USING (link_id)",
    "h22_samples": f"WITH {_SEGS}, cells AS (SELECT *, greatest(1, round(len / 10))::INT AS n FROM seg WHERE len > 0) SELECT link_row, CAST(row_number() OVER (PARTITION BY link_row ORDER BY i, k) - 1 AS INTEGER) AS i, round(ax + (zx - ax) * (k - 0.5) / n, 3) AS x, round(ay + (zy - ay) * (k - 0.5) / n, 3) AS y FROM cells, LATERAL (SELECT unnest(range(1, n + 1)) AS k)",
    "c14_line_points": f"WITH {_NORM}, cum AS (SELECT link_row, ax, ay, zx, zy, len, sum(len) OVER (PARTITION BY link_row ORDER BY i) AS upto FROM seg WHERE len > 0), places AS (SELECT link_row, part, part * length_m AS dist FROM norm, (VALUES (0.25::DOUBLE), (0.5), (0.75)) p(part)) SELECT a.link_row, part, round(ax + (zx - ax) * (dist - upto + len) / len, 6) AS x, round(ay + (zy - ay) * (dist - upto + len) / len, 6) AS y FROM places a JOIN cum c ON a.link_row = c.link_row AND dist > upto - len AND dist <= upto",
    "h16_tiles": "WITH b AS (SELECT link_row, list_min(list_transform(geometry, lambda p: p.x)) AS x0, list_max(list_transform(geometry, lambda p: p.x)) AS x1, list_min(list_transform(geometry, lambda p: p.y)) AS y0, list_max(list_transform(geometry, lambda p: p.y)) AS y1 FROM links WHERE len(geometry) > 0) SELECT tile_x, tile_y, count(*) AS links FROM b, LATERAL (SELECT unnest(range(floor(x0 / 8000)::BIGINT, floor(x1 / 8000)::BIGINT + 1)) AS tile_x), LATERAL (SELECT unnest(range(floor(y0 / 8000)::BIGINT, floor(y1 / 8000)::BIGINT + 1)) AS tile_y) GROUP BY 1, 2",
    "h34_bounds": "SELECT min(p.x) AS x_min, max(p.x) AS x_max, min(p.y) AS y_min, max(p.y) AS y_max FROM (SELECT unnest(geometry) AS p FROM links)",
    "d40_length_by_highway": f"WITH {_NORM} SELECT lower(trim(highway)) AS class, count(*) AS links, round(sum(length_m) / 1000, 3) AS km FROM norm GROUP BY 1",
}
