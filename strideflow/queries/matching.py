"""Queries that lay lines, heights and ways over the link layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.functions.geometry import line_length, samples, segments
from strideflow.operators.linematch import coverage, line_claims, weighed, winners
from strideflow.operators.nearness import pairs_within
from strideflow.operators.ways import junction_marks, split_ways
from strideflow.plans.lineage import cut
from strideflow.queries.links import _SEGS, _in
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)
CLASSES = ("icev_vrk", "bev_vrk", "van_vrk", "truck_vrk", "semi_trailer_vrk")


def a22_road_volumes(s, d):
    """One row per undirected pair of nodes: all vehicles both ways, and the line that runs forward (names in order), else the first."""
    t = read_table(s, d, "volumes", ["source_row", "i_node", "j_node", "road_class", *CLASSES]).where("coalesce(road_class, 0) <> 99 and i_node is not null and j_node is not null")
    total = sum((F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in CLASSES[1:]), F.coalesce(F.when(~F.isnan(CLASSES[0]), F.col(CLASSES[0])), F.lit(0.0)))
    k = t.select(F.least("i_node", "j_node").alias("a"), F.greatest("i_node", "j_node").alias("b"), (F.col("i_node") > F.col("j_node")).alias("back"), "source_row", total.alias("v"))
    return k.groupBy("a", "b").agg(R(F.sum("v"), 3).alias("volume"), F.min(F.struct("back", "source_row")).alias("m")).select("a", "b", "volume", F.col("m.source_row").alias("source_row"))


def a21_volume_lines(s, d):
    """Volume lines with a shape and a number, and their length."""
    t = read_table(s, d, "volumes", ["source_row", "volume", "geometry"]).where("size(geometry) > 1 and volume is not null and not isnan(volume)")
    return t.select("source_row", "volume", R(line_length("geometry"), 3).alias("length_m"))


def _layers(s, d):
    src = read_table(s, d, "volumes", ["source_row", "geometry"]).select(F.col("source_row").alias("source"), "geometry")
    tgt = read_table(s, d, "links", ["link_row", "highway", "geometry"]).where(F.col("highway").isin(*sp.CARS)).select(F.col("link_row").alias("target"), "geometry")
    return src, tgt


def c10_claims(s, d):
    """Samples of the volume lines and the car links beside them."""
    src, tgt = _layers(s, d)
    return line_claims(src, tgt).select("source", "i", "target", R("distance", 5).alias("distance"), "forward")


def d24_claim_weights(s, d):
    src, tgt = _layers(s, d)
    return weighed(line_claims(src, tgt)).select("source", "target", R("weight", 6).alias("weight"), R("along", 6).alias("along"), R("against", 6).alias("against"), "samples", R("distance", 5).alias("distance"))


def d25_coverage(s, d):
    src, tgt = _layers(s, d)
    return coverage(line_claims(src, tgt), src).select("source", R("coverage", 6).alias("coverage"))


def c11_map_matching(s, d):
    """The volume line that each car link takes its volume from."""
    src, tgt = _layers(s, d)
    c = cut(line_claims(src, tgt))
    return winners(weighed(c), coverage(c, src)).select("target", "source", R("distance", 5).alias("distance"))


def b37_unmatched_lines(s, d):
    """Volume lines that no link takes its volume from, with their coverage."""
    src, tgt = _layers(s, d)
    c = cut(line_claims(src, tgt))
    cov = cut(coverage(c, src))
    return cov.join(winners(weighed(c), cov).select("source").distinct(), "source", "left_anti").select("source", R("coverage", 6).alias("coverage"))


def d26_divided_lines(s, d):
    """Volume lines of whose weight at least a quarter lies in each direction."""
    src, tgt = _layers(s, d)
    w = weighed(line_claims(src, tgt)).groupBy("source").agg(F.sum("along").alias("a"), F.sum("against").alias("b"))
    return w.where("a / (a + b) >= 0.25 and b / (a + b) >= 0.25").select("source", R(F.col("a") / (F.col("a") + F.col("b")), 6).alias("share_along"))


def d28_vehicle_km(s, d):
    """Vehicle kilometres of the lines and of the links that took a line's volume."""
    src, tgt = _layers(s, d)
    c = cut(line_claims(src, tgt))
    win = winners(weighed(c), coverage(c, src))
    v = read_table(s, d, "volumes", ["source_row", "volume", "geometry"]).where("size(geometry) > 1")
    link = read_table(s, d, "links", ["link_row", "geometry"])
    got = win.join(v.select(F.col("source_row").alias("source"), "volume"), "source").join(link.select(F.col("link_row").alias("target"), line_length("geometry").alias("m")), "target").agg(F.sum(F.col("volume") * F.col("m")).alias("g"))
    return v.agg(F.sum(F.col("volume") * line_length("geometry")).alias("h")).crossJoin(got).select(R(F.col("h") / 1000, 2).alias("source_km"), R(F.col("g") / 1000, 2).alias("carried_km"))


def c13_adjacent_volumes(s, d):
    """Cycleways, footways and paths that run beside a road for at least half their samples: the mean of its cars."""
    t = read_table(s, d, "links", ["link_row", "highway", "car_volume", "geometry"])
    road = t.where(F.col("highway").isin(*sp.CARS) & F.col("car_volume").isNotNull() & ~F.isnan("car_volume"))
    path = t.where(F.col("highway").isin("cycleway", "footway", "path")).select(F.col("link_row").alias("source"), "geometry")
    c = cut(line_claims(path, road.select(F.col("link_row").alias("target"), "geometry"), 20.0, 0.8660254037844387))
    near = c.groupBy("source", "i").agg(F.min(F.struct(R("distance", 6).alias("d"), "target")).alias("m")).select("source", "i", F.col("m.target").alias("link_row"))
    cars = near.join(road.select("link_row", "car_volume"), "link_row").groupBy("source").agg(F.avg("car_volume").alias("cars"))
    return cars.join(coverage(c, path), "source").where("coverage >= 0.5").select(F.col("source").alias("link_row"), R("cars", 4).alias("adjacent_car_volume"), R("coverage", 6).alias("coverage"))


def c12_lines_in_reach(s, d):
    """Volume lines whose box, widened by the reach, meets the links' box."""
    links = read_table(s, d, "links", ["geometry"]).agg(*[f(g("geometry." + c)).alias(c + n) for c in "xy" for n, f, g in (("0", F.min, F.array_min), ("1", F.max, F.array_max))])
    t = read_table(s, d, "volumes", ["source_row", "geometry"]).where("size(geometry) > 0")
    b = t.select("source_row", *[g("geometry." + c).alias(f"v{c}{n}") for c in "xy" for n, g in (("0", F.array_min), ("1", F.array_max))])
    return b.crossJoin(F.broadcast(links)).where("vx0 - 12 <= x1 and vx1 + 12 >= x0 and vy0 - 12 <= y1 and vy1 + 12 >= y0").select("source_row")


def c16_beside_structures(s, d):
    """Links that share an end with a structure (here: a primary road) and are none themselves."""
    t = read_table(s, d, "links", ["link_row", "highway", "u", "v"])
    ends = t.where("highway = 'primary'").select(F.explode(F.array("u", "v")).alias("n")).where("n is not null and n <> 0").distinct()
    own = t.where("highway is not null and highway <> 'primary'").select("link_row", F.explode(F.array("u", "v")).alias("n"))
    return own.join(ends, "n", "left_semi").select("link_row").distinct()


# --------------------------------------------------------------- heights


def raster_height(px, py):
    """The made-up height of a pixel, a whole number of metres."""
    return (px * 31 + py * 17) % 23


def _profile(s, d):
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 1")
    p = t.select("link_row", F.posexplode(samples(segments("geometry"), 25.0)).alias("i", "p")).withColumns({"px": F.floor(F.col("p.x") / 50), "py": F.floor(F.col("p.y") / 50)})
    raster = p.select("px", "py").distinct().withColumn("z", raster_height(F.col("px"), F.col("py")).cast("double"))
    return p.join(raster, ["px", "py"], "left").select("link_row", "i", "z")


def a28_raster_samples(s, d):
    """Heights of the samples of every link, from a raster table."""
    return _profile(s, d)


def _along():
    return Window.partitionBy("link_row").orderBy("i")


def e05_spikes_removed(s, d):
    """Heights with the spikes gone: samples both of whose steps are over 5 m and in opposite directions take their neighbours' mean."""
    before, after = F.col("z") - F.lag("z").over(_along()), F.lead("z").over(_along()) - F.col("z")
    spike = (F.abs(before) > 5) & (F.abs(after) > 5) & (F.signum(before) != F.signum(after))
    return _profile(s, d).withColumn("smooth", F.when(spike, (F.lag("z").over(_along()) + F.lead("z").over(_along())) / 2).otherwise(F.col("z"))).select("link_row", "i", "smooth")


def d04_ascent(s, d):
    """Ascent and descent of every link, a step counting 5 m at most, and the heights of its ends."""
    z = _profile(s, d).withColumn("step", F.greatest(F.least(F.col("z") - F.lag("z").over(_along()), F.lit(5.0)), F.lit(-5.0)))
    up, down = F.sum(F.greatest(F.coalesce("step", F.lit(0.0)), F.lit(0.0))), F.sum(F.greatest(-F.coalesce("step", F.lit(0.0)), F.lit(0.0)))
    return z.groupBy("link_row").agg(up.alias("ascent_m"), down.alias("descent_m"), F.min_by("z", "i").alias("z_u"), F.max_by("z", "i").alias("z_v"))


# ------------------------------------------------------------------ ways


def _ways(s, d):
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 1")
    ref = lambda p: F.round(p["x"] * 100).cast("bigint") * 1_000_000_000 + F.round(p["y"] * 100).cast("bigint")
    return t.select(F.col("link_row").alias("way"), F.transform("geometry", ref).alias("refs"))


def e01_junction_marks(s, d):
    return junction_marks(_ways(s, d))


def e02_split_ways(s, d):
    return split_ways(_ways(s, d))


def d03_piece_share(s, d):
    """Each piece's share of its way's vertices."""
    p = split_ways(_ways(s, d)).withColumn("steps", F.col("last") - F.col("first"))
    total = p.groupBy("way").agg(F.sum("steps").alias("all"))
    return p.join(total, "way").select("way", "piece", R(F.col("steps") / F.col("all"), 6).alias("share"))


# --------------------------------------------------------------- signals


def _signals(s, d):
    t = read_table(s, d, "links", ["u", "v", "crossing"]).where("crossing = 'traffic_signals'")
    return t.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id is not null and node_id <> 0").distinct()


def c17_signal_ends(s, d):
    """Links with a signalled node at their start and end."""
    t = read_table(s, d, "links", ["link_row", "u", "v"])
    n = _signals(s, d)
    a, b = n.select(F.col("node_id").alias("u"), F.lit(True).alias("at_start")), n.select(F.col("node_id").alias("v"), F.lit(True).alias("at_end"))
    j = t.join(a, "u", "left").join(b, "v", "left").select("link_row", F.coalesce("at_start", F.lit(False)).alias("at_start"), F.coalesce("at_end", F.lit(False)).alias("at_end"))
    return j.where("at_start or at_end")


def c19_signal_pairs(s, d):
    """Signalled nodes at most 80 m apart."""
    xy = read_table(s, d, "nodes").where("x is not null and y is not null").groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y")
    return pairs_within(xy.join(_signals(s, d), "node_id"), "node_id", 80.0)


def d44_junction_class(s, d):
    """The largest road class and the number of links at every signalled node."""
    t = read_table(s, d, "links", ["highway", "u", "v"])
    rank = sp.lookup({"primary": 4, "secondary": 3, "tertiary": 2}, F.col("highway"), 1.0).cast("int")
    ends = t.select(F.explode(F.array("u", "v")).alias("node_id"), rank.alias("rank"))
    return ends.join(_signals(s, d), "node_id").groupBy("node_id").agg(F.max("rank").alias("class"), F.count("*").alias("links"))


# ------------------------------------------------------------------- sets


def g05_all_nodes(s, d):
    """Node ids of links and nodes together."""
    t = read_table(s, d, "links", ["u", "v"])
    return t.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id is not null").unionByName(read_table(s, d, "nodes", ["node_id"]).where("node_id is not null")).distinct()


def g06_known_ends(s, d):
    t = read_table(s, d, "links", ["u", "v"])
    return t.select(F.explode(F.array("u", "v")).alias("node_id")).intersect(read_table(s, d, "nodes", ["node_id"])).where("node_id is not null")


def g08_missing_tiles(s, d):
    """Tiles of 200 m with a node and without a centroid."""
    tile = lambda t: read_table(s, d, t, ["x", "y"]).where("x is not null and y is not null").select(F.floor(F.col("x") / 200).alias("tx"), F.floor(F.col("y") / 200).alias("ty")).distinct()
    return tile("nodes").exceptAll(tile("centroids"))


# ------------------------------------------------------------------ SQL

_LINE = "lseg AS (SELECT source_row AS source, j, g[j].x AS ax, g[j].y AS ay, g[j + 1].x AS zx, g[j + 1].y AS zy, sqrt((g[j + 1].x - g[j].x) ** 2 + (g[j + 1].y - g[j].y) ** 2) AS len FROM (SELECT source_row, geometry AS g FROM volumes WHERE len(geometry) > 1), LATERAL (SELECT unnest(range(1, len(g))) AS j))"


def _claims_sql(line: str, target: str, reach: float, cos: float) -> str:
    return f"""{line}, cells AS (SELECT *, greatest(1, round(len / 20))::INT AS n FROM lseg WHERE len > 0),
smp AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY j, k) - 1 AS INTEGER) AS i, ax + (zx - ax) * (k - 0.5) / n AS x, ay + (zy - ay) * (k - 0.5) / n AS y, (zx - ax) / len AS ux, (zy - ay) / len AS uy FROM cells, LATERAL (SELECT unnest(range(1, n + 1)) AS k)),
{_SEGS}, tseg AS (SELECT link_row AS target, ax, ay, zx - ax AS dx, zy - ay AS dy, len FROM seg JOIN ({target}) USING (link_row) WHERE len > 0),
near AS (SELECT s.*, t.*, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (len * len))) AS c FROM smp s JOIN tseg t ON t.ax BETWEEN s.x - 250 AND s.x + 250 AND t.ay BETWEEN s.y - 250 AND s.y + 250 WHERE abs(ux * dx + uy * dy) >= {cos} * len),
hit AS (SELECT source, i, target, min((sqrt((x - ax - dx * c) ** 2 + (y - ay - dy * c) ** 2), ux * dx + uy * dy >= 0)) AS m FROM near GROUP BY 1, 2, 3),
claims AS (SELECT source, i, target, m[1] AS distance, m[2] AS forward FROM hit WHERE m[1] <= {reach}),
wts AS (SELECT source, target, sum(exp(-distance / 10)) AS weight, coalesce(sum(exp(-distance / 10)) FILTER (forward), 0) AS along, coalesce(sum(exp(-distance / 10)) FILTER (NOT forward), 0) AS against, count(*) AS samples, avg(distance) AS distance FROM claims GROUP BY 1, 2),
cov AS (SELECT s.source, count(DISTINCT c.i) / count(DISTINCT s.i) AS coverage FROM smp s LEFT JOIN claims c ON c.source = s.source AND c.i = s.i GROUP BY 1),
win AS (SELECT target, m[2] AS source, m[3] AS distance FROM (SELECT target, min((-round(weight, 9), source, distance)) AS m FROM wts JOIN cov USING (source) WHERE coverage >= 0.5 GROUP BY 1))"""


_C = _claims_sql(_LINE, f"SELECT link_row FROM links WHERE highway IN {_in(sp.CARS)}", 12.0, 0.7071067811865476)
_PATHS = "lseg AS (SELECT source, j, g[j].x AS ax, g[j].y AS ay, g[j + 1].x AS zx, g[j + 1].y AS zy, sqrt((g[j + 1].x - g[j].x) ** 2 + (g[j + 1].y - g[j].y) ** 2) AS len FROM (SELECT link_row AS source, geometry AS g FROM links WHERE len(geometry) > 1 AND highway IN ('cycleway', 'footway', 'path')), LATERAL (SELECT unnest(range(1, len(g))) AS j))"
_CP = _claims_sql(_PATHS, f"SELECT link_row FROM links WHERE highway IN {_in(sp.CARS)} AND car_volume IS NOT NULL AND NOT isnan(car_volume)", 20.0, 0.8660254037844387)
_V = " + ".join(f"coalesce(CASE WHEN NOT isnan({c}) THEN {c} END, 0)" for c in CLASSES)
_Z = f"{_SEGS}, cells AS (SELECT *, greatest(1, round(len / 25))::INT AS n FROM seg WHERE len > 0), smp AS (SELECT link_row, CAST(row_number() OVER (PARTITION BY link_row ORDER BY i, k) - 1 AS INTEGER) AS i, ax + (zx - ax) * (k - 0.5) / n AS x, ay + (zy - ay) * (k - 0.5) / n AS y FROM cells, LATERAL (SELECT unnest(range(1, n + 1)) AS k)), prof AS (SELECT link_row, i, ((floor(x / 50)::BIGINT * 31 + floor(y / 50)::BIGINT * 17) % 23)::DOUBLE AS z FROM smp)"
_REFS = "refs AS (SELECT link_row AS way, i - 1 AS pos, round(geometry[i].x * 100)::BIGINT * 1000000000 + round(geometry[i].y * 100)::BIGINT AS ref, len(geometry) AS n FROM links, LATERAL (SELECT unnest(range(1, len(geometry) + 1)) AS i) WHERE len(geometry) > 1), marks AS (SELECT way, CAST(pos AS INTEGER) AS pos, ref FROM refs WHERE pos = 0 OR pos = n - 1 OR ref IN (SELECT ref FROM refs GROUP BY 1 HAVING count(*) > 1)), pieces AS (SELECT way, CAST(row_number() OVER w AS INTEGER) AS piece, ref AS u, lead(ref) OVER w AS v, pos AS first, lead(pos) OVER w AS last FROM marks WINDOW w AS (PARTITION BY way ORDER BY pos))"
_SIG = "sig AS (SELECT u AS node_id FROM links WHERE crossing = 'traffic_signals' AND u IS NOT NULL AND u <> 0 UNION SELECT v FROM links WHERE crossing = 'traffic_signals' AND v IS NOT NULL AND v <> 0)"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "a22_road_volumes": f"SELECT least(i_node, j_node) AS a, greatest(i_node, j_node) AS b, round(sum({_V}), 3) AS volume, min((i_node > j_node, source_row))[2] AS source_row FROM volumes WHERE coalesce(road_class, 0) <> 99 AND i_node IS NOT NULL AND j_node IS NOT NULL GROUP BY 1, 2",
    "a21_volume_lines": f"WITH {_LINE} SELECT source AS source_row, any_value(volume) AS volume, round(sum(len), 3) AS length_m FROM lseg JOIN volumes ON source_row = source WHERE volume IS NOT NULL AND NOT isnan(volume) GROUP BY 1",
    "c10_claims": f"WITH {_C} SELECT source, i, target, round(distance, 5) AS distance, forward FROM claims",
    "d24_claim_weights": f"WITH {_C} SELECT source, target, round(weight, 6) AS weight, round(along, 6) AS along, round(against, 6) AS against, samples, round(distance, 5) AS distance FROM wts",
    "d25_coverage": f"WITH {_C} SELECT source, round(coverage, 6) AS coverage FROM cov",
    "c11_map_matching": f"WITH {_C} SELECT target, source, round(distance, 5) AS distance FROM win",
    "b37_unmatched_lines": f"WITH {_C} SELECT source, round(coverage, 6) AS coverage FROM cov WHERE source NOT IN (SELECT source FROM win)",
    "d26_divided_lines": f"WITH {_C}, w AS (SELECT source, sum(along) AS a, sum(against) AS b FROM wts GROUP BY 1) SELECT source, round(a / (a + b), 6) AS share_along FROM w WHERE a / (a + b) >= 0.25 AND b / (a + b) >= 0.25",
    "d28_vehicle_km": f"WITH {_C}, sl AS (SELECT source, sum(len) AS m FROM lseg GROUP BY 1), tl AS (SELECT link_row AS target, sum(len) AS m FROM seg GROUP BY 1) SELECT (SELECT round(sum(volume * m) / 1000, 2) FROM sl JOIN volumes ON source_row = source) AS source_km, (SELECT round(sum(volume * m) / 1000, 2) FROM win JOIN tl USING (target) JOIN volumes v ON v.source_row = win.source) AS carried_km",
    "c13_adjacent_volumes": f"WITH {_CP}, near1 AS (SELECT source, i, min((round(distance, 6), target))[2] AS link_row FROM claims GROUP BY 1, 2), cars AS (SELECT source, avg(car_volume) AS cars FROM near1 JOIN links USING (link_row) GROUP BY 1) SELECT source AS link_row, round(cars, 4) AS adjacent_car_volume, round(coverage, 6) AS coverage FROM cars JOIN cov USING (source) WHERE coverage >= 0.5",
    "c12_lines_in_reach": "WITH b AS (SELECT min(p.x) AS x0, max(p.x) AS x1, min(p.y) AS y0, max(p.y) AS y1 FROM (SELECT unnest(geometry) AS p FROM links)), v AS (SELECT source_row, min(p.x) AS vx0, max(p.x) AS vx1, min(p.y) AS vy0, max(p.y) AS vy1 FROM (SELECT source_row, unnest(geometry) AS p FROM volumes) GROUP BY 1) SELECT source_row FROM v, b WHERE vx0 - 12 <= x1 AND vx1 + 12 >= x0 AND vy0 - 12 <= y1 AND vy1 + 12 >= y0",
    "c16_beside_structures": "WITH e AS (SELECT u AS n FROM links WHERE highway = 'primary' UNION SELECT v FROM links WHERE highway = 'primary') SELECT DISTINCT link_row FROM links WHERE highway IS NOT NULL AND highway <> 'primary' AND (u IN (SELECT n FROM e WHERE n IS NOT NULL AND n <> 0) OR v IN (SELECT n FROM e WHERE n IS NOT NULL AND n <> 0))",
    "a28_raster_samples": f"WITH {_Z} SELECT link_row, i, z FROM prof",
    "e05_spikes_removed": f"WITH {_Z}, n AS (SELECT *, lag(z) OVER w AS b, lead(z) OVER w AS a FROM prof WINDOW w AS (PARTITION BY link_row ORDER BY i)) SELECT link_row, i, CASE WHEN abs(z - b) > 5 AND abs(a - z) > 5 AND sign(z - b) <> sign(a - z) THEN (b + a) / 2 ELSE z END AS smooth FROM n",
    "d04_ascent": f"WITH {_Z}, st AS (SELECT *, greatest(least(z - lag(z) OVER (PARTITION BY link_row ORDER BY i), 5), -5) AS step FROM prof) SELECT link_row, coalesce(sum(step) FILTER (step > 0), 0)::DOUBLE AS ascent_m, coalesce(-sum(step) FILTER (step < 0), 0)::DOUBLE AS descent_m, arg_min(z, i) AS z_u, arg_max(z, i) AS z_v FROM st GROUP BY 1",
    "e01_junction_marks": f"WITH {_REFS} SELECT way, pos, ref FROM marks",
    "e02_split_ways": f"WITH {_REFS} SELECT * FROM pieces WHERE v IS NOT NULL",
    "d03_piece_share": f"WITH {_REFS} SELECT way, piece, round((last - first) / sum(last - first) OVER (PARTITION BY way), 6) AS share FROM pieces WHERE v IS NOT NULL",
    "c17_signal_ends": f"WITH {_SIG} SELECT link_row, coalesce(u IN (SELECT node_id FROM sig), false) AS at_start, coalesce(v IN (SELECT node_id FROM sig), false) AS at_end FROM links WHERE coalesce(u IN (SELECT node_id FROM sig), false) OR coalesce(v IN (SELECT node_id FROM sig), false)",
    "c19_signal_pairs": f"WITH {_SIG}, p AS (SELECT node_id, min((x, y)) AS p FROM nodes JOIN sig USING (node_id) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT a.node_id AS a_id, b.node_id AS b_id FROM p a JOIN p b ON a.node_id < b.node_id AND (a.p[1] - b.p[1]) ** 2 + (a.p[2] - b.p[2]) ** 2 <= 6400",
    "d44_junction_class": f"WITH {_SIG}, e AS (SELECT u AS node_id, highway FROM links UNION ALL SELECT v, highway FROM links) SELECT node_id, CAST(max(CASE highway WHEN 'primary' THEN 4 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 2 ELSE 1 END) AS INTEGER) AS class, count(*) AS links FROM e JOIN sig USING (node_id) GROUP BY 1",
    "g05_all_nodes": "SELECT u AS node_id FROM links WHERE u IS NOT NULL UNION SELECT v FROM links WHERE v IS NOT NULL UNION SELECT node_id FROM nodes WHERE node_id IS NOT NULL",
    "g06_known_ends": "SELECT node_id FROM nodes WHERE node_id IS NOT NULL INTERSECT (SELECT u FROM links UNION SELECT v FROM links)",
    "g08_missing_tiles": "SELECT DISTINCT CAST(floor(x / 200) AS BIGINT) AS tx, CAST(floor(y / 200) AS BIGINT) AS ty FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL EXCEPT SELECT CAST(floor(x / 200) AS BIGINT), CAST(floor(y / 200) AS BIGINT) FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL",
}
