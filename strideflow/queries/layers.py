"""Queries of layers made from ways, loose ends, connectors and runs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.operators.nearness import regions_of_points
from strideflow.plans import layers as Y
from strideflow.plans import links as L
from strideflow.plans.demand import trips
from strideflow.plans.lineage import shared_folder
from strideflow.plans.numbering import running
from strideflow.queries.data import _IN
from strideflow.queries.links import EXCLUDED, _in, _NORM, _priced_sql, net_sql
from strideflow.queries.matching import _REFS
from strideflow.queries.network import _COMP, _net
from strideflow.queries.signals import _xy
from strideflow.sources import files
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)
#: A box over the middle of the country, for clips.
BOX = (250_000.0, 6_700_000.0, 400_000.0, 6_900_000.0)
TAGS = ("highway", "surface", "crossing", "oneway:bicycle")
_BAD = {"highway": EXCLUDED["highway"], "crossing": EXCLUDED["crossing"]}


def _osm(s, d):
    """Ways with references and tags, and their nodes: every vertex is a node, numbered by its place; roads with a gravel surface stand for construction sites."""
    t = read_table(s, d, "links", ["link_row", "highway", "surface", "crossing", "oneway_bicycle", "geometry"]).where("size(geometry) > 1")
    ref = lambda p: F.round(p["x"] * 100).cast("bigint") * 1_000_000_000 + F.round(p["y"] * 100).cast("bigint")
    site = F.coalesce(F.col("surface") == "gravel", F.lit(False))
    tags = F.create_map(F.lit("highway"), F.when(site, "construction").otherwise(F.col("highway")), F.lit("construction"), F.when(site, F.col("highway")), F.lit("surface"), F.col("surface"), F.lit("crossing"), F.col("crossing"), F.lit("oneway:bicycle"), F.col("oneway_bicycle"))
    ways = t.select(F.col("link_row").alias("way"), F.transform("geometry", ref).alias("refs"), F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"))
    nodes = t.select(F.explode("geometry").alias("p")).select(ref(F.col("p")).alias("node_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y")
    return ways, nodes


def a01_way_scan(s, d):
    """Ways with a highway, with their nodes' coordinates joined in."""
    ways, nodes = _osm(s, d)
    placed = Y.placed_ways(ways.where(F.col("tags")["highway"].isNotNull()), nodes)
    return placed.select("way", F.size("refs").alias("nodes"), F.element_at("xs", 1).alias("x_first"), F.element_at("ys", -1).alias("y_last"))


def a02_node_sets(s, d):
    """Signalled nodes, unsignalled crossings and road lights, from the tags of the ways that end there."""
    from strideflow.queries.signals import _tables

    _, _, signals, lights, crossings = _tables(s, d)
    row = lambda df, k: df.select(F.lit(k).alias("kind"), "node_id")
    return row(signals, "signal").unionByName(row(crossings.join(signals, "node_id", "left_anti"), "crossing")).unionByName(row(lights, "light"))


def b02_as_built(s, d):
    ways, _ = _osm(s, d)
    return Y.as_built(ways).where("under_construction").select("way", F.col("tags")["highway"].alias("highway"))


def b03_clipped_ways(s, d):
    """Ways with a node in the box, kept whole."""
    ways, nodes = _osm(s, d)
    return Y.placed_ways(ways, nodes, BOX).select("way", F.size("refs").alias("nodes"))


def a03_kept_ways(s, d):
    """Ways as built, kept by their tags and clipped to the box."""
    ways, nodes = _osm(s, d)
    return Y.placed_ways(Y.kept_ways(Y.as_built(ways), _BAD), nodes, BOX).select("way", "under_construction")


def a05_extracted_links(s, d):
    """The link layer of the ways: numbered pieces from junction to junction with their tags and length."""
    ways, nodes = _osm(s, d)
    e = Y.extract(ways, nodes, _BAD, tags=TAGS)
    return e.select("link_id", "way", "u", "v", "highway", "surface", "oneway_bicycle", "under_construction", R("length_m").alias("length_m"))


def b04_links_in_polygon(s, d):
    """For every municipality the links that begin in it or cross its boundary, whole and numbered anew."""
    t = read_table(s, d, "links", ["link_row", "geometry"]).where("size(geometry) > 1")
    rings = read_table(s, d, "municipality_polygons", ["municipality_id", "rings"])
    first = F.element_at("geometry", 1)
    inside = regions_of_points(t.select("link_row", first["x"].alias("x"), first["y"].alias("y")), "link_row", rings, "municipality_id").select(F.col("region").alias("municipality_id"), F.col("id").alias("link_row"))
    seg = lambda df, g, *keep: df.select(*keep, F.explode(F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.slice(g, F.lit(2), F.size(g) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))).alias("s")).select(*keep, "s.*")
    edge = seg(rings.select("municipality_id", F.explode("rings").alias("ring")), "ring", "municipality_id")
    edge = edge.select("municipality_id", *[F.col(c).alias(f"r{c}") for c in ("ax", "ay", "bx", "by")])
    lines = seg(t, "geometry", "link_row")
    # segments meet in cells of 5 km that their boxes touch
    cells = lambda df, p: df.withColumn("cx", F.explode(F.sequence(F.floor(F.least(f"{p}ax", f"{p}bx") / 5000), F.floor(F.greatest(f"{p}ax", f"{p}bx") / 5000)))).withColumn("cy", F.explode(F.sequence(F.floor(F.least(f"{p}ay", f"{p}by") / 5000), F.floor(F.greatest(f"{p}ay", f"{p}by") / 5000))))
    side = lambda px, py, qx, qy, x, y: (F.col(qx) - F.col(px)) * (F.col(y) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(x) - F.col(px))
    crosses = (side("ax", "ay", "bx", "by", "rax", "ray") * side("ax", "ay", "bx", "by", "rbx", "rby") <= 0) & (side("rax", "ray", "rbx", "rby", "ax", "ay") * side("rax", "ray", "rbx", "rby", "bx", "by") <= 0)
    hit = cells(lines, "").join(cells(edge, "r"), ["cx", "cy"]).where(crosses).select("municipality_id", "link_row")
    kept = hit.unionByName(inside).distinct()
    return running(kept, ["municipality_id", "link_row"], name="n").select("municipality_id", "link_row", (F.col("n") - 1).alias("link_id"))


def c07_resolved_ends(s, d):
    """The ends of links without a node: that of a known end within 2 m, else a new one."""
    t = read_table(s, d, "links", ["link_row", "u", "v", "geometry"])
    got = Y.resolve_ends(t)
    return got.join(t.where("u is null or u = 0 or v is null or v = 0").select("link_row"), "link_row").select("link_row", "u", "v")


def _connectors(s, d):
    return Y.island_connectors(_xy(s, d), _net(s, d), 2000.0, least_nodes=2)


def i25_connector_layer(s, d):
    """Connectors between the network's parts of at least two nodes over gaps of at most 2 km: how many of each kind, and their length."""
    return _connectors(s, d).groupBy("kind").agg(F.count("*").alias("connectors"), R(F.sum("length_m"), 2).alias("metres"), F.count("speed_override_kmh").alias("with_speed"))


def b35_island_ids(s, d):
    """Connectors over water, from the shortest on."""
    return Y.island_ids(_connectors(s, d)).select("link_id")


def g02_merged_layer(s, d):
    """Links and connectors in one layer, by kind; columns that one side lacks are NULL."""
    t = L.normalise(L.read_links(s, d)).select("link_id", "u", "v", "highway", "surface", "length_m")
    m = Y.merge_connectors(t, _connectors(s, d))
    return m.groupBy(F.coalesce("kind", F.lit("link")).alias("kind")).agg(F.count("*").alias("links"), F.count("surface").alias("with_surface"), F.count("u_part_nodes").alias("with_parts"))


def c22_refused_clash(s, d):
    """Connector ids that the layer has as well; with any of them the merge is refused."""
    t = L.normalise(L.read_links(s, d)).select("link_id")
    return t.intersect(_connectors(s, d).select("link_id"))


def b36_exported_edges(s, d):
    """Directed edges without the primary roads, of which only those with a volume."""
    net, vol = _net(s, d), _run(s, d)
    drop = read_table(s, d, "links", ["link_id", "highway"]).where("highway = 'primary' and link_id is not null")
    return Y.export_edges(net, vol, drop).select("link_id", F.col("direction").cast("int").alias("direction"), R("volume").alias("volume"))


def a24_edge_layer(s, d):
    """The edges with a volume and their geometry through a written layer."""
    path = f"{shared_folder(s)}/edges-{uuid.uuid4().hex}"
    files.temporary(s, path)
    g = L.normalise(L.read_links(s, d)).select("link_id", "geometry")
    Y.export_edges(_net(s, d), _run(s, d)).join(g, "link_id").write.parquet(path)
    return s.read.parquet(path).select("link_id", F.col("direction").cast("int").alias("direction"), F.size("geometry").alias("vertices"))


def c24_edge_rows(s, d):
    return Y.edge_rows(_net(s, d), read_table(s, d, "links", ["link_id", "link_row"]))


def f09_edge_order(s, d):
    """The edges' places in the order of their ends."""
    e = _net(s, d).select("u", "v", "link_id", F.col("direction").cast("int").alias("direction"))
    return Y.ordered_edges(e)


def _run(s, d):
    """A run on the network: the cars of the link as the volume of its directed edges."""
    cars = L.normalise(L.read_links(s, d)).select("link_id", F.when(~F.isnan("car_volume"), F.col("car_volume")).alias("c"))
    return _net(s, d).join(cars, "link_id").select("link_id", F.col("direction").cast("int").alias("direction"), "u", "v", F.coalesce("c", F.lit(0.0)).alias("volume"), "travel_time_s", "length_m")


def _layer(s, d):
    return L.normalise(L.read_links(s, d)).select("link_row", "link_id", "u", "v", "length_m")


def a33_run_on_links(s, d):
    """A run's volumes by link row, along and against the link, joined on link and direction."""
    return Y.run_on_links(_run(s, d), _layer(s, d)).where("forward > 0 or reverse > 0").select("link_row", R("forward").alias("forward"), R("reverse").alias("reverse"), R("forward_time").alias("forward_time"))


def a33_old_run_on_links(s, d):
    """The same of a run without link ids: joined on the ends, either way round."""
    return Y.run_on_links(_run(s, d).select("u", "v", "volume"), _layer(s, d)).where("forward > 0 or reverse > 0").select("link_row", R("forward").alias("forward"), R("reverse").alias("reverse"))


def b34_run_measure(s, d):
    """The total volume of every link row."""
    return Y.measure(Y.run_on_links(_run(s, d), _layer(s, d)), "volume").select("link_row", R("value").alias("value"))


def d22_assignment_summary(s, d):
    v = Y.volume_summary(_run(s, d), _net(s, d))
    return v.select("edges", "loaded_edges", R("loaded_fraction", 6).alias("loaded_fraction"), R("total_volume", 2).alias("total_volume"), "max_volume", "median_loaded_volume")


def d43_volume_compare(s, d):
    """The run against itself with the volumes of primary roads halved."""
    a = _run(s, d)
    prim = L.normalise(L.read_links(s, d)).where("highway = 'primary'").select("link_id", F.lit(0.5).alias("f"))
    b = a.join(prim, "link_id", "left").withColumn("volume", F.col("volume") * F.coalesce("f", F.lit(1.0)))
    c = Y.compare_volumes(a, b)
    return c.select(R("total_volume").alias("total_volume"), R("total_abs_diff").alias("total_abs_diff"), R("relative_abs_diff", 6).alias("relative_abs_diff"), "edges_differing")


def d33_mode_share(s, d):
    """Of each municipality, and of all, the share of the trips' demand that is under 3 km, which stands for a mode."""
    from strideflow.queries.demand import _zone_municipality

    t = trips(s, d).where("demand > 0").join(_zone_municipality(s, d), "origin")
    mine = F.when(F.col("length_m") < 3000, F.col("demand")).otherwise(0.0)
    return t.rollup("municipality_id").agg(R(F.sum(mine), 5).alias("mode_trips"), R(F.sum("demand"), 5).alias("all_trips"), R(F.try_divide(F.sum(mine), F.sum("demand")), 6).alias("mode_share"))


def c26_line_volumes(s, d):
    """The cars of the links that each count line crosses."""
    lines = read_table(s, d, "count_lines", ["line_id", "geometry"]).where("size(geometry) > 1")
    t = read_table(s, d, "links", ["link_row", "car_volume", "geometry"]).where("size(geometry) > 1")
    part = lambda df, p, *keep: df.select(*keep, F.explode(F.zip_with(F.slice("geometry", F.lit(1), F.size("geometry") - 1), F.slice("geometry", F.lit(2), F.size("geometry") - 1), lambda a, b: F.struct(a["x"].alias(f"{p}ax"), a["y"].alias(f"{p}ay"), b["x"].alias(f"{p}bx"), b["y"].alias(f"{p}by")))).alias("s")).select(*keep, "s.*")
    cells = lambda df, p: df.withColumn("cx", F.explode(F.sequence(F.floor(F.least(f"{p}ax", f"{p}bx") / 1000), F.floor(F.greatest(f"{p}ax", f"{p}bx") / 1000)))).withColumn("cy", F.explode(F.sequence(F.floor(F.least(f"{p}ay", f"{p}by") / 1000), F.floor(F.greatest(f"{p}ay", f"{p}by") / 1000))))
    side = lambda a, b, q: (F.col(f"{b}x") - F.col(f"{a}x")) * (F.col(f"{q}y") - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (F.col(f"{q}x") - F.col(f"{a}x"))
    crosses = (side("la", "lb", "ta") * side("la", "lb", "tb") <= 0) & (side("ta", "tb", "la") * side("ta", "tb", "lb") <= 0)
    hit = cells(part(lines, "l", "line_id"), "l").join(cells(part(t, "t", "link_row", "car_volume"), "t"), ["cx", "cy"]).where(crosses).select("line_id", "link_row", "car_volume").distinct()
    cars = F.coalesce(F.sum(F.when(~F.isnan("car_volume"), F.col("car_volume"))), F.lit(0.0))
    return hit.groupBy("line_id").agg(F.count("*").alias("links"), R(cars).alias("cars"))


def b07_annotated(s, d):
    """Speeds and times with an empty column for a hand-set speed."""
    a = L.priced(L.normalise(L.read_links(s, d)), sp.WALK)
    return a.select("link_row", R("speed_kmh", 6).alias("speed_kmh"), R("travel_time_s", 6).alias("travel_time_s"), "speed_override_kmh")


def b15_carriageway_divisor(s, d):
    """What a class divides the bike's speed by; classes outside the table are left out."""
    t = read_table(s, d, "links", ["highway"]).where(F.col("highway").isin(*sp.ROAD_BETA)).distinct()
    return t.select("highway", R(F.greatest(sp.disutility(F.col("highway")) / sp.REFERENCE_COST, F.lit(1.0)), 8).alias("divisor"))


def g07_no_demand_classes(s, d):
    """Highways that trips don't begin at: paths without pedestrian streets, and what joins parts."""
    t = s.createDataFrame([(h,) for h in (*sp.PATHS, Y.CONNECTOR, "crossing_entry")], "highway string")
    return t.exceptAll(s.createDataFrame([("pedestrian",)], "highway string"))


def h23_profile_places(s, d):
    """Places of a height profile along every link: at most 25 m apart, both ends among them."""
    t = L.normalise(L.read_links(s, d)).select("link_row", "length_m")
    n = F.greatest(F.ceil(F.col("length_m") / 25) + 1, F.lit(2)).cast("int")
    return t.select("link_row", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("length_m") * k / (n - 1))).alias("i", "at")).select("link_row", "i", R("at").alias("at_m"))


_SEG = lambda t, key, p: f"(SELECT {key}, g[i].x AS {p}ax, g[i].y AS {p}ay, g[i + 1].x AS {p}bx, g[i + 1].y AS {p}by FROM (SELECT {key}, geometry AS g FROM {t} WHERE len(geometry) > 1), LATERAL (SELECT unnest(range(1, len(g))) AS i))"
_SIDE = lambda a, b, q: f"(({b}x - {a}x) * ({q}y - {a}y) - ({b}y - {a}y) * ({q}x - {a}x))"
_SITE = "coalesce(surface = 'gravel', false)"
_PART = lambda c: f"list_transform(string_split({c}, ';'), lambda p: trim(p))"
_KEEP = "highway IS NOT NULL AND " + " AND ".join(f"coalesce(len(list_intersect({_PART(c)}, [{', '.join(repr(v) for v in vs)}])), 0) = 0" for c, vs in _BAD.items())
_WAYS = f"ways AS (SELECT link_row AS way, geometry, {_SITE} AND highway IS NOT NULL AND trim(highway) NOT IN ('', 'yes', 'no', 'construction') AND NOT contains(highway, ';') AS site, CASE WHEN NOT {_SITE} THEN highway WHEN highway IS NOT NULL AND trim(highway) NOT IN ('', 'yes', 'no', 'construction') AND NOT contains(highway, ';') THEN trim(highway) ELSE 'construction' END AS highway, surface, crossing, oneway_bicycle FROM links WHERE len(geometry) > 1)"
_INBOX = f"len(list_filter(geometry, lambda p: p.x BETWEEN {BOX[0]} AND {BOX[2]} AND p.y BETWEEN {BOX[1]} AND {BOX[3]})) > 0"
_XTR = f"""{_WAYS}, kw AS (SELECT * FROM ways WHERE {_KEEP}), refs AS (SELECT way, i - 1 AS pos, round(geometry[i].x * 100)::BIGINT * 1000000000 + round(geometry[i].y * 100)::BIGINT AS ref, len(geometry) AS n FROM kw, LATERAL (SELECT unnest(range(1, len(geometry) + 1)) AS i)),
marks AS (SELECT way, pos, ref FROM refs WHERE pos = 0 OR pos = n - 1 OR ref IN (SELECT ref FROM refs GROUP BY 1 HAVING count(*) > 1)), pieces AS (SELECT way, ref AS u, lead(ref) OVER w AS v, pos AS a, lead(pos) OVER w AS b FROM marks WINDOW w AS (PARTITION BY way ORDER BY pos)),
nxy AS (SELECT ref, p[1] AS x, p[2] AS y FROM (SELECT round(p.x * 100)::BIGINT * 1000000000 + round(p.y * 100)::BIGINT AS ref, min((p.x, p.y)) AS p FROM (SELECT unnest(geometry) AS p FROM ways) GROUP BY 1)),
st AS (SELECT r.way, r.pos, sqrt((nxy.x - lag(nxy.x) OVER w) ** 2 + (nxy.y - lag(nxy.y) OVER w) ** 2) AS len FROM refs r JOIN nxy USING (ref) WINDOW w AS (PARTITION BY r.way ORDER BY r.pos)),
xl AS (SELECT row_number() OVER (ORDER BY way, a) - 1 AS link_id, * FROM pieces WHERE v IS NOT NULL)"""
_RUN = f"""{net_sql(sp.BIKE)}, run AS (SELECT n.link_id, n.direction, n.u, n.v, CASE WHEN NOT isnan(o.car_volume) THEN o.car_volume ELSE 0 END AS vol0, n.travel_time_s, n.length_m FROM net n JOIN norm o USING (link_id)), rv AS (SELECT link_id, direction, u, v, coalesce(vol0, 0) AS volume, travel_time_s, length_m FROM run)"""
_PLACED = f"{_RUN}, pl AS (SELECT o.link_row, coalesce(sum(volume) FILTER (direction > 0), 0) AS forward, coalesce(sum(volume) FILTER (direction < 0), 0) AS reverse, max(travel_time_s) FILTER (direction > 0) AS forward_time FROM norm o LEFT JOIN rv USING (link_id) GROUP BY 1)"
_OLD = f"{_RUN}, fe AS (SELECT u, v, min(link_row) AS link_row FROM norm GROUP BY 1, 2), pl AS (SELECT coalesce(a.link_row, b.link_row) AS link_row, sum(CASE WHEN a.link_row IS NOT NULL THEN volume ELSE 0 END) AS forward, sum(CASE WHEN a.link_row IS NULL THEN volume ELSE 0 END) AS reverse FROM rv LEFT JOIN fe a ON a.u = rv.u AND a.v = rv.v LEFT JOIN fe b ON b.u = rv.v AND b.v = rv.u WHERE coalesce(a.link_row, b.link_row) IS NOT NULL GROUP BY 1)"
_LOOSE = """ends AS (SELECT link_row, 0 AS side, coalesce(u, 0) AS node, geometry[1].x AS x, geometry[1].y AS y FROM links WHERE len(geometry) > 0 UNION ALL SELECT link_row, 1, coalesce(v, 0), geometry[-1].x, geometry[-1].y FROM links WHERE len(geometry) > 0),
loose AS (SELECT *, row_number() OVER (ORDER BY side, link_row) AS e FROM ends WHERE node = 0),
adopt AS (SELECT e, min((sqrt((l.x - k.x) ** 2 + (l.y - k.y) ** 2), k.node))[2] AS node FROM loose l JOIN ends k ON k.node <> 0 AND abs(l.x - k.x) <= 2 AND abs(l.y - k.y) <= 2 AND (l.x - k.x) ** 2 + (l.y - k.y) ** 2 <= 4 GROUP BY 1),
rest AS (SELECT row_number() OVER (ORDER BY e) AS i, e, x, y FROM loose WHERE e NOT IN (SELECT e FROM adopt)),
nb AS (SELECT a.i, list(b.i) AS near FROM rest a JOIN rest b ON abs(a.x - b.x) <= 2 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 GROUP BY 1),
lead(i, ls) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT l.i + 1, CASE WHEN list_has_any(nb.near, l.ls) THEN l.ls ELSE list_append(l.ls, nb.i) END FROM lead l JOIN nb ON nb.i = l.i + 1),
ll AS (SELECT ls FROM lead ORDER BY i DESC LIMIT 1),
mint AS (SELECT r.e, -list_position(ls, list_min(list_filter(near, lambda q: list_contains(ls, q)))) AS node FROM rest r JOIN nb USING (i), ll),
res AS (SELECT link_row, side, node FROM ends WHERE node <> 0 UNION ALL SELECT link_row, side, coalesce(a.node, m.node) FROM loose LEFT JOIN adopt a USING (e) LEFT JOIN mint m USING (e))"""

#: The forest of shortest gaps by Kruskal's method over the components' shortest gaps.
_FOREST = f"""{_COMP}, xy AS (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), cx AS (SELECT node_id, component, x, y, CAST(floor(x / 2000) AS BIGINT) AS gx, CAST(floor(y / 2000) AS BIGINT) AS gy FROM comp JOIN xy USING (node_id)),
gap AS (SELECT least(a.component, b.component) AS ca, greatest(a.component, b.component) AS cb, min((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.node_id, b.node_id)) AS m FROM (SELECT *, gx + dx AS jx, gy + dy AS jy FROM cx, (VALUES (-1), (0), (1)) q(dx), (VALUES (-1), (0), (1)) r(dy)) a JOIN cx b ON a.jx = b.gx AND a.jy = b.gy WHERE a.node_id < b.node_id AND a.component <> b.component AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4000000 GROUP BY 1, 2),
names AS (SELECT component, row_number() OVER (ORDER BY component) AS k, count(*) AS part FROM comp GROUP BY 1), cand AS (SELECT row_number() OVER (ORDER BY m) AS i, m, a.k AS ka, b.k AS kb FROM gap JOIN names a ON a.component = ca JOIN names b ON b.component = cb),
kr(i, lab, took) AS (SELECT 0::BIGINT, (SELECT list(k ORDER BY k) FROM names), false UNION ALL SELECT c.i, CASE WHEN lab[ka] = lab[kb] THEN lab ELSE list_transform(lab, lambda q: CASE WHEN q = lab[kb] THEN lab[ka] ELSE q END) END, lab[ka] <> lab[kb] FROM kr JOIN cand c ON c.i = kr.i + 1),
forest AS (SELECT m[2] AS u, m[3] AS v, m[1] AS gap_m, ka, kb FROM kr JOIN cand USING (i) WHERE took)"""
QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "a01_way_scan": f"WITH {_WAYS}, nxy AS (SELECT ref, p[1] AS x, p[2] AS y FROM (SELECT round(p.x * 100)::BIGINT * 1000000000 + round(p.y * 100)::BIGINT AS ref, min((p.x, p.y)) AS p FROM (SELECT unnest(geometry) AS p FROM ways) GROUP BY 1)), k AS (SELECT way, CAST(len(geometry) AS INTEGER) AS nodes, round(geometry[1].x * 100)::BIGINT * 1000000000 + round(geometry[1].y * 100)::BIGINT AS f, round(geometry[-1].x * 100)::BIGINT * 1000000000 + round(geometry[-1].y * 100)::BIGINT AS l FROM ways WHERE highway IS NOT NULL) SELECT way, nodes, a.x AS x_first, b.y AS y_last FROM k JOIN nxy a ON a.ref = f JOIN nxy b ON b.ref = l",
    "a02_node_sets": "WITH sig AS (SELECT u AS node_id FROM links WHERE crossing = 'traffic_signals' AND u <> 0 UNION SELECT v FROM links WHERE crossing = 'traffic_signals' AND v <> 0), cro AS (SELECT u AS node_id FROM links WHERE crossing NOT IN ('', 'no', 'traffic_signals') AND u <> 0 UNION SELECT v FROM links WHERE crossing NOT IN ('', 'no', 'traffic_signals') AND v <> 0) SELECT 'signal' AS kind, node_id FROM sig UNION ALL SELECT 'crossing', node_id FROM cro WHERE node_id NOT IN (SELECT node_id FROM sig) UNION ALL SELECT DISTINCT 'light', u FROM links WHERE crossing = 'traffic_signals' AND u <> 0 AND highway IN ('trunk', 'trunk_link', 'primary', 'primary_link', 'secondary', 'secondary_link', 'tertiary', 'tertiary_link', 'unclassified', 'residential')",
    "b02_as_built": f"WITH {_WAYS} SELECT way, highway FROM ways WHERE site",
    "b03_clipped_ways": f"SELECT link_row AS way, CAST(len(geometry) AS INTEGER) AS nodes FROM links WHERE len(geometry) > 1 AND {_INBOX}",
    "a03_kept_ways": f"WITH {_WAYS} SELECT way, site AS under_construction FROM ways WHERE {_KEEP} AND {_INBOX}",
    "a05_extracted_links": f"WITH {_XTR} SELECT x.link_id, x.way, x.u, x.v, any_value(k.highway) AS highway, any_value(k.surface) AS surface, any_value(k.oneway_bicycle) AS oneway_bicycle, any_value(k.site) AS under_construction, round(sum(st.len), 4) AS length_m FROM xl x JOIN kw k USING (way) JOIN st ON st.way = x.way AND st.pos > x.a AND st.pos <= x.b GROUP BY 1, 2, 3, 4",
    "b04_links_in_polygon": f"WITH pts AS (SELECT link_row AS centroid_id, geometry[1].x AS x, geometry[1].y AS y FROM links WHERE len(geometry) > 1), {_IN.strip()}, seg AS {_SEG('links', 'link_row', 't')}, re AS (SELECT municipality_id, ax AS lax, ay AS lay, bx AS lbx, edges.by AS lby FROM edges), hit AS (SELECT DISTINCT municipality_id, link_row FROM seg JOIN re ON least(lax, lbx) <= greatest(tax, tbx) AND least(tax, tbx) <= greatest(lax, lbx) AND least(lay, lby) <= greatest(tay, tby) AND least(tay, tby) <= greatest(lay, lby) AND {_SIDE('la', 'lb', 'ta')} * {_SIDE('la', 'lb', 'tb')} <= 0 AND {_SIDE('ta', 'tb', 'la')} * {_SIDE('ta', 'tb', 'lb')} <= 0 UNION SELECT min(municipality_id), centroid_id FROM inside GROUP BY centroid_id) SELECT municipality_id, link_row, row_number() OVER (ORDER BY municipality_id, link_row) - 1 AS link_id FROM hit",
    "c07_resolved_ends": f"WITH RECURSIVE {_LOOSE} SELECT link_row, max(node) FILTER (side = 0) AS u, max(node) FILTER (side = 1) AS v FROM res GROUP BY 1 HAVING link_row IN (SELECT link_row FROM ends WHERE node = 0)",
    "i25_island_connectors": f"WITH RECURSIVE {_FOREST} SELECT u, v, round(gap_m, 3) AS gap_m FROM forest",
    "i25_connector_layer": f"WITH RECURSIVE {_FOREST} SELECT CASE WHEN gap_m < 50 THEN 'gap' ELSE 'island' END AS kind, count(*) AS connectors, round(sum(gap_m), 2) AS metres, count(*) FILTER (gap_m >= 50) AS with_speed FROM forest GROUP BY 1",
    "b35_island_ids": f"WITH RECURSIVE {_FOREST} SELECT -n AS link_id FROM (SELECT row_number() OVER (ORDER BY gap_m, u, v) AS n, gap_m FROM forest) WHERE gap_m >= 50",
    "g02_merged_layer": f"WITH RECURSIVE {_FOREST} SELECT 'link' AS kind, count(*) AS links, count(surface) AS with_surface, 0::BIGINT AS with_parts FROM norm UNION ALL SELECT CASE WHEN gap_m < 50 THEN 'gap' ELSE 'island' END, count(*), 0, count(*) FROM forest GROUP BY 1",
    "b07_annotated": f"WITH {_priced_sql(sp.WALK)} SELECT link_row, round(speed, 6) AS speed_kmh, round(secs, 6) AS travel_time_s, CAST(NULL AS DOUBLE) AS speed_override_kmh FROM priced",
    "c22_refused_clash": "SELECT link_id FROM links WHERE false",
    "b36_exported_edges": f"WITH {_RUN} SELECT link_id, CAST(direction AS INTEGER) AS direction, round(volume, 4) AS volume FROM rv WHERE volume > 0 AND link_id NOT IN (SELECT link_id FROM links WHERE highway = 'primary' AND link_id IS NOT NULL)",
    "a24_edge_layer": f"WITH {_RUN} SELECT rv.link_id, CAST(direction AS INTEGER) AS direction, CAST(len(geometry) AS INTEGER) AS vertices FROM rv JOIN norm USING (link_id) WHERE volume > 0",
    "c24_edge_rows": f"WITH {net_sql(sp.BIKE)} SELECT u, v, link_id, coalesce((SELECT min(link_row) FROM links l WHERE l.link_id = n.link_id), -1) AS link_row FROM net n",
    "f09_edge_order": f"WITH {net_sql(sp.BIKE)} SELECT u, v, link_id, CAST(direction AS INTEGER) AS direction, row_number() OVER (ORDER BY u, v, link_id, direction) AS position FROM net",
    "a33_run_on_links": f"WITH {_PLACED} SELECT link_row, round(forward, 4) AS forward, round(reverse, 4) AS reverse, round(forward_time, 4) AS forward_time FROM pl WHERE forward > 0 OR reverse > 0",
    "a33_old_run_on_links": f"WITH {_OLD} SELECT link_row, round(forward, 4) AS forward, round(reverse, 4) AS reverse FROM pl WHERE forward > 0 OR reverse > 0",
    "b34_run_measure": f"WITH {_PLACED} SELECT link_row, round(forward + reverse, 4) AS value FROM pl",
    "d22_assignment_summary": f"WITH {_RUN} SELECT count(*) AS edges, count(*) FILTER (volume > 0) AS loaded_edges, round(count(*) FILTER (volume > 0) / count(*), 6) AS loaded_fraction, round(sum(volume), 2) AS total_volume, max(volume) AS max_volume, quantile_cont(volume, 0.5) FILTER (volume > 0) AS median_loaded_volume FROM rv",
    "d43_volume_compare": f"WITH {_RUN}, c AS (SELECT rv.*, CASE WHEN highway = 'primary' THEN volume / 2 ELSE volume END AS other FROM rv JOIN norm USING (link_id)) SELECT round(sum(volume), 4) AS total_volume, round(sum(abs(volume - other)), 4) AS total_abs_diff, round(sum(abs(volume - other)) / sum(volume), 6) AS relative_abs_diff, count(*) FILTER (abs(volume - other) > 1e-6) AS edges_differing FROM c",
    "d33_mode_share": f"WITH pts AS (SELECT centroid_id, p[1] AS x, p[2] AS y FROM (SELECT centroid_id, min((x, y)) AS p FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), {_IN.strip()}, zm AS (SELECT centroid_id AS origin, min(municipality_id) AS municipality_id FROM inside GROUP BY 1), t AS (SELECT DISTINCT trip_id, origin, demand, length_m FROM trip_lengths WHERE demand > 0 AND NOT isnan(demand)), j AS (SELECT municipality_id, demand, CASE WHEN length_m < 3000 THEN demand ELSE 0 END AS mine FROM t JOIN zm USING (origin)) SELECT municipality_id, round(sum(mine), 5) AS mode_trips, round(sum(demand), 5) AS all_trips, round(sum(mine) / sum(demand), 6) AS mode_share FROM j GROUP BY ROLLUP (municipality_id)",
    "c26_line_volumes": f"WITH a AS {_SEG('count_lines', 'line_id', 'l')}, b AS {_SEG('links', 'link_row', 't')}, hit AS (SELECT DISTINCT line_id, link_row FROM a JOIN b ON least(lax, lbx) <= greatest(tax, tbx) AND least(tax, tbx) <= greatest(lax, lbx) AND least(lay, lby) <= greatest(tay, tby) AND least(tay, tby) <= greatest(lay, lby) AND {_SIDE('la', 'lb', 'ta')} * {_SIDE('la', 'lb', 'tb')} <= 0 AND {_SIDE('ta', 'tb', 'la')} * {_SIDE('ta', 'tb', 'lb')} <= 0) SELECT line_id, count(*) AS links, round(coalesce(sum(CASE WHEN NOT isnan(car_volume) THEN car_volume END), 0), 4) AS cars FROM hit JOIN links USING (link_row) GROUP BY 1",
    "b15_carriageway_divisor": "SELECT highway, round(greatest((beta + 2.61 * 1.927) / 7.57, 1.0), 8) AS divisor FROM (SELECT DISTINCT highway, CASE highway " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sp.ROAD_BETA.items()) + f" END AS beta FROM links WHERE highway IN {_in(sp.ROAD_BETA)})",
    "g07_no_demand_classes": "SELECT unnest([" + ", ".join(f"'{h}'" for h in (*sp.PATHS, "connector", "crossing_entry")) + "]) AS highway EXCEPT ALL SELECT 'pedestrian'",
    "h23_profile_places": f"WITH {_NORM}, n AS (SELECT link_row, length_m, greatest(CAST(ceil(length_m / 25) AS INTEGER) + 1, 2) AS n FROM norm) SELECT link_row, CAST(k AS INTEGER) AS i, round(length_m * k / (n - 1), 4) AS at_m FROM n, LATERAL (SELECT unnest(range(0, n)) AS k)",
}
