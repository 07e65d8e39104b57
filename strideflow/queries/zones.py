"""Queries of zones, their access points, matrices and demand, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.plans import graph as G
from strideflow.plans import zones as Z
from strideflow.plans.demand import DISC_MEAN, od_demand, trips
from strideflow.plans.lineage import cut
from strideflow.queries.data import _IN
from strideflow.queries.links import _NORM, net_sql
from strideflow.queries.network import LIMIT, NEAR, _cell_points, _DIST, _net, _weighted_nodes, _WN, _ZP
from strideflow.queries.signals import _xy
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)
#: Access points of a zone at most; metres from a point to its node at most; the bike's base speed.
K, SNAP, SPEED = 8, 500.0, sp.BIKE.base / 3.6


def _polygons(s, d):
    return read_table(s, d, "municipality_polygons", ["polygon_id", "municipality_id", "rings"])


def a12_dissolved_zones(s, d):
    """Municipalities of all their polygons, in the order in which they appear."""
    return Z.dissolved(_polygons(s, d), "municipality_id", "polygon_id").select("zone", F.size("parts").alias("polygons"), R("area_m2", 0).alias("area_m2"), "position")


def h24_inner_points(s, d):
    """A point inside every municipality."""
    return Z.inner_points(_polygons(s, d), "municipality_id").select("zone", R("x", 3).alias("x"), R("y", 3).alias("y"))


def _candidates(s, d):
    """Nodes with the street length at them, by municipality."""
    n = cut(_weighted_nodes(s, d).select(F.col("node_id").alias("id"), "x", "y", F.col("w").alias("weight")))
    return n


def _zone_of(s, d):
    from strideflow.operators.nearness import regions_of_points

    n = _candidates(s, d)
    z = regions_of_points(n, "id", _polygons(s, d), "municipality_id").select("id", F.col("region").alias("zone"))
    return n.join(z, "id").select("zone", "x", "y", "weight")


def d12_fitted_cells(s, d):
    """The side of the finest grid with at most eight occupied cells, of municipalities with more nodes."""
    return Z.fitted_cells(cut(_zone_of(s, d)), K).select("zone", R("cell", 6).alias("cell_m"))


def _placed(s, d):
    """Access points from the nodes in municipalities; where a municipality has none, from the centroids, else from within it."""
    other = read_table(s, d, "centroids", ["centroid_id", "x", "y"]).where("x is not null and y is not null").groupBy(F.col("centroid_id").alias("id")).agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y", F.lit(1.0).alias("weight"))
    return Z.placed_points(_polygons(s, d), "municipality_id", _candidates(s, d), other, K)


def d13_placed_points(s, d):
    return _placed(s, d).select("zone", R("x", 2).alias("x"), R("y", 2).alias("y"), R("weight", 8).alias("weight"), R("moment", 0).alias("moment"), "source")


def _access(s, d):
    net = _net(s, d)
    used = net.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return cut(Z.snapped_points(_placed(s, d), _xy(s, d).join(used, "node_id"), 5000.0, SPEED))


def d14_merged_points(s, d):
    """The points at their nearest nodes, those of a zone at one node merged."""
    return _access(s, d).select("zone", "node_id", R("weight", 8).alias("weight"), R("access_m", 2).alias("access_m"), R("x", 2).alias("x"), R("y", 2).alias("y"))


def a43_zone_points(s, d):
    """One row per access point, with its cell's radius."""
    return _access(s, d).select("zone", "node_id", R("weight", 8).alias("weight"), R("access_s", 3).alias("access_s"), R("cell_radius_m", 1).alias("cell_radius_m"))


def d23_zone_summary(s, d):
    z = Z.zone_summary(_access(s, d))
    return z.select("zones", "access_points", R("points_per_zone_mean", 6).alias("points_per_zone_mean"), "points_per_zone_max", R("access_seconds_median", 3).alias("access_seconds_median"), R("access_seconds_max", 3).alias("access_seconds_max"))


def e12_zone_chunks(s, d):
    """Runs of whole cells with at most a hundred nodes."""
    return Z.chunked(_cell_points(s, d).groupBy("zone").count(), "zone", 100)


def e13_source_chunks(s, d):
    """Runs of whole volume lines with at most a thousand vertices."""
    t = read_table(s, d, "volumes", ["source_row", "geometry"]).where("size(geometry) > 0")
    return Z.chunked(t.select("source_row", F.size("geometry").alias("count")), "source_row", 1000)


def _cell_access(s, d):
    """The nodes of 1.5 km cells as access points; a node with 100 m of street and more stands for a disc of as many square metres."""
    w = _weighted_nodes(s, d).select("node_id", "w")
    radius = F.when(F.col("w") >= 100, F.sqrt(F.col("w") / F.pi())).otherwise(0.0)
    return cut(_cell_points(s, d).join(w, "node_id").select("zone", "node_id", "weight", "access_s", F.lit(20.0).alias("access_m"), radius.alias("cell_radius_m")))


def i08_priced_matrix(s, d):
    """Mean seconds and metres between cells, with what a trip within a node's disc takes on the diagonal."""
    m = Z.priced_matrix(_net(s, d), _cell_access(s, d), LIMIT, SPEED)
    return m.select("origin", "destination", R("seconds", 3).alias("seconds"), R("metres", 3).alias("metres"), R("fraction", 6).alias("fraction"))


def i07_logsum_matrix(s, d):
    """The same as a logsum, where half of the weight is reached."""
    m = Z.priced_matrix(_net(s, d), _cell_access(s, d), LIMIT, SPEED, 0.5, 0.01)
    return m.select("origin", "destination", R("seconds", 3).alias("seconds"))


def i05_unbounded_matrix(s, d):
    """Mean seconds and metres between municipalities over their access points, however long the way."""
    p = _access(s, d)
    m = Z.priced_matrix(_net(s, d), p, float("inf"), SPEED)
    return m.select("origin", "destination", R("seconds", 2).alias("seconds"), R("metres", 1).alias("metres"), R("fraction", 6).alias("fraction"))


def j07_legs_added(s, d):
    """Seconds between the cells' heaviest nodes within two minutes, with access legs of half a minute and a second for each node of the cell."""
    p = cut(_cell_points(s, d))
    rep = cut(p.groupBy("zone").agg(F.min(F.struct(-F.round("weight", 12), "node_id")).alias("m"), F.count("*").alias("n")).select("zone", F.col("m.node_id").alias("node_id"), (F.lit(30.0) + F.col("n")).alias("access_s")))
    m = G.od_matrix(_net(s, d), rep.select("node_id"), LIMIT)
    far = m.join(rep.select(F.col("node_id").alias("origin"), F.col("zone").alias("oz")), "origin").join(rep.select(F.col("node_id").alias("destination"), F.col("zone").alias("dz")), "destination").where("oz <> dz").select(F.col("oz").alias("origin"), F.col("dz").alias("destination"), "seconds")
    return Z.with_legs(far, rep).select("origin", "destination", R("seconds").alias("seconds"))


def _cell_demand(s, d):
    """Ten trips between every two cells within reach, and thirty within each."""
    p = _cell_points(s, d)
    z = G.zone_matrix(_net(s, d), cut(p), LIMIT).where("origin <> destination").select("origin", "destination", F.lit(10.0).alias("demand"))
    return z.unionByName(p.select(F.col("zone").alias("origin"), F.col("zone").alias("destination"), F.lit(30.0).alias("demand")).distinct())


def i15_expanded_demand(s, d):
    """The cells' demand by the node that it begins at, between cells."""
    x = Z.expanded(_cell_demand(s, d), _cell_access(s, d)).where("kind = 'pair' and o_zone <> d_zone")
    return x.groupBy("origin").agg(F.count("*").alias("pairs"), R(F.sum("demand"), 6).alias("demand"))


def i16_intrazonal_demand(s, d):
    """What becomes of the demand within each cell: between different nodes, within a node's disc, or nowhere."""
    x = Z.expanded(_cell_demand(s, d), _cell_access(s, d)).where("o_zone = d_zone")
    return x.groupBy(F.col("o_zone").alias("zone"), "kind").agg(R(F.sum("demand"), 6).alias("demand"))


def i14_conserved_demand(s, d):
    """Where the cells' demand went when it was assigned within one minute by nodes and within two by the heaviest ones: all of it is in one of these."""
    out = Z.assign_zones(_net(s, d), _cell_demand(s, d), _cell_access(s, d), LIMIT / 2, LIMIT)
    return out.where("kind <> 'volume'").groupBy("kind").agg(R(F.sum("value"), 4).alias("demand"))


def i14_zone_volumes_of_trips(s, d):
    """Volumes of the trips' demand between municipalities over their access points: a quarter of an hour point by point, the rest between the heaviest ones without limit."""
    from strideflow.queries.demand import _zone_municipality

    z = cut(_zone_municipality(s, d))
    od = od_demand(trips(s, d)).join(z.withColumnRenamed("municipality_id", "oz"), "origin").join(z.select(F.col("origin").alias("destination"), F.col("municipality_id").alias("dz")), "destination").select(F.col("oz").alias("origin"), F.col("dz").alias("destination"), "demand")
    out = Z.assign_zones(_net(s, d), od, _access(s, d), NEAR, float("inf"))
    return out.groupBy("kind", "link_id", "direction", "u", "v").agg(R(F.sum("value"), 3).alias("value"))


_POLY = "poly AS (SELECT municipality_id AS zone, polygon_id, rings FROM municipality_polygons WHERE municipality_id IS NOT NULL), vert AS (SELECT zone, polygon_id, p.y AS y FROM (SELECT zone, polygon_id, unnest(r) AS p FROM (SELECT zone, polygon_id, unnest(rings) AS r FROM poly))), lev0 AS (SELECT zone, polygon_id, (min(y) + max(y)) / 2 AS mid FROM vert GROUP BY 1, 2), lev AS (SELECT zone, polygon_id, (max(y) FILTER (y <= mid) + min(y) FILTER (y > mid)) / 2 AS level FROM vert JOIN lev0 USING (zone, polygon_id) GROUP BY 1, 2), side AS (SELECT zone, polygon_id, r[i].x AS ax, r[i].y AS ay, r[i + 1].x AS bx, r[i + 1].y AS by_ FROM (SELECT zone, polygon_id, unnest(rings) AS r FROM poly), LATERAL (SELECT unnest(range(1, len(r))) AS i)), cross_ AS (SELECT zone, polygon_id, level, ax + (level - ay) * (bx - ax) / (by_ - ay) AS x, row_number() OVER (PARTITION BY zone, polygon_id ORDER BY ax + (level - ay) * (bx - ax) / (by_ - ay)) AS n FROM side JOIN lev USING (zone, polygon_id) WHERE (ay > level) <> (by_ > level)), str AS (SELECT a.zone, max((b.x - a.x, -a.x, a.level)) AS m FROM cross_ a JOIN cross_ b ON a.zone = b.zone AND a.polygon_id = b.polygon_id AND b.n = a.n + 1 WHERE a.n % 2 = 1 GROUP BY 1), inner_ AS (SELECT zone, -m[2] + m[1] / 2 AS x, m[3] AS y FROM str)"
_CAND = f"{_WN}, cand AS (SELECT zone, x, y, w AS weight, 'street' AS source FROM pts JOIN zo USING (centroid_id))"
_INC = _IN.strip().replace("edges AS", "edges2 AS").replace("JOIN edges e", "JOIN edges2 e").replace("inside AS", "inside2 AS").replace("FROM pts c", "FROM cpts c")
_CAND2 = f"{_CAND.replace('cand AS', 'cand0 AS')}, cpts AS (SELECT centroid_id, p[1] AS x, p[2] AS y FROM (SELECT centroid_id, min((x, y)) AS p FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)), {_INC}, zo2 AS (SELECT centroid_id, min(municipality_id) AS zone FROM inside2 GROUP BY 1), cand AS (SELECT * FROM cand0 UNION ALL SELECT zone, x, y, 1.0, 'node' FROM cpts JOIN zo2 USING (centroid_id) WHERE zone NOT IN (SELECT zone FROM cand0))"
_FITTED = f"""box AS (SELECT zone, count(*) AS n, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM cand GROUP BY 1), big AS (SELECT * FROM box WHERE n > {K} AND span > 0),
grow(zone, step, cell, occ) AS (SELECT b.zone, 0, b.span / sqrt({K}.0), (SELECT count(*) FROM (SELECT DISTINCT floor((c.x - b.x0) / (b.span / sqrt({K}.0))), floor((c.y - b.y0) / (b.span / sqrt({K}.0))) FROM cand c WHERE c.zone = b.zone)) FROM big b UNION ALL SELECT g.zone, any_value(step) + 1, any_value(g.cell) * {Z.GROW}, count(DISTINCT (floor((c.x - b.x0) / (g.cell * {Z.GROW})), floor((c.y - b.y0) / (g.cell * {Z.GROW})))) FROM grow g JOIN big b USING (zone) JOIN cand c USING (zone) WHERE occ > {K} AND step < 63 GROUP BY g.zone),
fit(zone, step, lo, hi, done) AS (SELECT zone, 0, 0.0::DOUBLE, cell, false FROM grow WHERE occ <= {K} UNION ALL SELECT zone, step + 1, CASE WHEN occ <= {K} THEN lo ELSE mid END, CASE WHEN occ <= {K} THEN mid ELSE hi END, occ = {K} FROM (SELECT f.zone, any_value(step) AS step, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) * 0.5) AS mid, count(DISTINCT (floor((c.x - b.x0) / ((lo + hi) * 0.5)), floor((c.y - b.y0) / ((lo + hi) * 0.5)))) AS occ FROM fit f JOIN big b USING (zone) JOIN cand c USING (zone) WHERE NOT done AND step < {Z.BISECT_STEPS} GROUP BY f.zone)),
cell AS (SELECT zone, arg_max(hi, step) AS cell FROM fit GROUP BY 1)"""
_FIT = f"{_CAND}, {_FITTED}"
_PLACE = f"""{_CAND2}, {_FITTED}, {_POLY},
got AS (SELECT zone, x, y, weight, 0.0 AS moment, source FROM cand JOIN box USING (zone) WHERE n <= {K} UNION ALL SELECT zone, min(x0) + sum(weight * (x - x0)) / sum(weight), min(y0) + sum(weight * (y - y0)) / sum(weight), sum(weight), greatest(sum(weight * ((x - x0) ** 2 + (y - y0) ** 2)) / sum(weight) - (sum(weight * (x - x0)) / sum(weight)) ** 2 - (sum(weight * (y - y0)) / sum(weight)) ** 2, 0.0), any_value(source) FROM cand JOIN big USING (zone) JOIN cell USING (zone) GROUP BY zone, floor((x - x0) / cell), floor((y - y0) / cell) UNION ALL SELECT zone, x, y, 1.0, 0.0, 'point' FROM inner_ WHERE zone NOT IN (SELECT zone FROM cand)),
placed AS (SELECT zone, x, y, weight / sum(weight) OVER (PARTITION BY zone) AS weight, moment, source FROM got)"""
_SNAP = f"""{_PLACE}, {net_sql(sp.BIKE).replace(_NORM + ", ", "").replace("edges", "net_edges")}, pn AS (SELECT row_number() OVER (ORDER BY zone, x, y) AS p, * FROM placed), nn AS (SELECT node_id, x, y, CAST(floor(x / 5000) AS BIGINT) AS gx, CAST(floor(y / 5000) AS BIGINT) AS gy FROM xy WHERE node_id IN (SELECT u FROM net UNION SELECT v FROM net)),
sn AS (SELECT p, min((sqrt((a.x - n.x) ** 2 + (a.y - n.y) ** 2), n.node_id)) AS m FROM (SELECT *, CAST(floor(x / 5000) AS BIGINT) + dx AS gx, CAST(floor(y / 5000) AS BIGINT) + dy AS gy FROM pn, (VALUES (-1), (0), (1)) q(dx), (VALUES (-1), (0), (1)) r(dy)) a JOIN nn n USING (gx, gy) WHERE (a.x - n.x) ** 2 + (a.y - n.y) ** 2 <= 25000000 GROUP BY 1),
pj AS (SELECT zone, m[2] AS node_id, m[1] AS dist, weight / sum(weight) OVER (PARTITION BY zone) AS weight, x, y, moment FROM pn JOIN sn USING (p)), gm AS (SELECT zone, node_id, sum(weight) AS weight, sum(weight * dist) / sum(weight) AS access_m, sum(weight * x) / sum(weight) AS x, sum(weight * y) / sum(weight) AS y FROM pj GROUP BY 1, 2),
ap AS (SELECT g.*, sqrt(2 * r.moment) AS radius FROM gm g JOIN (SELECT p.zone, p.node_id, sum(p.weight * (p.moment + (p.x - g.x) ** 2 + (p.y - g.y) ** 2)) / sum(p.weight) AS moment FROM pj p JOIN gm g USING (zone, node_id) GROUP BY 1, 2) r USING (zone, node_id))"""
_CA = f"ca AS (SELECT zp.*, ww.w, CASE WHEN ww.w >= 100 THEN sqrt(ww.w / pi()) ELSE 0 END AS radius FROM zp JOIN ww USING (node_id)), insd AS (SELECT zone, sum(weight ** 2) FILTER (radius > 0) AS kept, coalesce(sum(weight ** 2) FILTER (radius = 0), 0) AS dropped, sum(weight ** 2 * (60 + {Z.DETOUR * DISC_MEAN} * radius / {SPEED})) FILTER (radius > 0) AS num, sum(weight ** 2 * (40 + {Z.DETOUR * DISC_MEAN} * radius)) FILTER (radius > 0) AS len, sum(weight ** 2 * exp(-0.01 * (60 + {Z.DETOUR * DISC_MEAN} * radius / {SPEED}))) FILTER (radius > 0) AS lg FROM ca GROUP BY 1)"
_FULL = f"{_DIST}, {_ZP}, {_CA}, pz AS (SELECT a.zone AS origin, b.zone AS destination, a.weight * b.weight AS w, d.d + 60 AS s, y.len + 40 AS m FROM dist d JOIN ways y ON y.src = d.src AND y.dest = d.node JOIN zp a ON a.node_id = d.src JOIN zp b ON b.node_id = d.node WHERE d.src <> d.node), al AS (SELECT origin, destination, sum(w) AS den, sum(w * s) AS num, sum(w * m) AS len, sum(w * exp(-0.01 * s)) AS lg FROM pz GROUP BY 1, 2 UNION ALL SELECT zone, zone, kept, num, len, lg FROM insd WHERE kept > 0), sm AS (SELECT origin, destination, sum(al.den) AS den, sum(al.num) AS num, sum(al.len) AS len, sum(al.lg) AS lg, any_value(CASE WHEN origin = destination THEN 1 - dropped ELSE 1 END) AS whole FROM al JOIN insd ON insd.zone = origin GROUP BY 1, 2)"
_GREEDY = lambda src, budget: f"WITH RECURSIVE c AS (SELECT k, n, row_number() OVER (ORDER BY k) AS i FROM ({src})), g(i, run, total) AS (SELECT i, 1, n FROM c WHERE i = 1 UNION ALL SELECT c.i, CASE WHEN g.total + c.n <= {budget} THEN g.run ELSE g.run + 1 END, CASE WHEN g.total + c.n <= {budget} THEN g.total + c.n ELSE c.n END FROM g JOIN c ON c.i = g.i + 1) SELECT min(k)::BIGINT AS first, max(k)::BIGINT AS last, sum(n)::BIGINT AS total FROM g JOIN c USING (i) GROUP BY run"
_EXP = f"{_DIST}, {_ZP}, {_CA}"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "a12_dissolved_zones": "WITH r AS (SELECT polygon_id, municipality_id, unnest(rings) AS r, unnest(range(1, len(rings) + 1)) AS k FROM municipality_polygons), a AS (SELECT polygon_id, municipality_id, sum(CASE WHEN k = 1 THEN 1 ELSE -1 END * area) AS area FROM (SELECT polygon_id, municipality_id, k, abs(list_sum(list_transform(range(1, len(r)), lambda i: r[i].x * r[i + 1].y - r[i + 1].x * r[i].y))) / 2 AS area FROM r) GROUP BY 1, 2) SELECT municipality_id AS zone, CAST(count(*) AS INTEGER) AS polygons, round(sum(area), 0) AS area_m2, row_number() OVER (ORDER BY min(polygon_id)) - 1 AS position FROM a WHERE municipality_id IS NOT NULL GROUP BY 1",
    "h24_inner_points": f"WITH {_POLY} SELECT zone, round(x, 3) AS x, round(y, 3) AS y FROM inner_",
    "d12_fitted_cells": f"WITH RECURSIVE {_FIT} SELECT zone, round(cell, 6) AS cell_m FROM cell",
    "d13_placed_points": f"WITH RECURSIVE {_PLACE} SELECT zone, round(x, 2) AS x, round(y, 2) AS y, round(weight, 8) AS weight, abs(round(moment, 0)) AS moment, source FROM placed",
    "d14_merged_points": f"WITH RECURSIVE {_SNAP} SELECT zone, node_id, round(weight, 8) AS weight, round(access_m, 2) AS access_m, round(x, 2) AS x, round(y, 2) AS y FROM ap",
    "a43_zone_points": f"WITH RECURSIVE {_SNAP} SELECT zone, node_id, round(weight, 8) AS weight, round(access_m / {SPEED}, 3) AS access_s, round(radius, 1) AS cell_radius_m FROM ap",
    "d23_zone_summary": f"WITH RECURSIVE {_SNAP} SELECT count(DISTINCT zone) AS zones, count(*) AS access_points, round(count(*) / count(DISTINCT zone), 6) AS points_per_zone_mean, (SELECT max(c) FROM (SELECT count(*) AS c FROM ap GROUP BY zone)) AS points_per_zone_max, round(quantile_cont(access_m / {SPEED}, 0.5), 3) AS access_seconds_median, round(max(access_m / {SPEED}), 3) AS access_seconds_max FROM ap",
    "e12_zone_chunks": _GREEDY("SELECT CAST(floor(x / 1500) * 100000 + floor(y / 1500) AS BIGINT) AS k, count(*) AS n FROM (SELECT node_id FROM (SELECT u AS node_id FROM links WHERE len(geometry) > 1 AND u IS NOT NULL AND v IS NOT NULL AND u <> v UNION SELECT v FROM links WHERE len(geometry) > 1 AND u IS NOT NULL AND v IS NOT NULL AND u <> v) WHERE node_id <> 0) JOIN (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)) USING (node_id) GROUP BY 1", 100),
    "e13_source_chunks": _GREEDY("SELECT source_row AS k, len(geometry) AS n FROM volumes WHERE len(geometry) > 0", 1000),
    "i08_priced_matrix": f"WITH RECURSIVE {_FULL} SELECT origin, destination, round(num / den, 3) AS seconds, round(len / den, 3) AS metres, round(den / whole, 6) AS fraction FROM sm WHERE den > 0 AND whole > 0",
    "i07_logsum_matrix": f"WITH RECURSIVE {_FULL} SELECT origin, destination, round(-ln(lg / den) / 0.01, 3) AS seconds FROM sm WHERE den > 0 AND whole > 0 AND den / whole >= 0.5 - 1e-9",
    "j07_legs_added": f"WITH RECURSIVE {_DIST}, {_ZP}, rep AS (SELECT zone, min((-round(weight, 12), node_id))[2] AS node_id, 30.0 + count(*) AS leg FROM zp GROUP BY 1) SELECT a.zone AS origin, b.zone AS destination, CAST(round(d + a.leg + b.leg, 4) AS DOUBLE) AS seconds FROM dist JOIN rep a ON a.node_id = src JOIN rep b ON b.node_id = dist.node WHERE a.zone <> b.zone",
    "i15_expanded_demand": f"WITH RECURSIVE {_EXP} SELECT p.node_id AS origin, sum(q.n)::BIGINT AS pairs, round(sum(10.0 * p.weight), 6) AS demand FROM zs JOIN zp p ON p.zone = origin JOIN (SELECT zone, count(*) AS n FROM zp GROUP BY 1) q ON q.zone = destination WHERE origin <> destination GROUP BY 1",
    "i16_intrazonal_demand": f"WITH RECURSIVE {_EXP}, t AS (SELECT zone, coalesce(kept, 0) AS kept, dropped, 1 - coalesce(kept, 0) - dropped AS other FROM insd) SELECT zone, 'pair' AS kind, round(30 * sum(a.weight * b.weight) / (1 - any_value(dropped)), 6) AS demand FROM t JOIN ca a USING (zone) JOIN ca b USING (zone) WHERE 1 - dropped > 1e-12 AND a.node_id <> b.node_id GROUP BY 1 UNION ALL SELECT zone, 'within', round(30 * kept / (1 - dropped), 6) FROM t WHERE 1 - dropped > 1e-12 AND kept > 0 UNION ALL SELECT zone, 'unplaced', 30.0 FROM t WHERE 1 - dropped <= 1e-12",
}
