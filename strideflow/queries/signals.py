"""Queries of signalled junctions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.operators.nearness import nearest_within
from strideflow.plans import links as L
from strideflow.plans import signals as S
from strideflow.plans.lineage import cut
from strideflow.queries.links import _case, _in
from strideflow.sources.tables import read_table

R = lambda c, n=4: F.round(c, n)


def _xy(s, d):
    """Each node once, at the smallest of its positions."""
    return read_table(s, d, "nodes", ["node_id", "x", "y"]).where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y")


def _tables(s, d):
    """Links, nodes, signalled nodes, road lights and unsignalled crossings: a tag of a link stands for its ends."""
    t = read_table(s, d, "links", ["link_row", "link_id", "u", "v", "highway", "crossing"])
    ends = lambda df, *c: df.select(F.explode(F.array(*c)).alias("node_id")).where("node_id is not null and node_id <> 0").distinct()
    lit = t.where("crossing = 'traffic_signals'")
    plain = t.where("crossing is not null and crossing not in ('', 'no', 'traffic_signals')")
    return t, _xy(s, d), ends(lit, "u", "v"), ends(lit.where(F.col("highway").isin(*S.JUNCTION_ROADS)), "u"), ends(plain, "u", "v")


def _laid(s, d):
    t, *rest = _tables(s, d)
    return t, cut(S.layout(t, *rest))


def c18_junction_of_ends(s, d):
    """The nearest signalled node within 30 m of every link's end, and the distance."""
    t, xy, signals, _, _ = _tables(s, d)
    ends = t.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    near = nearest_within(xy.join(ends, "node_id"), "node_id", xy.join(signals, "node_id"), "node_id", S.RADIUS_M)
    return near.select(F.col("id").alias("node_id"), F.col("target_id").alias("signal"), R("distance").alias("distance_m"))


def i26_junctions(s, d):
    """Signalled nodes with the junction that they make up."""
    t, xy, signals, lights, _ = _tables(s, d)
    return S.junctions(t, xy, signals, lights)


def i26_layout(s, d):
    """Link ends inside junctions, the junction's code, and whether one of its roads ends there."""
    return _laid(s, d)[1].where("junction is not null").select("node_id", "junction", "code", "is_signal", "is_crossing", "on_road")


def i27_signal_codes(s, d):
    """The codes that links pay at signals, by direction; links that pay nothing are left out."""
    t, lay = _laid(s, d)
    c = S.signal_codes(t, lay)
    return c.where("signal_entry + signal_entry_reverse + signal_cross_start + signal_cross_end > 0")


def i28_split_crossings(s, d):
    """Links whose ends moved to a twin, with their new ends."""
    t, lay = _laid(s, d)
    moved, _ = S.split_crossings(t, lay)
    old = t.select("link_row", F.col("u").alias("old_u"), F.col("v").alias("old_v"))
    return moved.join(old, "link_row").where("u <> old_u or v <> old_v").select("link_row", "u", "v")


def g03_entry_connectors(s, d):
    """The links together with the connectors of split crossings, which are numbered on from the largest row; what a connector lacks is NULL."""
    t, lay = _laid(s, d)
    moved, con = S.split_crossings(t, lay)
    top = t.agg(F.max("link_row").alias("top"))
    rows = con.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("u")).alias("link_row"), F.lit(-1).cast("bigint").alias("osm_way_id"), "u", "v", "highway")
    return moved.select("link_row", F.lit(None).cast("bigint").alias("osm_way_id"), "u", "v", "highway").unionByName(rows).where(F.col("highway") == S.ENTRY).select("u", "v", "highway", "osm_way_id")


def g04_split_points(s, d):
    """Signalled nodes and unsignalled crossings together: where ways are split."""
    _, _, signals, _, crossings = _tables(s, d)
    return signals.unionByName(crossings).distinct()


def i29_edge_waits(s, d):
    """Seconds that each directed edge waits at signals: in its direction of travel."""
    t, lay = _laid(s, d)
    c = S.signal_codes(t, lay)
    links = L.with_defaults(read_table(s, d, "links")).drop("signal_entry", "signal_entry_reverse", "signal_cross_start", "signal_cross_end").join(c, "link_row", "left")
    way = F.explode(sp.directions("bike", F.col("oneway"), F.col("oneway_bicycle"), F.col("junction"))).alias("direction")
    w = links.select("link_row", "signal_entry", "signal_entry_reverse", "signal_cross_start", "signal_cross_end", way)
    wait = F.when(F.col("direction") > 0, sp.signal_wait(F.col("signal_entry")) + sp.signal_wait(F.col("signal_cross_end"))).otherwise(sp.signal_wait(F.col("signal_entry_reverse")) + sp.signal_wait(F.col("signal_cross_start")))
    return w.select("link_row", F.col("direction").cast("int").alias("direction"), wait.alias("wait_s")).where("wait_s > 0")


_ROADS, _P = _in(S.JUNCTION_ROADS), _in(sp.PATHS)
_LAY = f"""lk AS (SELECT link_row, u, v, highway, crossing FROM links WHERE u IS NOT NULL AND v IS NOT NULL AND u <> 0 AND v <> 0),
ends AS (SELECT u AS node_id, highway FROM lk UNION ALL SELECT v, highway FROM lk),
xy AS (SELECT node_id, p[1] AS x, p[2] AS y FROM (SELECT node_id, min((x, y)) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY 1)),
sig AS (SELECT u AS node_id FROM links WHERE crossing = 'traffic_signals' AND u <> 0 UNION SELECT v FROM links WHERE crossing = 'traffic_signals' AND v <> 0),
light AS (SELECT DISTINCT u AS node_id FROM links WHERE crossing = 'traffic_signals' AND u <> 0 AND highway IN {_ROADS}),
cro AS (SELECT u AS node_id FROM links WHERE crossing NOT IN ('', 'no', 'traffic_signals') AND u <> 0 UNION SELECT v FROM links WHERE crossing NOT IN ('', 'no', 'traffic_signals') AND v <> 0),
sx AS (SELECT node_id, x, y FROM sig JOIN xy USING (node_id) WHERE node_id IN (SELECT node_id FROM ends)),
near AS (SELECT a.node_id AS a, b.node_id AS b FROM sx a JOIN sx b ON abs(a.x - b.x) <= 30 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 900),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
lab AS (SELECT a AS node_id, min(b) AS junction FROM reach GROUP BY 1),
cells AS (SELECT node_id, x, y, CAST(floor(x / 30) AS BIGINT) + dx AS jx, CAST(floor(y / 30) AS BIGINT) + dy AS jy FROM xy, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
ns AS (SELECT c.node_id, min((sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), s.node_id)) AS m FROM cells c JOIN (SELECT *, CAST(floor(x / 30) AS BIGINT) AS jx, CAST(floor(y / 30) AS BIGINT) AS jy FROM sig JOIN xy USING (node_id)) s ON c.jx = s.jx AND c.jy = s.jy WHERE (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 900 GROUP BY 1)"""
_LAY2 = f"""{_LAY}, deg AS (SELECT node_id, count(*) AS roads FROM ends WHERE NOT coalesce(highway IN {_P}, false) GROUP BY 1),
ne AS (SELECT n.node_id, min((sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2), s.node_id)) AS m FROM cells n JOIN (SELECT *, CAST(floor(x / 30) AS BIGINT) AS jx, CAST(floor(y / 30) AS BIGINT) AS jy FROM sx) s ON n.jx = s.jx AND n.jy = s.jy WHERE (n.x - s.x) ** 2 + (n.y - s.y) ** 2 <= 900 AND n.node_id IN (SELECT node_id FROM ends) GROUP BY 1),
kind AS (SELECT junction, NOT bool_or(l.node_id IN (SELECT node_id FROM light)) AND max(coalesce(roads, 0)) <= 2 AS midblock FROM lab l LEFT JOIN deg USING (node_id) GROUP BY 1),
ins AS (SELECT ne.node_id, l.junction, midblock FROM ne JOIN lab l ON l.node_id = ne.m[2] JOIN kind USING (junction) WHERE NOT midblock OR ne.node_id IN (SELECT node_id FROM sig)),
onr AS (SELECT node_id, junction, {_case({h: {8: 0, 7: 1, 6: 2, 5: 3}[c] for h, c in S.JUNCTION_ROADS.items()}, 'highway')} AS rank FROM ends JOIN ins USING (node_id) WHERE highway IN {_ROADS}),
big AS (SELECT junction, max(rank) AS rank FROM onr GROUP BY 1),
lay AS (SELECT n.node_id, junction, CAST(CASE WHEN junction IS NULL THEN NULL WHEN midblock THEN 3 ELSE 8 - coalesce(rank, 0) END AS INTEGER) AS code, n.node_id IN (SELECT node_id FROM sig) AS is_signal, n.node_id IN (SELECT node_id FROM sig) OR n.node_id IN (SELECT node_id FROM cro) AS is_crossing, n.node_id IN (SELECT node_id FROM onr) AS on_road FROM (SELECT DISTINCT node_id FROM ends) n LEFT JOIN ins USING (node_id) LEFT JOIN big USING (junction)),
info AS (SELECT *, is_signal OR (on_road AND NOT is_crossing) AS paid FROM lay)"""
_ENTER = lambda t, f: f"CASE WHEN (road AND {t}.junction IS NOT NULL AND NOT coalesce({t}.junction = {f}.junction, false)) OR (NOT road AND {t}.junction IS NOT NULL AND {t}.on_road AND NOT (path AND {t}.is_crossing) AND NOT ({f}.paid AND coalesce({t}.junction = {f}.junction, false))) THEN {t}.code ELSE 0 END"
_STEP = lambda t, f: f"CASE WHEN path AND {t}.is_signal AND NOT ({f}.paid AND {t}.junction IS NOT DISTINCT FROM {f}.junction) THEN coalesce({t}.code, 0) ELSE 0 END"
_CODES = f"""{_LAY2}, codes AS (SELECT link_row, {_ENTER('b', 'a')} AS signal_entry, {_ENTER('a', 'b')} AS signal_entry_reverse, {_STEP('a', 'b')} AS signal_cross_start, {_STEP('b', 'a')} AS signal_cross_end FROM (SELECT *, coalesce(highway IN {_ROADS}, false) AS road, coalesce(highway IN {_P}, false) AS path FROM lk) JOIN info a ON a.node_id = u JOIN info b ON b.node_id = v)"""
_TWINS = f"""{_LAY2}, twins AS (SELECT node_id, (SELECT least(min(node_id), 0) FROM lay) - row_number() OVER (ORDER BY node_id) AS twin FROM lay WHERE is_crossing AND NOT is_signal AND on_road AND node_id IN (SELECT node_id FROM ends WHERE highway IN {_P}))"""
_WAIT = lambda c: f"coalesce([{', '.join(str(w) for w in sp.SIGNAL_WAITS)}][{c} + 1]::DOUBLE, 0)"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[1:3].isdigit()}
SQL = {
    "c18_junction_of_ends": f"WITH RECURSIVE {_LAY} SELECT node_id, m[2] AS signal, round(m[1], 4) AS distance_m FROM ns WHERE node_id IN (SELECT u FROM links UNION SELECT v FROM links)",
    "i26_junctions": f"WITH RECURSIVE {_LAY} SELECT node_id, junction FROM lab",
    "i26_layout": f"WITH RECURSIVE {_LAY2} SELECT * FROM lay WHERE junction IS NOT NULL",
    "i27_signal_codes": f"WITH RECURSIVE {_CODES} SELECT link_row, CAST(signal_entry AS INTEGER) AS signal_entry, CAST(signal_entry_reverse AS INTEGER) AS signal_entry_reverse, CAST(signal_cross_start AS INTEGER) AS signal_cross_start, CAST(signal_cross_end AS INTEGER) AS signal_cross_end FROM codes WHERE signal_entry + signal_entry_reverse + signal_cross_start + signal_cross_end > 0",
    "i28_split_crossings": f"WITH RECURSIVE {_TWINS} SELECT link_row, coalesce(a.twin, u) AS u, coalesce(b.twin, v) AS v FROM links LEFT JOIN twins a ON a.node_id = u LEFT JOIN twins b ON b.node_id = v WHERE highway IN {_P} AND (a.twin IS NOT NULL OR b.twin IS NOT NULL) AND u IS NOT NULL AND v IS NOT NULL",
    "g03_entry_connectors": f"WITH RECURSIVE {_TWINS} SELECT twin AS u, node_id AS v, 'crossing_entry' AS highway, -1::BIGINT AS osm_way_id FROM twins",
    "g04_split_points": f"WITH RECURSIVE {_LAY} SELECT node_id FROM sig UNION SELECT node_id FROM cro",
    "i29_edge_waits": f"WITH RECURSIVE {_CODES}, dirs AS (SELECT link_row, CASE WHEN coalesce(coalesce(oneway_bicycle, oneway) IN ('-1', 'T'), false) THEN [-1] WHEN coalesce(coalesce(oneway_bicycle, oneway) IN ('yes', 'true', '1', 'F'), false) OR coalesce(junction = 'roundabout', false) THEN [1] ELSE [1, -1] END AS ds FROM links), w AS (SELECT link_row, d AS direction, CASE WHEN d > 0 THEN {_WAIT('signal_entry')} + {_WAIT('signal_cross_end')} ELSE {_WAIT('signal_entry_reverse')} + {_WAIT('signal_cross_start')} END AS wait_s FROM codes JOIN (SELECT link_row, unnest(ds) AS d FROM dirs) USING (link_row)) SELECT link_row, CAST(direction AS INTEGER) AS direction, CAST(wait_s AS DOUBLE) AS wait_s FROM w WHERE wait_s > 0",
}
