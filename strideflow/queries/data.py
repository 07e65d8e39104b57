"""Queries of the two data-preparation operators of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators.nearness import nearest_within, pairs_within, regions_of_points
from strideflow.operators.packed import unpack
from strideflow.sources.tables import read_table

TAG_FIELDS = ["crossing", "surface", "highway"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the tag fields that hold more than one."""
    links = read_table(spark, sf_dir, "links", ["link_row", *TAG_FIELDS])
    return unpack(links, "link_row", TAG_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids close to each other, their nearest node and the municipality around them."""
    points = read_table(spark, sf_dir, "centroids", ["centroid_id", "x", "y"])
    nodes = read_table(spark, sf_dir, "nodes", ["node_index", "x", "y"])
    polygons = read_table(spark, sf_dir, "municipality_polygons", ["municipality_id", "rings"])
    row = lambda df, name, a, b: df.select(F.lit(name).alias("relation"), F.col(a).alias("centroid_id"), F.col(b).alias("other_id"))
    near = row(pairs_within(points, "centroid_id", 40.0), "centroid", "a_id", "b_id")
    node = row(nearest_within(points, "centroid_id", nodes, "node_index", 100.0), "node", "id", "target_id").distinct()
    inside = row(regions_of_points(points, "centroid_id", polygons, "municipality_id"), "municipality", "id", "region").distinct()
    return near.unionByName(node).unionByName(inside)


def p6_snap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids whose nearest node within 100 m isn't the recorded one, with both distances."""
    points = read_table(spark, sf_dir, "centroids", ["centroid_id", "x", "y", "node_index", "snap_distance"])
    nodes = read_table(spark, sf_dir, "nodes", ["node_index", "x", "y"])
    near = nearest_within(points, "centroid_id", nodes, "node_index", 100.0)
    told = points.where("x is not null and y is not null").select(F.col("centroid_id").alias("id"), "x", "y", F.col("node_index").alias("told_node"), F.when(~F.isnan("snap_distance"), F.col("snap_distance")).alias("told_m")).distinct()
    both = told.join(near, ["id", "x", "y"])
    return both.where(~F.col("told_node").eqNullSafe(F.col("target_id"))).select(F.col("id").alias("centroid_id"), "told_node", "target_id", F.round("distance", 3).alias("distance_m"), "told_m")


_PIECES = r"""regexp_extract_all(raw, '"(?:[^"]|"")*"|''[^'']*''|[^;,|/+&·\t\n\r；，、"'']+')"""

#: Pieces of every field, as (link_row, tag_field, items); quotes are balanced in these tables.
PIECES_SQL = f"""
raws AS (SELECT link_row, 'crossing' AS tag_field, crossing AS raw FROM links UNION ALL SELECT link_row, 'surface', surface FROM links UNION ALL SELECT link_row, 'highway', highway FROM links),
pieces AS (SELECT link_row, tag_field, list_filter(list_transform({_PIECES}, lambda p: CASE
    WHEN left(trim(p), 1) = '"' THEN trim(replace(substr(trim(p), 2, length(trim(p)) - 2), '""', '"'))
    WHEN left(trim(p), 1) = '''' THEN trim(substr(trim(p), 2, length(trim(p)) - 2)) ELSE trim(p) END), lambda p: p <> '') AS items
  FROM raws WHERE raw IS NOT NULL)"""

_IN = """
edges AS (SELECT polygon_id, municipality_id, r[i].x AS ax, r[i].y AS ay, r[i + 1].x AS bx, r[i + 1].y AS by
  FROM (SELECT polygon_id, municipality_id, unnest(rings) AS r FROM municipality_polygons), LATERAL (SELECT unnest(range(1, len(r))) AS i)),
inside AS (SELECT c.centroid_id, e.municipality_id, e.polygon_id FROM pts c JOIN edges e ON (e.ay > c.y) <> (e.by > c.y) AND c.x < e.ax + (c.y - e.ay) * (e.bx - e.ax) / (e.by - e.ay)
  GROUP BY c.centroid_id, c.x, c.y, e.municipality_id, e.polygon_id HAVING count(*) % 2 = 1)"""

P6_SQL = f"""
WITH pts AS (SELECT DISTINCT centroid_id, x, y FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL),
cells AS (SELECT *, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM pts),
nds AS (SELECT DISTINCT node_index, x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL),
near_nodes AS (SELECT c.centroid_id, c.x, c.y, n.node_index, (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) AS d2
  FROM (SELECT *, cx + dx AS jx, cy + dy AS jy FROM cells, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c JOIN nds n ON n.cx = c.jx AND n.cy = c.jy),
{_IN}
SELECT DISTINCT 'centroid' AS relation, a.centroid_id, b.centroid_id AS other_id
FROM (SELECT *, cx + dx AS jx, cy + dy AS jy FROM cells, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) a JOIN cells b ON b.cx = a.jx AND b.cy = a.jy
WHERE a.centroid_id < b.centroid_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600
UNION ALL SELECT DISTINCT 'node', centroid_id, node FROM (SELECT centroid_id, arg_min(node_index, (d2, node_index)) AS node FROM near_nodes WHERE d2 <= 10000 GROUP BY centroid_id, x, y)
UNION ALL SELECT DISTINCT 'municipality', centroid_id, municipality_id FROM inside"""

P6_SNAP_SQL = """
WITH pts AS (SELECT DISTINCT centroid_id, x, y, node_index AS told_node, CASE WHEN NOT isnan(snap_distance) THEN snap_distance END AS told_m FROM centroids WHERE x IS NOT NULL AND y IS NOT NULL),
cells AS (SELECT *, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM pts),
nds AS (SELECT DISTINCT node_index, x, y, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL),
best AS (SELECT c.centroid_id, c.x, c.y, c.told_node, c.told_m, min((sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)), n.node_index)) AS m
  FROM (SELECT *, cx + dx AS jx, cy + dy AS jy FROM cells, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c JOIN nds n ON n.cx = c.jx AND n.cy = c.jy
  WHERE (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) <= 10000 GROUP BY ALL)
SELECT centroid_id, told_node, m[2] AS target_id, round(m[1], 3) AS distance_m, told_m FROM best WHERE told_node IS DISTINCT FROM m[2]"""

QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_snap_check": p6_snap_check}
SQL = {
    "p2_found": f"WITH {PIECES_SQL.strip()} SELECT link_row, tag_field, CAST(i AS INTEGER) AS pos, items[i] AS item FROM pieces, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i) WHERE len(items) > 1",
    "p6_found": P6_SQL.strip(),
    "p6_snap_check": P6_SNAP_SQL.strip(),
}
