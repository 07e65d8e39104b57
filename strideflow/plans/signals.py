"""Signalled junctions: which nodes belong together, what a link pays there, and crossings with a node of their own.

All inputs are tables: ``links`` (``link_row``, ``u``, ``v``, ``highway``),
``nodes`` (``node_id``, ``x``, ``y``), and the ids of signalled nodes, of road
lights among them, and of unsignalled crossings (``node_id`` each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.operators.nearness import nearest_within, pairs_within
from strideflow.plans.graph import weak_components
from strideflow.plans.lineage import cut
from strideflow.plans.numbering import running

#: Metres within which signalled nodes are one junction; the codes of lights, junctions by their largest road.
RADIUS_M = 30.0
NONE, MIDBLOCK, PRIMARY, SECONDARY, TERTIARY, MINOR = 0, 3, 5, 6, 7, 8
JUNCTION_ROADS = {
    "trunk": PRIMARY, "trunk_link": PRIMARY, "primary": PRIMARY, "primary_link": PRIMARY, "secondary": SECONDARY, "secondary_link": SECONDARY,
    "tertiary": TERTIARY, "tertiary_link": TERTIARY, "unclassified": MINOR, "residential": MINOR,
}
ENTRY = "crossing_entry"


def _flag(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return df.join(ids.select("node_id").distinct().withColumn(name, F.lit(True)), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _ends(links: DataFrame) -> DataFrame:
    """Both ends of every link with known ends, with what kind of way it is."""
    path, road = is_path(F.col("highway")), F.coalesce(F.col("highway").isin(*JUNCTION_ROADS), F.lit(False))
    known = links.where("u is not null and v is not null and u <> 0 and v <> 0")
    return known.select(F.explode(F.array("u", "v")).alias("node_id"), "highway", path.alias("path"), road.alias("road"))


def is_path(highway: Column) -> Column:
    return F.coalesce(highway.isin(*sp.PATHS), F.lit(False))


def junctions(links: DataFrame, nodes: DataFrame, signals: DataFrame, lights: DataFrame, radius: float = RADIUS_M) -> DataFrame:
    """``(node_id, junction)`` of every signalled node that ends a link: the smallest node of those connected within ``radius``."""
    at = signals.select("node_id").distinct().join(_ends(links).select("node_id").distinct(), "node_id").join(nodes, "node_id")
    at = cut(at.select("node_id", "x", "y"))
    near = pairs_within(at, "node_id", radius).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    return at.join(weak_components(near), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("junction"))


def layout(links: DataFrame, nodes: DataFrame, signals: DataFrame, lights: DataFrame, crossings: DataFrame, radius: float = RADIUS_M) -> DataFrame:
    """``(node_id, junction, code, is_signal, is_crossing, on_road)`` of every link end.

    ``junction`` is that of the nearest signalled node within ``radius``, NULL
    outside every one.  A junction without a road light and a side road is
    mid-block: only its signalled nodes are inside.  ``code`` is the junction's,
    by its largest road; ``on_road``: a road of the junction ends here.
    """
    ends = cut(_ends(links))
    label = cut(junctions(links, nodes, signals, lights, radius))
    all_nodes = _flag(_flag(ends.select("node_id").distinct(), signals, "is_signal"), crossings, "unsignalled")
    placed = nodes.join(all_nodes.select("node_id"), "node_id", "left_semi")
    signal_xy = nodes.join(label, "node_id").select("node_id", "x", "y")
    nearest = nearest_within(placed, "node_id", signal_xy, "node_id", radius).select(F.col("id").alias("node_id"), F.col("target_id").alias("signal"))
    degree = ends.where(~F.col("path")).groupBy("node_id").count().withColumnRenamed("count", "roads")
    kind = _flag(label, lights, "light").join(degree, "node_id", "left").groupBy("junction").agg(
        (~F.bool_or("light") & (F.max(F.coalesce("roads", F.lit(0))) <= 2)).alias("midblock")
    )
    inside = nearest.join(label.select(F.col("node_id").alias("signal"), "junction"), "signal").join(kind, "junction").join(all_nodes, "node_id").where(~F.col("midblock") | F.col("is_signal")).select("node_id", "junction", "midblock")
    inside = cut(inside)
    rank = sp.lookup({h: {MINOR: 0, TERTIARY: 1, SECONDARY: 2, PRIMARY: 3}[c] for h, c in JUNCTION_ROADS.items()}, F.col("highway"), 0)
    on = ends.where("road").join(inside, "node_id")
    largest = on.groupBy("junction").agg(F.max(rank).cast("int").alias("rank"))
    code = F.when(F.col("midblock"), MIDBLOCK).otherwise(F.element_at(F.array(*[F.lit(c) for c in (MINOR, TERTIARY, SECONDARY, PRIMARY)]), F.coalesce("rank", F.lit(0)) + 1))
    road = on.select("node_id").distinct().withColumn("on_road", F.lit(True))
    known = inside.join(largest, "junction", "left").select("node_id", "junction", code.alias("code"))
    return all_nodes.join(known, "node_id", "left").join(road, "node_id", "left").select("node_id", "junction", "code", "is_signal", (F.col("is_signal") | F.col("unsignalled")).alias("is_crossing"), F.coalesce("on_road", F.lit(False)).alias("on_road"))


def signal_codes(links: DataFrame, lay: DataFrame) -> DataFrame:
    """``(link_row, signal_entry, signal_entry_reverse, signal_cross_start, signal_cross_end)`` of every link with known ends.

    A junction's road pays where it enters; anything else where it joins one of
    its roads, unless a path meets it at a crossing or comes from where the
    junction was paid.  A path stepping on a signalled crossing pays likewise.
    """
    info = lay.select("node_id", F.struct("junction", "code", "is_signal", "is_crossing", "on_road", (F.col("is_signal") | (F.col("on_road") & ~F.col("is_crossing"))).alias("paid")).alias("i"))
    known = links.where("u is not null and v is not null and u <> 0 and v <> 0")
    j = known.join(info.select(F.col("node_id").alias("u"), F.col("i").alias("a")), "u").join(info.select(F.col("node_id").alias("v"), F.col("i").alias("b")), "v")
    path, road = is_path(F.col("highway")), F.coalesce(F.col("highway").isin(*JUNCTION_ROADS), F.lit(False))

    def entering(to: str, back: str) -> Column:
        t, f = F.col(to), F.col(back)
        same = F.coalesce(t["junction"] == f["junction"], F.lit(False))
        enters = road & t["junction"].isNotNull() & ~same
        joins = ~road & t["junction"].isNotNull() & t["on_road"] & ~(path & t["is_crossing"]) & ~(f["paid"] & same)
        return F.when(enters | joins, t["code"]).otherwise(NONE).cast("int")

    def stepping(to: str, back: str) -> Column:
        t, f = F.col(to), F.col(back)
        same = t["junction"].eqNullSafe(f["junction"])
        return F.when(path & t["is_signal"] & ~(f["paid"] & same), F.coalesce(t["code"], F.lit(NONE))).otherwise(NONE).cast("int")

    return j.select("link_row", entering("b", "a").alias("signal_entry"), entering("a", "b").alias("signal_entry_reverse"), stepping("a", "b").alias("signal_cross_start"), stepping("b", "a").alias("signal_cross_end"))


def split_crossings(links: DataFrame, lay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with path ends at unsignalled crossings of a junction's roads moved to twins, and the connectors ``(u, v, highway)`` from twin to crossing.

    Twins are numbered downwards from below the smallest node, or below 0, in
    the order of the nodes.
    """
    touched = _ends(links).where("path").select("node_id").distinct()
    split = lay.where("is_crossing and not is_signal and on_road").select("node_id").join(touched, "node_id", "left_semi")
    base = lay.agg((F.least(F.min("node_id"), F.lit(0)) - 1).alias("base"))
    twins = cut(running(split, ["node_id"], name="k").crossJoin(F.broadcast(base)).select("node_id", (F.col("base") - F.col("k") + 1).alias("twin")))
    path = is_path(F.col("highway"))
    moved = links
    for end in ("u", "v"):
        moved = moved.join(twins.select(F.col("node_id").alias(end), F.col("twin").alias(f"{end}_twin")), end, "left").withColumn(end, F.when(path & F.col(f"{end}_twin").isNotNull(), F.col(f"{end}_twin")).otherwise(F.col(end))).drop(f"{end}_twin")
    return moved, twins.select(F.col("twin").alias("u"), F.col("node_id").alias("v"), F.lit(ENTRY).alias("highway"))
