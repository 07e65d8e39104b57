"""Link layers from ways, loose link ends, connectors between parts, runs on links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions.geometry import first_vertex, last_vertex
from strideflow.operators.nearness import nearest_within, pairs_within
from strideflow.operators.ways import split_ways
from strideflow.plans.graph import gap_connectors, weak_components
from strideflow.plans.lineage import cut, drop_cut
from strideflow.plans.numbering import running

#: Metres within which loose ends join; a connector's speed; the length from which it crosses water; the parts that are joined.
SNAP_M, CONNECTOR_KMH, GAP_M, LEAST_NODES = 2.0, 0.1, 50.0, 100
CONNECTOR = "connector"


# ------------------------------------------------------------------- ways


def as_built(ways: DataFrame) -> DataFrame:
    """Ways (``way``, ``refs``, ``tags`` as a map) with what a construction site will be as their highway, and ``under_construction``.

    Sites that don't say so, or name several kinds, stay what they are.
    """
    kind = F.trim(F.coalesce(F.col("tags")["construction"], F.lit("")))
    known = (F.col("tags")["highway"] == "construction") & ~kind.isin("", "yes", "no", "construction") & ~kind.contains(";")
    site = F.coalesce(known, F.lit(False))
    tags = F.when(site, F.map_concat(F.map_filter("tags", lambda k, v: k != "highway"), F.create_map(F.lit("highway"), kind))).otherwise(F.col("tags"))
    return ways.withColumns({"under_construction": site, "tags": tags})


def kept_ways(ways: DataFrame, excluded: dict[str, tuple[str, ...]]) -> DataFrame:
    """Ways with a highway none of whose ``;``-parts in the listed tags is listed."""
    bad = F.lit(False)
    for tag, values in excluded.items():
        bad = bad | F.coalesce(F.exists(F.transform(F.split(F.col("tags")[tag], ";"), lambda p: F.trim(p)), lambda p: p.isin(*values)), F.lit(False))
    return ways.where(F.col("tags")["highway"].isNotNull() & ~bad)


def placed_ways(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(way, refs, xs, ys, tags, …)`` of the ways all of whose nodes (``node_id``, ``x``, ``y``) are known, with a node in ``box`` if given; the way is kept whole."""
    at = ways.select("way", F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id", "left")
    inside = F.lit(True) if box is None else (F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    geo = at.groupBy("way").agg(
        F.bool_and(F.col("x").isNotNull()).alias("valid"), F.bool_or(F.coalesce(inside, F.lit(False))).alias("in"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p"),
    ).where("valid and in and n >= 2")
    return ways.join(geo.select("way", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")), "way")


def extract(ways: DataFrame, nodes: DataFrame, excluded: dict, split_at: DataFrame | None = None, box: tuple | None = None, tags: tuple[str, ...] = ("highway",)) -> DataFrame:
    """The link layer of ways: one row from junction to junction, with ``link_id``, ``way``, ``u``, ``v``, a column for each tag, ``length_m`` and ``geometry``."""
    kept = cut(placed_ways(kept_ways(as_built(ways), excluded), nodes, box))
    pieces = split_ways(kept, None if split_at is None else split_at.select(F.col("node_id").alias("ref")))
    j = pieces.join(kept.drop("refs"), "way")
    part = lambda c: F.slice(c, F.col("first") + 1, F.col("last") - F.col("first") + 1)
    cols = j.select("way", "piece", "u", "v", *[F.col("tags")[t].alias(column_name(t)) for t in tags], "under_construction", F.zip_with(part("xs"), part("ys"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("geometry"))
    numbered = running(cols, ["way", "piece"], name="n")
    steps = F.zip_with(F.slice("geometry", F.lit(1), F.size("geometry") - 1), F.slice("geometry", F.lit(2), F.size("geometry") - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return numbered.withColumn("link_id", (F.col("n") - 1).cast("bigint")).withColumn("length_m", F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)).drop("n", "piece")


def column_name(tag: str) -> str:
    """A tag as a column name."""
    return tag.replace(":", "_")


# ------------------------------------------------------------- loose ends


def resolve_ends(links: DataFrame, order: str = "link_row", reach: float = SNAP_M) -> DataFrame:
    """``(link_row, u, v)`` with a node for every end of a link with a geometry.

    An end without one (NULL or 0) takes the nearest known end within
    ``reach``, of equally near ones that with the smallest id.  Those left are
    taken in order, first all starts, then all ends: each that no earlier one
    has taken is a new node -1, -2, … and takes those within ``reach`` that are
    still free.
    """
    known_id = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    a, b = first_vertex("geometry"), last_vertex("geometry")
    t = links.where(F.size("geometry") > 0)
    ends = t.select(F.col(order).alias("row"), F.lit(0).alias("side"), known_id("u").alias("node"), a["x"].alias("x"), a["y"].alias("y")).unionByName(t.select(F.col(order).alias("row"), F.lit(1).alias("side"), known_id("v").alias("node"), b["x"].alias("x"), b["y"].alias("y")))
    loose = cut(running(ends.where("node = 0"), ["side", "row"], name="e"))
    near = nearest_within(loose, "e", ends.where("node <> 0"), "node", reach).select(F.col("id").alias("e"), F.col("target_id").alias("adopted"))
    left = cut(loose.join(near, "e", "left_anti").select("e", "x", "y"))
    minted = _greedy(left, reach)
    got = loose.join(near, "e", "left").join(minted, "e", "left").select("row", "side", F.coalesce("adopted", "minted").alias("node"))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("node")))
    return ends.where("node <> 0").select("row", "side", "node").unionByName(got).groupBy("row").agg(side(0).alias("u"), side(1).alias("v")).withColumnRenamed("row", order)


def _greedy(points: DataFrame, reach: float) -> DataFrame:
    """``(e, minted)``: in the order of ``e`` every point not yet taken leads a group and takes those within ``reach``.

    A point leads when no leader before it is near; each point belongs to its
    first leader.  All points whose earlier neighbours are decided are decided
    together, so a round settles as much as it can.
    """
    near = pairs_within(points, "e", reach)
    both = cut(near.select(F.col("a_id").alias("lo"), F.col("b_id").alias("hi")))
    state = cut(points.select("e", F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads is null").isEmpty():
        before = both.join(state.withColumnsRenamed({"e": "lo", "leads": "l"}), "lo").groupBy(F.col("hi").alias("e")).agg(F.bool_or(F.coalesce("l", F.lit(False))).alias("led"), F.bool_or(F.col("l").isNull()).alias("waits"))
        j = state.join(before, "e", "left")
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        new = cut(j.select("e", decided.alias("leads")))
        drop_cut(state)
        state = new
    leaders = state.where("leads").select("e")
    number = running(leaders, ["e"], name="n").select("e", (-F.col("n")).alias("minted"))
    pairs = both.unionByName(both.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).join(number.withColumnRenamed("e", "lo"), "lo").select(F.col("hi").alias("e"), "minted")
    first = pairs.groupBy("e").agg(F.max("minted").alias("minted"))  # the first leader has the largest number
    return number.unionByName(first.join(leaders, "e", "left_anti"))


# ------------------------------------------------------------- connectors


def island_connectors(nodes: DataFrame, edges: DataFrame, reach: float, least_nodes: int = LEAST_NODES, kmh: float = CONNECTOR_KMH, gap_m: float = GAP_M) -> DataFrame:
    """Connectors ``(link_id, u, v, highway, kind, speed_override_kmh, length_m, u_part_nodes, v_part_nodes)`` that join parts of at least ``least_nodes`` nodes.

    Gaps of under ``gap_m`` have no speed of their own; longer ones cross water
    at ``kmh``.  Gaps of over ``reach`` aren't looked at.  Numbered -1, -2, …
    from the shortest on.
    """
    if kmh <= 0:
        raise ValueError("a connector's speed must be above 0")
    part = cut(weak_components(edges))
    size = cut(part.groupBy("component").agg(F.count("*").alias("part_nodes")))
    kept = part.join(size.where(F.col("part_nodes") >= least_nodes), "component").select("node_id", "component", "part_nodes")
    found = cut(gap_connectors(nodes, kept.select("node_id", "component"), reach))
    short = F.col("gap_m") < gap_m
    end = lambda k: kept.select(F.col("node_id").alias(k), F.col("part_nodes").alias(f"{k}_part_nodes"))
    numbered = running(found, ["gap_m", "u", "v"], name="n").join(end("u"), "u").join(end("v"), "v")
    return numbered.select((-F.col("n")).alias("link_id"), "u", "v", F.lit(CONNECTOR).alias("highway"), F.when(short, "gap").otherwise("island").alias("kind"), F.when(~short, F.lit(float(kmh))).alias("speed_override_kmh"), F.col("gap_m").alias("length_m"), "u_part_nodes", "v_part_nodes")


def merge_connectors(links: DataFrame, connectors: DataFrame) -> DataFrame:
    """The layer with the connectors below it, columns that one side lacks as NULL; refused where ids clash."""
    clash = links.select("link_id").where("link_id is not null").intersect(connectors.select("link_id")).limit(1).collect()
    if clash:
        raise ValueError(f"connector id {clash[0][0]} is also in the link layer; connectors should have negative ids")
    return links.unionByName(connectors, allowMissingColumns=True)


def island_ids(connectors: DataFrame) -> DataFrame:
    """Ids of the connectors that cross water; all of a layer without ``kind``."""
    return (connectors.where("kind is null or kind <> 'gap'") if "kind" in connectors.columns else connectors).select("link_id")


# ------------------------------------------------------------------- runs


def run_on_links(run: DataFrame, links: DataFrame) -> DataFrame:
    """``(link_row, forward, reverse, forward_time, reverse_time)`` of every link row from a run's directed volumes.

    A run with ``link_id`` and ``direction`` joins on these; an older one by its
    ends, either way round, an edge along the link first; of links with the same
    ends the first row gets it.
    """
    time = F.col("travel_time_s") if "travel_time_s" in run.columns else F.lit(None).cast("double")
    r = run.withColumn("time", time)
    rows = links.select("link_row", "link_id", "u", "v")
    if "link_id" in run.columns:
        first = rows.where("link_id is not null").groupBy("link_id").agg(F.min("link_row").alias("link_row"))
        j = r.join(first, "link_id").withColumn("along", F.col("direction") >= 0)
    else:
        first = cut(rows.where("u is not null and v is not null").groupBy("u", "v").agg(F.min("link_row").alias("link_row")))
        back = first.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("link_row").alias("back_row"))
        j = r.join(first, ["u", "v"], "left").join(back, ["u", "v"], "left").withColumn("along", F.col("link_row").isNotNull()).withColumn("link_row", F.coalesce("link_row", "back_row")).where("link_row is not null")
    way = lambda along, c, f: f(F.when(F.col("along") == along, F.col(c)))
    sums = j.groupBy("link_row").agg(way(True, "volume", F.sum).alias("f"), way(False, "volume", F.sum).alias("b"), way(True, "time", F.max).alias("forward_time"), way(False, "time", F.max).alias("reverse_time"))
    return rows.select("link_row").join(sums, "link_row", "left").select("link_row", F.coalesce("f", F.lit(0.0)).alias("forward"), F.coalesce("b", F.lit(0.0)).alias("reverse"), "forward_time", "reverse_time")


def measure(placed: DataFrame, name: str) -> DataFrame:
    """One number per link row: ``volume``, ``volume_forward`` or ``volume_reverse`` of a run; an unknown name raises."""
    columns: dict[str, Column] = {"volume": F.col("forward") + F.col("reverse"), "volume_forward": F.col("forward"), "volume_reverse": F.col("reverse")}
    if name not in columns:
        raise KeyError(name)
    return placed.select("link_row", columns[name].alias("value"))


def placed_share(run: DataFrame, placed: DataFrame) -> DataFrame:
    """The share of a run's volume that found a link; under 0.99 it is likely another layer's run."""
    whole, got = run.agg(F.sum("volume").alias("whole")), placed.agg(F.sum(F.col("forward") + F.col("reverse")).alias("got"))
    return whole.crossJoin(F.broadcast(got)).select(F.try_divide("got", "whole").alias("share"))


def volume_summary(volumes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, loaded edges and their share, total, largest and median loaded volume."""
    j = edges.select("link_id", "direction").join(volumes.select("link_id", "direction", "volume"), ["link_id", "direction"], "left")
    used = F.when(F.col("volume") > 0, F.col("volume"))
    return j.agg(F.count("*").alias("edges"), F.count(used).alias("loaded_edges"), (F.count(used) / F.count("*")).alias("loaded_fraction"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"), F.max(used).alias("max_volume"), F.percentile(used, 0.5).alias("median_loaded_volume"))


def compare_volumes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total of ``a``, absolute differences to ``b``, relative to the total, and the edges that differ by over 1e-6."""
    keys = ["link_id", "direction"]
    j = a.select(*keys, F.col("volume").alias("x")).join(b.select(*keys, F.col("volume").alias("y")), keys, "full_outer").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    return j.agg(F.sum("x").alias("total_volume"), F.sum(gap).alias("total_abs_diff"), (F.sum(gap) / F.greatest(F.sum("x"), F.lit(1e-12))).alias("relative_abs_diff"), F.count_if(gap > 1e-6).alias("edges_differing"))


def edge_rows(edges: DataFrame, links: DataFrame) -> DataFrame:
    """``(u, v, link_id, link_row)`` of every edge, -1 where the layer lacks the link."""
    first = links.groupBy("link_id").agg(F.min("link_row").alias("link_row"))
    return edges.select("u", "v", "link_id").join(first, "link_id", "left").select("u", "v", "link_id", F.coalesce("link_row", F.lit(-1)).alias("link_row"))


def export_edges(edges: DataFrame, volumes: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """Edges for a layer: without those in ``dropped`` (``link_id``), and with ``volumes`` only the loaded ones."""
    e = edges if dropped is None else edges.join(dropped.select("link_id").distinct(), "link_id", "left_anti")
    return e if volumes is None else e.join(volumes.where("volume > 0").select("link_id", "direction", "volume"), ["link_id", "direction"])


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges with their position in the order of their ends, for comparisons."""
    return running(edges, ["u", "v", "link_id", "direction"], name="position")
