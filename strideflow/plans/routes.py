"""Routes through given stops, their geometry, and what a parameter would have to be for two routes to take equally long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.functions.geometry import first_vertex
from strideflow.operators.nearness import nearest_within
from strideflow.plans import graph as G
from strideflow.plans.lineage import cut

#: Metres from a stop to its node at most; values of a parameter tried in one pass, and passes.
SNAP_M, TRIED, PASSES = 500.0, 25, 7


def snapped_stops(stops: DataFrame, nodes: DataFrame, reach: float = SNAP_M) -> DataFrame:
    """``stops`` (``route``, ``ord``, ``x``, ``y``) with their ``node``; a stop without one within ``reach`` is refused."""
    named = cut(stops.withColumn("stop", F.struct("route", "ord")))
    near = nearest_within(named.withColumn("key", F.to_json("stop")), "key", nodes, "node_id", reach).select(F.col("id").alias("key"), F.col("target_id").alias("node"))
    out = cut(named.withColumn("key", F.to_json("stop")).join(near, "key", "left").drop("key", "stop"))
    lost = out.where("node is null").limit(1).collect()
    if lost:
        raise ValueError(f"stop {lost[0].ord} of route {lost[0].route} has no node within {reach:g} m")
    return out


def legs(stops: DataFrame) -> DataFrame:
    """``(route, leg, origin, destination)`` from each stop (``route``, ``ord``, ``node``) to the next; two stops at one node are refused."""
    w = Window.partitionBy("route").orderBy("ord")
    out = cut(stops.select("route", F.row_number().over(w).alias("leg"), F.col("node").alias("origin"), F.lead("node").over(w).alias("destination")).where("destination is not null"))
    same = out.where("origin = destination").limit(1).collect()
    if same:
        raise ValueError(f"stops {same[0].leg} and {same[0].leg + 1} of route {same[0].route} are at the same node")
    return out


def route_edges(edges: DataFrame, stops: DataFrame, limit: float = float("inf")) -> DataFrame:
    """``(route, leg, step, link_id, direction, u, v)`` of the fastest ways from stop to stop, in travel order; a leg without a way is refused."""
    parts = legs(stops)
    found = cut(G.paths(edges, parts.select("origin", "destination"), limit))
    lost = parts.join(found.select("origin", "destination").distinct(), ["origin", "destination"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"leg {lost[0].leg} of route {lost[0].route} has no way")
    step = F.row_number().over(Window.partitionBy("route").orderBy("leg", F.desc("left"))).alias("step")
    return parts.join(found, ["origin", "destination"]).select("route", "leg", step, "link_id", "direction", "u", "v")


def geometry_of(steps: DataFrame, links: DataFrame) -> DataFrame:
    """``(route, geometry)``: the links' points in travel order, those travelled against their direction turned round, shared points once."""
    j = steps.join(links.select("link_id", "geometry"), "link_id")
    turned = F.when(F.col("direction") < 0, F.reverse("geometry")).otherwise(F.col("geometry"))
    parts = j.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("step", turned.alias("g")))).alias("p"))  # a route is walked by one traveller: a list of links
    tail = F.flatten(F.transform(F.col("p.g"), lambda g: F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))))
    return parts.select("route", F.concat(F.array(first_vertex(F.element_at("p", 1)["g"])), tail).alias("geometry"))


def totals(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Seconds, metres and links of every route."""
    e = edges.select("link_id", F.col("direction").cast("int").alias("direction"), "travel_time_s", "length_m")
    return steps.join(e, ["link_id", "direction"]).groupBy("route").agg(F.sum("travel_time_s").alias("seconds"), F.sum("length_m").alias("metres"), F.count("*").alias("links"))


def break_even(links: DataFrame, seconds: Callable[[Column], Column], low: float, high: float) -> DataFrame:
    """``(pair, value)``: the parameter at which both routes of a pair take equally long, NULL where none in the range does.

    ``links``: ``pair``, ``side`` (1 model, -1 alternative) and what
    ``seconds``, a link's time at a value of the parameter, needs.  The first
    change of sign on an even grid is narrowed by grids again.
    """
    held = cut(links)
    state = cut(held.select("pair").distinct().select("pair", F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"), F.lit(True).alias("open")))
    for _ in range(PASSES):
        step = (F.col("hi") - F.col("lo")) / (TRIED - 1)
        grid = state.where("open").select("pair", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TRIED - 1)), lambda k: F.col("lo") + step * k)).alias("k", "value"))
        gap = held.join(grid, "pair").groupBy("pair", "k", "value").agg(F.sum(F.col("side") * seconds(F.col("value"))).alias("gap"))
        w = Window.partitionBy("pair").orderBy("k")
        turn = gap.withColumns({"next": F.lead("gap").over(w), "to": F.lead("value").over(w)}).where("next is not null and gap * next <= 0").groupBy("pair").agg(F.min_by(F.struct("value", "to"), "k").alias("t"))
        state = cut(state.join(turn, "pair", "left").select("pair", F.coalesce("t.value", "lo").alias("lo"), F.coalesce("t.to", "hi").alias("hi"), F.col("t").isNotNull().alias("open")))
    return state.select("pair", F.when(F.col("open"), (F.col("lo") + F.col("hi")) / 2).alias("value"))


def by_change(found: DataFrame, now: float) -> DataFrame:
    """Break-evens with their change against ``now`` in per cent, the smallest change first, none last."""
    change = (F.col("value") - now) / now * 100
    return found.withColumn("change_pct", change).orderBy(F.asc_nulls_last(F.abs("change_pct")), "pair")
