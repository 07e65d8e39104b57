"""Zones: polygons that share an id, their weighted access points, matrices and demand between them.

Access points are the weighted middles of a grid's occupied cells, the finest
grid with at most ``k`` of them in the zone.  Sizes are tried for all zones at
once and several at a time; a zone's candidates are only ever counted by cell,
never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.operators.nearness import nearest_within, regions_of_points
from strideflow.plans import graph as G
from strideflow.plans.demand import DISC_MEAN
from strideflow.plans.lineage import cut, drop_cut
from strideflow.plans.numbering import running

#: A cell's side grows by this, at most so often; steps of the bisection; the way within a cell against the straight line.
GROW, GROW_STEPS, BISECT_STEPS, DETOUR = 1.3, 64, 16, 1.3
#: Sizes tried in one pass: so many when growing, and a tree of so many levels when bisecting.
GROW_AT_ONCE, LEVELS = 8, 4


# ---------------------------------------------------------------- polygons


def ring_area(r: Column) -> Column:
    n = F.size(r) - 1
    return F.abs(F.aggregate(F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def dissolved(polygons: DataFrame, zone: str, order: str, rings: str = "rings") -> DataFrame:
    """``(zone, parts, area_m2, position)``: rows that share an id are one zone with all their polygons; rows without one are in none.

    Zones are numbered from 0 in the order in which they first appear.
    """
    area = F.aggregate(F.transform(rings, lambda r, k: ring_area(r) * F.when(k == 0, 1).otherwise(-1)), F.lit(0.0), lambda s, v: s + v)
    g = polygons.where(F.col(zone).isNotNull()).groupBy(F.col(zone).alias("zone")).agg(F.collect_list(rings).alias("parts"), F.sum(area).alias("area_m2"), F.min(order).alias("first"))
    return running(g, ["first"], name="position").withColumn("position", F.col("position") - 1).drop("first")


def inner_points(polygons: DataFrame, zone: str, rings: str = "rings") -> DataFrame:
    """``(zone, x, y)``: a point inside every zone: the middle of the widest stretch of a level line halfway up one of its polygons.

    The line lies between the vertices nearest to the middle of the height, so
    that it meets none; of equally wide stretches the leftmost counts.
    """
    p = polygons.where(F.col(zone).isNotNull()).select(F.col(zone).alias("zone"), F.col(rings).alias("rings")).withColumn("ys", F.flatten(F.transform("rings", lambda r: r["y"])))
    mid = (F.array_min("ys") + F.array_max("ys")) / 2
    low, high = F.array_max(F.filter("ys", lambda y: y <= mid)), F.array_min(F.filter("ys", lambda y: y > mid))
    p = p.where(F.size("ys") > 0).withColumn("level", (low + F.coalesce(high, low)) / 2)
    sides = F.flatten(F.transform("rings", lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))))
    hit = F.filter(sides, lambda s: (s["ay"] > F.col("level")) != (s["by"] > F.col("level")))
    p = p.withColumn("xs", F.array_sort(F.transform(hit, lambda s: s["ax"] + (F.col("level") - s["ay"]) * (s["bx"] - s["ax"]) / (s["by"] - s["ay"]))))
    stretch = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct((F.element_at("xs", (k * 2 + 2).cast("int")) - F.element_at("xs", (k * 2 + 1).cast("int"))).alias("width"), (-F.element_at("xs", (k * 2 + 1).cast("int"))).alias("left")))
    best = p.where(F.size("xs") >= 2).withColumn("s", F.array_max(stretch)).groupBy("zone").agg(F.max(F.struct("s", "level")).alias("m"))
    return best.select("zone", (-F.col("m.s.left") + F.col("m.s.width") / 2).alias("x"), F.col("m.level").alias("y"))


# ----------------------------------------------------------- access points


def _occupied(candidates: DataFrame, sizes: DataFrame, count: int) -> DataFrame:
    """(zone, occ): of every zone the number of cells that its candidates occupy, for each size in its array ``sizes``."""
    j = candidates.join(sizes.select("zone", "x0", "y0", F.posexplode("sizes").alias("k", "cell")), "zone")
    n = j.groupBy("zone", "k").agg(F.count_distinct(F.floor((F.col("x") - F.col("x0")) / F.col("cell")), F.floor((F.col("y") - F.col("y0")) / F.col("cell"))).alias("n"))
    return n.groupBy("zone").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).select("zone", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.col("m")[k]).alias("occ"))


def fitted_cells(candidates: DataFrame, k: int) -> DataFrame:
    """``(zone, x0, y0, cell)`` of the zones with more than ``k`` candidates that aren't all at one spot: the side of their grid.

    ``candidates``: ``zone``, ``x``, ``y``.  The side grows from the box's side
    over the root of ``k`` until at most ``k`` cells are occupied, and is then
    bisected towards the finest such grid; NULL where none is found.
    """
    box = candidates.groupBy("zone").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span")).where((F.col("n") > k) & (F.col("span") > 0))
    state = cut(box.select("zone", "x0", "y0", (F.col("span") / F.sqrt(F.lit(float(k)))).alias("start"), F.lit(None).cast("double").alias("cell")))
    for done in range(0, GROW_STEPS, GROW_AT_ONCE):
        open_ = state.where("cell is null")
        if open_.isEmpty():
            break
        sizes = open_.withColumn("sizes", F.array(*[_grown(F.col("start"), done + i) for i in range(GROW_AT_ONCE)]))
        occ = _occupied(candidates, sizes, GROW_AT_ONCE)
        fits = F.filter(F.arrays_zip("sizes", "occ"), lambda s: s["occ"] <= k)
        found = sizes.join(occ, "zone").select("zone", F.try_element_at(fits, F.lit(1))["sizes"].alias("hit"))
        new = cut(state.join(found, "zone", "left").select("zone", "x0", "y0", "start", F.coalesce("cell", "hit").alias("cell")))
        drop_cut(state)
        state = new
    state = state.select("zone", "x0", "y0", F.lit(0.0).alias("lo"), F.col("cell").alias("hi"), F.lit(False).alias("done"))
    for _ in range(BISECT_STEPS // LEVELS):
        lo, hi, mids = [F.col("lo")], [F.col("hi")], []
        for i in range(2**LEVELS - 1):  # a heap: the halves of node i are 2 i + 1 and 2 i + 2
            mids.append((lo[i] + hi[i]) * 0.5)
            lo, hi = [*lo, lo[i], mids[i]], [*hi, mids[i], hi[i]]
        open_ = state.where("hi is not null and not done").withColumn("sizes", F.array(*mids))
        occ = _occupied(candidates, open_, len(mids))
        j = open_.join(occ, "zone").withColumns({"at": F.lit(0)})
        for _ in range(LEVELS):
            here, mid = F.element_at("occ", F.col("at") + 1), F.element_at("sizes", F.col("at") + 1)
            j = j.select(
                "zone", "sizes", "occ", F.when(F.col("done") | (here <= k), F.col("lo")).otherwise(mid).alias("lo"), F.when(~F.col("done") & (here <= k), mid).otherwise(F.col("hi")).alias("hi"),
                F.when(here <= k, F.col("at") * 2 + 1).otherwise(F.col("at") * 2 + 2).alias("at"), (F.col("done") | (here == k)).alias("done"),
            )
        step = j.select("zone", F.col("lo").alias("l2"), F.col("hi").alias("h2"), F.col("done").alias("d2"))
        state = cut(state.join(step, "zone", "left").select("zone", "x0", "y0", F.coalesce("l2", "lo").alias("lo"), F.coalesce("h2", "hi").alias("hi"), F.coalesce("d2", "done").alias("done")))
    return state.select("zone", "x0", "y0", F.col("hi").alias("cell"))


def _grown(start: Column, times: int) -> Column:
    for _ in range(times):
        start = start * GROW
    return start


def reduced_points(candidates: DataFrame, k: int) -> DataFrame:
    """``(zone, x, y, weight, moment)``: at most ``k`` weighted points of every zone.

    ``candidates``: ``zone``, ``x``, ``y``, ``weight``.  A zone with no more
    than ``k`` candidates keeps them; else each occupied cell of its grid
    becomes its weighted middle, with the mean square distance from it as
    ``moment``.  Zones without any weight count every candidate equally; where
    no grid fits the heaviest ``k`` stay.
    """
    whole = candidates.groupBy("zone").agg(F.count("*").alias("n"), F.sum("weight").alias("sum"))
    c = cut(candidates.join(whole, "zone").select("zone", "x", "y", F.when((F.col("sum") <= 0) & (F.col("n") > k), 1.0).otherwise(F.col("weight")).alias("weight"), "n"))
    cells = cut(fitted_cells(c, k))
    few = c.where(F.col("n") <= k).select("zone", "x", "y", "weight", F.lit(0.0).alias("moment"))
    spot = c.where(F.col("n") > k).join(cells, "zone", "left_anti").groupBy("zone").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("weight").alias("weight")).withColumn("moment", F.lit(0.0))
    on = c.join(cells.where("cell is not null"), "zone").withColumns({"cx": F.floor((F.col("x") - F.col("x0")) / F.col("cell")), "cy": F.floor((F.col("y") - F.col("y0")) / F.col("cell"))})
    dx, dy, w = F.col("x") - F.col("x0") - F.col("cx") * F.col("cell"), F.col("y") - F.col("y0") - F.col("cy") * F.col("cell"), F.col("weight")
    s = on.groupBy("zone", "cx", "cy", "x0", "y0", "cell").agg(F.sum(w).alias("weight"), F.sum(w * dx).alias("mx"), F.sum(w * dy).alias("my"), F.sum(w * (dx * dx + dy * dy)).alias("m2"))
    safe = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    ax, ay = F.col("mx") / safe, F.col("my") / safe
    grid = s.select("zone", (F.col("x0") + F.col("cx") * F.col("cell") + ax).alias("x"), (F.col("y0") + F.col("cy") * F.col("cell") + ay).alias("y"), "weight", F.greatest(F.col("m2") / safe - ax * ax - ay * ay, F.lit(0.0)).alias("moment"))
    rank = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("weight"), "x", "y"))
    heavy = c.join(cells.where("cell is null"), "zone", "left_semi").withColumn("r", rank).where(F.col("r") <= k).select("zone", "x", "y", "weight", F.lit(0.0).alias("moment"))
    return few.unionByName(spot).unionByName(grid).unionByName(heavy)


def placed_points(polygons: DataFrame, zone: str, streets: DataFrame, others: DataFrame, k: int, rings: str = "rings") -> DataFrame:
    """``(zone, x, y, weight, moment, source)``: the access points of every zone, their weights adding up to 1.

    From the candidates (``id``, ``x``, ``y``, ``weight``) on streets, in zones
    without any from the ``others``, and else a point inside the zone.
    """
    known = polygons.where(F.col(zone).isNotNull())
    inside = lambda df: cut(df.join(regions_of_points(df, "id", known, zone, rings=rings).select("id", F.col("region").alias("zone")), "id").select("zone", "x", "y", "weight"))
    zones = known.select(F.col(zone).cast("bigint").alias("zone")).distinct()
    a = inside(streets)
    lacking = zones.join(a.select("zone").distinct(), "zone", "left_anti")
    b = inside(others).join(lacking, "zone", "left_semi")
    c = inner_points(known, zone, rings).join(lacking.join(b.select("zone").distinct(), "zone", "left_anti"), "zone", "left_semi").select("zone", "x", "y", F.lit(1.0).alias("weight"), F.lit(0.0).alias("moment"), F.lit("point").alias("source"))
    p = cut(reduced_points(a, k).withColumn("source", F.lit("street")).unionByName(reduced_points(b, k).withColumn("source", F.lit("node"))).unionByName(c))
    t = p.groupBy("zone").agg(F.sum("weight").alias("t"), F.count("*").alias("n"))
    return p.join(t, "zone").select("zone", "x", "y", F.when(F.col("t") > 0, F.col("weight") / F.col("t")).otherwise(1 / F.col("n")).alias("weight"), "moment", "source")


def snapped_points(points: DataFrame, nodes: DataFrame, reach: float, speed_ms: float) -> DataFrame:
    """``(zone, node_id, weight, access_s, access_m, x, y, cell_radius_m)``: points at their nearest node, those of a zone that share one merged.

    Points without a node within ``reach`` go, and the zone's weights are made
    to add up to 1 again.  A merged point's moment is that of all it stands for.
    """
    named = cut(running(points, ["zone", "x", "y"], name="p"))
    near = nearest_within(named, "p", nodes, "node_id", reach).select(F.col("id").alias("p"), F.col("target_id").alias("node_id"), F.col("distance").alias("m"))
    j = cut(named.join(near, "p"))
    t = j.groupBy("zone").agg(F.sum("weight").alias("t"))
    j = j.join(t, "zone").withColumn("weight", F.col("weight") / F.col("t"))
    mean = lambda c: F.sum(F.col("weight") * c) / F.sum("weight")
    g = j.groupBy("zone", "node_id").agg(F.sum("weight").alias("weight"), mean(F.col("m")).alias("access_m"), *[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(mean(F.col(c))).alias(c) for c in ("x", "y")])
    about = j.join(g.select("zone", "node_id", F.col("x").alias("gx"), F.col("y").alias("gy")), ["zone", "node_id"])
    spread = about.groupBy("zone", "node_id").agg(mean(F.col("moment") + (F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2).alias("moment"))  # exactly 0 where all stand at one place
    return g.join(spread, ["zone", "node_id"]).select("zone", "node_id", "weight", (F.col("access_m") / speed_ms).alias("access_s"), "access_m", "x", "y", F.sqrt(2 * F.col("moment")).alias("cell_radius_m"))


def zone_summary(points: DataFrame) -> DataFrame:
    per = points.groupBy("zone").count()
    a = per.agg(F.count("*").alias("zones"), F.avg("count").alias("points_per_zone_mean"), F.max("count").alias("points_per_zone_max"))
    b = points.agg(F.count("*").alias("access_points"), F.percentile("access_s", 0.5).alias("access_seconds_median"), F.max("access_s").alias("access_seconds_max"))
    return a.crossJoin(F.broadcast(b))


def chunks(counts: Iterator[tuple[int, int]], budget: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, total) of greedy runs of whole groups with at most ``budget``; a larger group is a run of its own."""
    first = last = total = None
    for group, n in counts:
        if first is not None and total + n <= budget:
            last, total = group, total + n
            continue
        if first is not None:
            yield first, last, total
        first = last = group
        total = n
    if first is not None:
        yield first, last, total


def chunked(groups: DataFrame, key: str, budget: int) -> DataFrame:
    """``(first, last, total)`` over ``groups`` (``key``, ``count``) in the order of the key; the counts are streamed through one task, a row each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows = list(zip(*chunks(pairs, budget))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["first", "last", "total"])

    return groups.select(F.col(key).cast("bigint"), F.col("count").cast("bigint")).coalesce(1).sortWithinPartitions(key).mapInArrow(run, "first bigint, last bigint, total bigint")


# ------------------------------------------------------------------ matrix


def priced_matrix(edges: DataFrame, points: DataFrame, limit: float, speed_ms: float, least_fraction: float = 0.0, rate: float | None = None) -> DataFrame:
    """``(origin, destination, seconds, metres, fraction)`` between zones over their access points.

    As :func:`graph.zone_matrix`, and a point's pair with itself counts where
    the point stands for a cell (``cell_radius_m`` above 0): two people in it
    are a trip of the disc's mean distance, stretched, beside both access legs.
    Other such pairs are dropped, and the diagonal is measured against what is left.
    """
    sums = G.zone_sums(edges, points, limit, rate)
    w2, inside = F.col("weight") ** 2, DETOUR * DISC_MEAN * F.col("cell_radius_m")
    s, m = 2 * F.col("access_s") + inside / speed_ms, 2 * F.col("access_m") + inside
    priced = F.col("cell_radius_m") > 0
    when = lambda v: F.coalesce(F.sum(F.when(priced, v)), F.lit(0.0))
    logs = when(w2 * F.exp(-rate * s)) if rate is not None else F.lit(0.0)
    own = cut(points.groupBy("zone").agg(when(w2).alias("den"), when(w2 * s).alias("num"), when(w2 * m).alias("length"), logs.alias("logs"), F.coalesce(F.sum(F.when(~priced, w2)), F.lit(0.0)).alias("dropped")))
    diagonal = own.where("den > 0").select(F.col("zone").alias("origin"), F.col("zone").alias("destination"), "den", "num", "length", "logs")
    both = sums.unionByName(diagonal).groupBy("origin", "destination").agg(*[F.sum(c).alias(c) for c in ("den", "num", "length", "logs")])
    full = both.join(own.select(F.col("zone").alias("origin"), "dropped"), "origin").withColumn("full", F.when(F.col("origin") == F.col("destination"), 1 - F.col("dropped")).otherwise(1.0))
    fraction = F.when(F.col("full") > 0, F.col("den") / F.col("full")).otherwise(0.0)
    seconds = F.col("num") / F.col("den") if rate is None else -F.log(F.greatest(F.col("logs") / F.col("den"), F.lit(1e-300))) / rate
    return full.where((F.col("den") > 0) & (fraction >= least_fraction - 1e-9)).select("origin", "destination", seconds.alias("seconds"), (F.col("length") / F.col("den")).alias("metres"), fraction.alias("fraction"))


def with_legs(far: DataFrame, legs: DataFrame) -> DataFrame:
    """A matrix between representative points with the access legs (``zone``, ``access_s``) of both zones added."""
    a, b = legs.select(F.col("zone").alias("origin"), F.col("access_s").alias("a")), legs.select(F.col("zone").alias("destination"), F.col("access_s").alias("b"))
    return far.join(a, "origin").join(b, "destination").withColumn("seconds", F.col("seconds") + F.col("a") + F.col("b")).drop("a", "b")


# ------------------------------------------------------------------ demand


def expanded(demand: DataFrame, points: DataFrame) -> DataFrame:
    """``(kind, origin, destination, o_zone, d_zone, demand)``: zone pairs' demand over pairs of access points.

    ``pair``: between two points, D · w · w; within a zone only between
    different points, measured against the weight that isn't dropped.
    ``within``: between people of one cell, which has no path, by zone.
    ``unplaced``: within zones whose only point stands for a single candidate.
    ``unknown``: with a zone that has no points.
    """
    d = demand.where("demand > 0").groupBy("origin", "destination").agg(F.sum("demand").alias("demand")).withColumnsRenamed({"origin": "o_zone", "destination": "d_zone"})
    priced = F.col("cell_radius_m") > 0
    own = cut(points.groupBy("zone").agg(F.coalesce(F.sum(F.when(priced, F.col("weight") ** 2)), F.lit(0.0)).alias("kept"), F.coalesce(F.sum(F.when(~priced, F.col("weight") ** 2)), F.lit(0.0)).alias("dropped")))
    d = cut(d)
    known = d.join(own.select(F.col("zone").alias("o_zone")), "o_zone", "left_semi").join(own.select(F.col("zone").alias("d_zone")), "d_zone", "left_semi")
    scale = 1 - F.col("dropped")
    same = known.where("o_zone = d_zone").join(own.withColumnRenamed("zone", "o_zone"), "o_zone")
    a = points.select(F.col("zone").alias("o_zone"), F.col("node_id").alias("origin"), F.col("weight").alias("wa"))
    b = points.select(F.col("zone").alias("d_zone"), F.col("node_id").alias("destination"), F.col("weight").alias("wb"))
    share = known.where("o_zone <> d_zone").withColumn("scale", F.lit(1.0)).unionByName(same.where(scale > 1e-12).select("o_zone", "d_zone", "demand", scale.alias("scale")))
    pairs = share.join(a, "o_zone").join(b, "d_zone").where("o_zone <> d_zone or origin <> destination").select(F.lit("pair").alias("kind"), "origin", "destination", "o_zone", "d_zone", (F.col("demand") * F.col("wa") * F.col("wb") / F.col("scale")).alias("demand"))
    row = lambda df, kind, v: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("origin"), F.lit(None).cast("bigint").alias("destination"), "o_zone", "d_zone", v.alias("demand"))
    inside = row(same.where((scale > 1e-12) & (F.col("kept") > 0)), "within", F.col("demand") * F.col("kept") / scale)
    lone = row(same.where(scale <= 1e-12), "unplaced", F.col("demand"))
    ks = ["o_zone", "d_zone"]
    return pairs.unionByName(inside).unionByName(lone).unionByName(row(d.join(known, ks, "left_anti"), "unknown", F.col("demand")))


def assign_zones(edges: DataFrame, demand: DataFrame, points: DataFrame, near: float, far: float) -> DataFrame:
    """Rows ``(kind, link_id, direction, u, v, o_zone, d_zone, value)`` of the zones' demand assigned in two tiers; no demand is lost.

    ``volume`` of the edges; ``loaded`` by zone pair and tier ``near`` or
    ``far``; ``same_node``: pairs of two zones' points at one node; ``within``,
    ``unplaced`` and ``unknown`` as in :func:`expanded`; ``stranded``: within a
    zone but out of reach; ``missed``: not reached in the far tier either, which
    goes between the zones' heaviest points.
    """
    x = cut(expanded(demand, points))
    pairs = x.where("kind = 'pair'")
    got = cut(G.assign(edges, pairs.select("origin", "destination", "demand"), near))
    served = got.where("kind = 'length'").select("origin", "destination").withColumn("served", F.lit(True))
    judged = cut(pairs.join(served, ["origin", "destination"], "left").withColumn("what", F.when(F.col("origin") == F.col("destination"), "same_node").when(F.col("served"), "near").when(F.col("o_zone") == F.col("d_zone"), "stranded").otherwise("over")).groupBy("what", "o_zone", "d_zone").agg(F.sum("demand").alias("value")))
    rep = cut(points.groupBy("zone").agg(F.min(F.struct(-F.round("weight", 12), "node_id")).alias("m")).select("zone", F.col("m.node_id").alias("node_id")))
    over = judged.where("what = 'over'").join(rep.select(F.col("zone").alias("o_zone"), F.col("node_id").alias("origin")), "o_zone").join(rep.select(F.col("zone").alias("d_zone"), F.col("node_id").alias("destination")), "d_zone")
    over = cut(over)
    again = cut(G.assign(edges, over.select("origin", "destination", F.col("value").alias("demand")), far))
    reached = again.where("kind = 'length'").select("origin", "destination").withColumn("served", F.lit(True))
    second = over.join(reached, ["origin", "destination"], "left").select(F.when(F.col("origin") == F.col("destination"), "same_node").when(F.col("served"), "far").otherwise("missed").alias("kind"), "o_zone", "d_zone", "value")
    out = judged.where("what <> 'over'").select(F.col("what").alias("kind"), "o_zone", "d_zone", "value").unionByName(second).unionByName(x.where("kind <> 'pair'").select("kind", "o_zone", "d_zone", F.col("demand").alias("value")))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    zone_rows = out.groupBy("kind", "o_zone", "d_zone").agg(F.sum("value").alias("value")).select("kind", none("bigint", "link_id"), none("int", "direction"), none("bigint", "u"), none("bigint", "v"), "o_zone", "d_zone", "value")
    volume = G.link_volumes(got).unionByName(G.link_volumes(again)).groupBy("link_id", "direction", "u", "v").agg(F.sum("volume").alias("value"))
    return volume.select(F.lit("volume").alias("kind"), "link_id", "direction", "u", "v", none("bigint", "o_zone"), none("bigint", "d_zone"), "value").unionByName(zone_rows)
