"""The link layer: reading, normalising, pricing and expanding into directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions import speeds as sp
from strideflow.functions.geometry import first_vertex, last_vertex, line_length
from strideflow.plans.numbering import running
from strideflow.sources.tables import read_table

REQUIRED = ("link_id", "u", "v", "highway", "geometry")
OPTIONAL = {
    "surface": "string", "segregated": "string", "crossing": "string", "oneway": "string", "oneway_bicycle": "string", "junction": "string", "car_volume": "double",
    "car_volume_override": "double", "adjacent_car_volume": "double", "speed_override_kmh": "double", "ascent_m": "double", "descent_m": "double",
    "ascent_override_m": "double", "descent_override_m": "double", "signal_entry": "int", "signal_entry_reverse": "int", "signal_cross_start": "int", "signal_cross_end": "int",
    "crossing_way_share": "double", "cycleway": "string", "cycleway_left": "string", "cycleway_right": "string", "cycleway_both": "string", "bicycle": "string",
    "bicycle_forward": "string", "bicycle_backward": "string",
}


def read_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer with every optional column, missing ones as typed NULL; required columns must be there."""
    return with_defaults(read_table(spark, sf_dir, "links"))


def with_defaults(links: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in links.columns]
    if missing:
        raise ValueError(f"the link layer lacks {missing}")
    return links.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in links.columns})


def normalise(links: DataFrame, order: str = "link_row") -> DataFrame:
    """Rows with a geometry and two different known ends, unique link ids, lengths measured anew.

    Of rows with equal ids the first in ``order`` keeps it; the others, and
    rows without an id, get numbers from the largest on, in that order.
    Normalising twice changes nothing.
    """
    ok = links.where((F.size("geometry") > 1) & F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    # the first of each id is known by its place, so that the rows of an id, or those without one, needn't come together
    first = ok.where("link_id is not null").groupBy("link_id").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    ranked = ok.join(first, order, "left")
    keep = ranked.where("_first").drop("_first").select(ok.columns)
    new = running(ranked.where("_first is null").drop("_first").select(ok.columns), [order], name="_n")
    top = ok.agg(F.coalesce(F.max("link_id"), F.lit(0)).alias("_top"))
    renumbered = new.crossJoin(F.broadcast(top)).withColumn("link_id", F.col("_top") + F.col("_n")).drop("_n", "_top")
    return keep.unionByName(renumbered).withColumn("length_m", line_length("geometry"))


def ends(links: DataFrame) -> DataFrame:
    """First and last vertex of every link."""
    a, b = first_vertex("geometry"), last_vertex("geometry")
    return links.select("link_row", a["x"].alias("x_u"), a["y"].alias("y_u"), b["x"].alias("x_v"), b["y"].alias("y_v"))


def cycleway_by_direction():
    """The ``;``-joined cycleway values that serve each direction of travel, traffic keeping right."""
    plain, left, right, both = (F.coalesce(F.lower(F.col(c)), F.lit("")) for c in ("cycleway", "cycleway_left", "cycleway_right", "cycleway_both"))
    against = F.coalesce(F.col("oneway").isin("-1", "T"), F.lit(False))
    along = F.coalesce(F.col("oneway").isin("yes", "true", "1", "F"), F.lit(False))
    single = F.size(sp.directions("bike", F.col("oneway"), F.col("oneway_bicycle"), F.col("junction"))) == 1
    every = F.concat_ws(";", plain, both, left, right)
    forward = F.when(single, every).otherwise(F.concat_ws(";", F.when(against, "").otherwise(plain), both, right))
    reverse = F.when(single, every).otherwise(F.concat_ws(";", F.when(along, "").otherwise(plain), both, left))
    return forward, reverse


def priced(links: DataFrame, profile: sp.Profile) -> DataFrame:
    """Speeds, waits and travel times in both directions."""
    highway, bike = F.col("highway"), profile.mode == "bike"
    cars = sp.car_volume(F.col("car_volume"), F.col("car_volume_override"), F.col("adjacent_car_volume"))
    forward, reverse = cycleway_by_direction()
    road = F.coalesce(~highway.isin(*sp.PATHS), F.lit(True))
    says = lambda c, w: sp.names(F.lower(F.col(c)), w)
    out = {}
    for way, cycleway, tag in (("", forward, "bicycle_forward"), ("_reverse", reverse, "bicycle_backward")):
        v = sp.speed(profile, highway, F.col("surface"), F.col("segregated"), cars, cycleway)
        if bike:
            aside = road & (says("bicycle", "use_sidepath") | says(tag, "use_sidepath") | sp.names(cycleway, "separate"))
            v = F.when(aside, v / sp.SIDEPATH).otherwise(v)
        out[f"speed{way}_kmh"] = F.when(F.col("speed_override_kmh") > 0, F.col("speed_override_kmh")).otherwise(v)
    climb = F.greatest(F.coalesce("ascent_override_m", "ascent_m", F.lit(0.0)), F.lit(0.0))
    drop = F.greatest(F.coalesce("descent_override_m", "descent_m", F.lit(0.0)), F.lit(0.0))
    wait = sp.signal_wait(F.col("signal_entry")) + sp.signal_wait(F.col("signal_cross_end"))
    back_wait = sp.signal_wait(F.col("signal_entry_reverse")) + sp.signal_wait(F.col("signal_cross_start"))
    yields = sp.crossing_yield(highway, F.col("crossing"), F.coalesce("crossing_way_share", F.lit(1.0))) if bike else F.lit(0.0)
    timed = links.withColumns(out)
    return timed.withColumns({
        "travel_time_s": sp.travel_time(F.col("length_m"), F.col("speed_kmh")) + wait + yields + sp.grade_penalty(climb, F.col("length_m")),
        "travel_time_reverse_s": sp.travel_time(F.col("length_m"), F.col("speed_reverse_kmh")) + back_wait + yields + sp.grade_penalty(drop, F.col("length_m")),
    })


def directed_edges(links: DataFrame, mode: str) -> DataFrame:
    """One row per link and direction of travel; the way back has its own time."""
    way = F.explode(sp.directions(mode, F.col("oneway"), F.col("oneway_bicycle"), F.col("junction"))).alias("direction")
    back = F.col("direction") < 0
    return links.select("link_id", "u", "v", "travel_time_s", "travel_time_reverse_s", "length_m", way).select(
        "link_id", F.when(back, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(back, F.col("u")).otherwise(F.col("v")).alias("v"),
        F.when(back, F.col("travel_time_reverse_s")).otherwise(F.col("travel_time_s")).alias("travel_time_s"), "length_m", F.col("direction").cast("tinyint").alias("direction"),
    )


def fastest_parallel(edges: DataFrame) -> DataFrame:
    """Of parallel edges the fastest, of equally fast ones the one with the smallest link id and then direction."""
    best = F.min_by(F.struct("travel_time_s", "length_m", "link_id", "direction"), F.struct("travel_time_s", "link_id", "direction")).alias("e")
    return edges.groupBy("u", "v").agg(best).select("u", "v", "e.*")


def network(spark: SparkSession, sf_dir: str, profile: sp.Profile) -> DataFrame:
    """Directed edges of the normalised layer with known nodes, parallel ones reduced to the fastest."""
    links = normalise(read_links(spark, sf_dir)).where("u <> 0 and v <> 0")
    return fastest_parallel(directed_edges(priced(links, profile), profile.mode))
