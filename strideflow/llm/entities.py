"""Matching entities of two tables without a shared key by loopy belief propagation.

``propagate`` takes candidate pairs with a prior log-odds from their noisy
attributes and the one-to-one factors that each pair takes part in.  Pairs and
factors exchange messages through aggregations on the factor's and on the
pair's key until no message changes; a pair's belief is its marginal
log-odds.  ``match_roads`` makes pairs, priors and factors for road links and
the volume lines of another network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.operators.nearness import CELL_ROWS, _cells, _own_cell, _salted
from strideflow.plans.lineage import cut, drop_cut


def propagate(pairs: DataFrame, members: DataFrame, damping: float = 0.3, tolerance: float = 1e-3, rounds: int = 50) -> DataFrame:
    """``pairs`` (``pair``, ``prior``) with their ``belief`` after loopy belief propagation.

    ``members`` (``pair``, ``factor``) lists the at-most-one factors of each
    pair; a pair without any keeps its prior.  In log-odds, a factor tells a
    pair ``-log(1 + sum(exp(m)))`` over what its other pairs tell it.  Messages
    are damped; the rounds end when the largest change is within
    ``tolerance``.  After each ``rounds`` without that the damping is halfway
    nearer to 1; messages that don't settle in ten times ``rounds`` raise.
    Factors with a single pair say nothing and are left out beforehand.
    """
    shared = members.groupBy("factor").count().where("count > 1").select("factor")
    edges = cut(members.distinct().join(shared, "factor").join(pairs.select("pair", "prior"), "pair").select("pair", "factor", "prior", F.lit(0.0).alias("m")))
    big = lambda c: F.exp(F.greatest(F.least(c, F.lit(60.0)), F.lit(-60.0)))
    last = None
    for k in range(10 * rounds):
        if k and k % rounds == 0:
            damping = (1 + damping) / 2
        total = edges.groupBy("pair").agg(F.sum("m").alias("told"))
        out = edges.join(total, "pair").withColumn("e", big(F.col("prior") + F.col("told") - F.col("m")))
        sums = out.groupBy("factor").agg(F.sum("e").alias("s"))
        new = -F.log1p(F.greatest(F.col("s") - F.col("e"), F.lit(0.0)))
        after = cut(out.join(sums, "factor").select("pair", "factor", "prior", (F.col("m") * damping + new * (1 - damping)).alias("m"), F.abs(new - F.col("m")).alias("change")))
        change = after.agg(F.max("change")).first()[0]
        if last is not None:
            drop_cut(last)
        last, edges = edges, after.drop("change")
        if change is None or change <= tolerance:
            break
    else:
        raise RuntimeError(f"messages still change by {change:.3g} after {10 * rounds} rounds")
    told = edges.groupBy("pair").agg(F.sum("m").alias("told"))
    return pairs.join(told, "pair", "left").withColumn("belief", F.col("prior") + F.coalesce("told", F.lit(0.0))).drop("told")


# ------------------------------------------------------------------- roads

_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšž", "aaaaaaceeeeiiiinoooooouuuuyysz"


def _name(c: str) -> Column:
    """Letters and digits of a road's name, without accents and road number."""
    plain = F.translate(F.lower(F.trim(c)), _FROM, _TO)
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, r"^(st|mt|yt|vt|kt)\.? ?\d+ *", ""), r"[^\p{L}\p{N}]", ""), F.lit(""))


def _likeness(a: Column, b: Column) -> Column:
    """1 less edits over length; an ending cut off one name doesn't count against it."""
    n = F.least(F.length(a), F.length(b))
    whole = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.greatest(whole, F.when(n >= 6, 1 - F.levenshtein(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n)) / n - 0.1).otherwise(0.0))


def _segments(g: str) -> Column:
    n = F.size(g)
    seg = F.zip_with(
        F.slice(g, 1, F.greatest(n - 1, F.lit(0))), F.slice(g, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")),
    )
    return F.filter(seg, lambda s: s["len"] > 0)


def _samples(segs: Column, step: float) -> Column:
    def along(s):
        n = F.greatest(F.lit(1), F.round(s["len"] / step).cast("int"))
        return F.transform(
            F.sequence(F.lit(1), n),
            lambda k: F.struct(
                (s["ax"] + (s["bx"] - s["ax"]) * (k - 0.5) / n).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * (k - 0.5) / n).alias("y"),
                ((s["bx"] - s["ax"]) / s["len"]).alias("ux"), ((s["by"] - s["ay"]) / s["len"]).alias("uy"),
            ),
        )

    return F.flatten(F.transform(segs, along))


def _distance(p, s, over: float) -> Column:
    """Distance of sample ``p`` to segment ``s``; NULL where it runs otherwise or lies beyond an end by more than ``over``."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    t = ((p["x"] - s["ax"]) * dx + (p["y"] - s["ay"]) * dy) / (s["len"] * s["len"])
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    same_way = F.abs(p["ux"] * dx + p["uy"] * dy) >= 0.7 * s["len"]
    beyond = F.abs(t - c) * s["len"]
    return F.when(same_way & (beyond <= over), F.hypot(p["x"] - s["ax"] - dx * c, p["y"] - s["ay"] - dy * c))


def road_candidates(links: DataFrame, lines: DataFrame, reach: float = 30.0, step: float = 8.0, over: float = 6.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every link and line that run side by side within ``reach``: ``(link, line, cover, offset_m, forward, pos, …attributes)``.

    ``links`` (``link``, ``geometry``, …) and ``lines`` (``line``, ``geometry``, …).
    The link's middle finds the lines through a grid; then samples each ``step``
    metres are held against the line's segments.  ``cover`` is the share of
    samples that have the line beside them, ``offset_m`` their mean distance.
    NULL, empty and pointlike geometries give no candidates.
    """
    a = links.withColumn("lsegs", _segments("geometry")).where(F.size("lsegs") > 0).withColumn("samples", _samples(F.col("lsegs"), step)).drop("geometry", "lsegs")
    mid = F.element_at("samples", ((F.size("samples") + 1) / 2).cast("int"))
    a = a.withColumns({"a_id": F.col("link"), "ax": mid["x"], "ay": mid["y"]})
    a = a.withColumn("cell", _own_cell(F.col("ax"), F.col("ay"), reach))
    b = lines.withColumn("vsegs", _segments("geometry")).where(F.size("vsegs") > 0)
    dense = _samples(F.col("vsegs"), reach)
    ends = F.transform(F.col("vsegs"), lambda s: F.struct(s["bx"].alias("x"), s["by"].alias("y"), F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy")))
    b = b.withColumns({"start": F.element_at("geometry", 1), "end": F.element_at("geometry", -1)}).drop("geometry")
    # samples of the line at most ``reach`` apart: the middle of a link within reach of the line is within 1.5 reach of one of them
    keyed = b.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(F.concat(dense, ends), lambda p: _cells(p["x"], p["y"], reach * 1.5))))))
    a = a.withColumn("cell", _own_cell(F.col("ax"), F.col("ay"), reach * 1.5))
    left, right = _salted(a, keyed, cell_rows)
    nearest = lambda p: F.array_min(F.transform(F.col("vsegs"), lambda s: _distance(p, s, over)))
    met = left.join(right, ["cell", "salt"]).withColumn("mid_d", nearest(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), mid["ux"].alias("ux"), mid["uy"].alias("uy")))).where(F.col("mid_d") <= reach)
    met = met.withColumn("beside", F.filter(F.transform("samples", nearest), lambda d: d <= reach))
    sx, sy, ex, ey = (F.col(p)[c] for p, c in (("start", "x"), ("start", "y"), ("end", "x"), ("end", "y")))
    chord = F.hypot(ex - sx, ey - sy)
    first, last = F.element_at("samples", 1), F.element_at("samples", -1)
    return met.withColumns({
        "cover": F.size("beside") / F.size("samples"),
        "offset_m": F.aggregate("beside", F.lit(0.0), lambda s, d: s + d) / F.greatest(F.size("beside"), F.lit(1)),
        "forward": (last["x"] - first["x"]) * (ex - sx) + (last["y"] - first["y"]) * (ey - sy) + first["ux"] * (ex - sx) * 1e-6 >= 0,
        "pos": F.coalesce(F.try_divide((F.col("ax") - sx) * (ex - sx) + (F.col("ay") - sy) * (ey - sy), chord), F.lit(0.0)),
    }).drop("samples", "vsegs", "beside", "cell", "salt", "mid_d", "ax", "ay", "a_id", "start", "end")


def match_roads(links: DataFrame, lines: DataFrame, cover: float = 0.85, reach: float = 30.0, section: float = 30.0) -> DataFrame:
    """``(link, line, offset_m, belief, confidence)`` of the candidate pairs along the whole link.

    ``links`` (``link``, ``geometry``, ``name``, ``road_class``), ``lines``
    likewise.  The prior weighs the names' likeness, the classes' difference
    and the offset; names or classes that are missing say nothing.  A link has
    at most one line in each direction, and a stretch of a line at most one
    link: these are the factors.
    """
    a = links.withColumns({"link_name": _name("name"), "link_class": F.col("road_class")}).select("link", "geometry", "link_name", "link_class")
    b = lines.withColumns({"line_name": _name("name"), "line_class": F.col("road_class")}).select("line", "geometry", "line_name", "line_class")
    c = road_candidates(a, b, reach).where(F.col("cover") >= cover)
    like = _likeness(F.col("link_name"), F.col("line_name"))
    apart = F.abs(F.col("link_class") - F.col("line_class"))
    prior = (
        2.5 - F.col("offset_m") / 6
        + F.when(F.col("link_name").isNull() | F.col("line_name").isNull(), 0.0).when(like >= 0.62, 6.0).otherwise(-8.0)
        + F.when(apart.isNull(), 0.0).when(apart == 0, 2.0).when(apart == 1, 0.5).otherwise(-5.0)
    )
    pairs = cut(c.select(F.xxhash64("link", "line").alias("pair"), "link", "line", "offset_m", "forward", "pos", prior.alias("prior")).dropDuplicates(["link", "line"]))
    at = F.array_distinct(F.array(F.floor((F.col("pos") - 8) / section), F.floor((F.col("pos") + 8) / section)))
    members = pairs.select("pair", F.concat(F.lit("l"), F.col("link").cast("string"), F.when(F.col("forward"), "+").otherwise("-")).alias("factor")).unionByName(
        pairs.select("pair", F.explode(at).alias("s"), "line").select("pair", F.concat_ws(":", F.lit("v"), "line", "s").alias("factor"))
    )
    return propagate(pairs, members).select("link", "line", "offset_m", "belief", (1 / (1 + F.exp(-F.col("belief")))).alias("confidence"))
