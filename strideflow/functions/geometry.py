"""Geometry as Column expressions over ``ARRAY<STRUCT<x, y>>`` lines; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(g) -> Column:
    return F.col(g) if isinstance(g, str) else g


def segments(g) -> Column:
    """The line's segments ``(ax, ay, bx, by, len)`` without those of no length."""
    g = _col(g)
    n = F.greatest(F.size(g) - 1, F.lit(0))
    seg = F.zip_with(
        F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")),
    )
    return F.filter(seg, lambda s: s["len"] > 0)


def line_length(g) -> Column:
    """Sum of the segments' lengths."""
    return F.aggregate(segments(g), F.lit(0.0), lambda a, s: a + s["len"])


def first_vertex(g) -> Column:
    return F.try_element_at(_col(g), F.lit(1))


def last_vertex(g) -> Column:
    return F.try_element_at(_col(g), F.lit(-1))


def along(segs: Column, distance: Column) -> Column:
    """The point at a distance from the start of a line given by its segments; beyond the end, the end."""
    step = F.aggregate(
        segs, F.struct(distance.cast("double").alias("left"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")),
        lambda a, s: F.when(a["left"] < 0, a).otherwise(
            F.struct(
                F.when(a["left"] <= s["len"], F.lit(-1.0)).otherwise(a["left"] - s["len"]).alias("left"),
                (s["ax"] + (s["bx"] - s["ax"]) * F.least(a["left"] / s["len"], F.lit(1.0))).alias("x"),
                (s["ay"] + (s["by"] - s["ay"]) * F.least(a["left"] / s["len"], F.lit(1.0))).alias("y"),
            )
        ),
    )
    return F.struct(step["x"].alias("x"), step["y"].alias("y"))


def samples(segs: Column, step: float) -> Column:
    """Points at the middles of cells about ``step`` long on each segment, with the direction there."""

    def on(s):
        n = F.greatest(F.lit(1), F.round(s["len"] / step).cast("int"))
        return F.transform(
            F.sequence(F.lit(1), n),
            lambda k: F.struct(
                (s["ax"] + (s["bx"] - s["ax"]) * (k - 0.5) / n).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * (k - 0.5) / n).alias("y"),
                ((s["bx"] - s["ax"]) / s["len"]).alias("ux"), ((s["by"] - s["ay"]) / s["len"]).alias("uy"),
            ),
        )

    return F.flatten(F.transform(segs, on))


def point_segment(p, s, cos: float = 0.7, over: float | None = None) -> Column:
    """Distance of sample ``p`` to segment ``s``; NULL where their directions differ by more than ``cos`` allows, or ``p`` lies beyond an end by more than ``over``."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    t = ((p["x"] - s["ax"]) * dx + (p["y"] - s["ay"]) * dy) / (s["len"] * s["len"])
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ok = F.abs(p["ux"] * dx + p["uy"] * dy) >= cos * s["len"]
    if over is not None:
        ok = ok & (F.abs(t - c) * s["len"] <= over)
    return F.when(ok, F.hypot(p["x"] - s["ax"] - dx * c, p["y"] - s["ay"] - dy * c))


def hilbert_key(x: Column, y: Column, bits: int = 16) -> Column:
    """Position on the Hilbert curve over a grid of 2^bits cells a side; ``x``, ``y`` whole numbers in range."""
    x, y, d = x.cast("bigint"), y.cast("bigint"), F.lit(0).cast("bigint")
    state = F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(a, s):
        rx = F.when(a["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        ry = F.when(a["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        d2 = a["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1)), F.when(flip, s - 1 - a["y"].bitwiseAND(s - 1)).otherwise(a["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d2.alias("d"))

    sizes = F.array(*[F.lit(1 << k).cast("bigint") for k in range(bits - 1, -1, -1)])
    return F.aggregate(sizes, state, step)["d"]


def grid_index(c: Column, low: Column, high: Column, cells: int) -> Column:
    """The cell of a coordinate in ``cells`` equal cells from ``low`` to ``high``."""
    return F.least(F.greatest(F.floor(F.coalesce(F.try_divide(c - low, high - low), F.lit(0.0)) * cells), F.lit(0)), F.lit(cells - 1))
