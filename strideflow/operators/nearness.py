"""Points near other points, and the region around each point.

Distance joins key both sides by the cells of a grid and join on equality of
the cell, so no plan compares every point with every other.  Cells are twice
the distance wide: a point's disc then touches at most four of them.  A cell
that holds many points is split: one side's rows are spread over salts, the
other side's rows of that cell are repeated for each salt.

Regions are triangulated by ear clipping; the triangles go into a
bounding-volume hierarchy which a batch of points descends together, and the
candidate triangles are tested exactly.  Points on a boundary that several
regions share get the smallest region number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of one cell that one task compares with one salt's share.
CELL_ROWS = 4096
#: Triangles up to which every task gets the whole hierarchy (72 bytes each).
BROADCAST_TRIANGLES = 200_000


def usable(x: str = "x", y: str = "y") -> Column:
    """Both coordinates known and finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e12)
    return ok(x) & ok(y)


def _cells(x: Column, y: Column, reach: float) -> Column:
    """The cells, 2·reach wide, that the square of half-width ``reach`` around a point touches."""
    w = 2.0 * reach
    lo_x, hi_x, lo_y, hi_y = (F.floor((c + s * reach) / w) for c, s in ((x, -1), (x, 1), (y, -1), (y, 1)))
    return F.array_distinct(F.array(*[F.struct(a.alias("cx"), b.alias("cy")) for a in (lo_x, hi_x) for b in (lo_y, hi_y)]))


def _own_cell(x: Column, y: Column, reach: float) -> Column:
    return F.struct(F.floor(x / (2.0 * reach)).alias("cx"), F.floor(y / (2.0 * reach)).alias("cy"))


def _salted(single: DataFrame, many: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: of the cells with over ``cell_rows`` rows of ``single``, its rows are spread and those of ``many`` repeated."""
    hot = single.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("k"))
    left = single.join(hot, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("a_id", "ax", "ay"), F.coalesce("k", F.lit(1)))).drop("k")
    right = many.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("k", F.lit(1)).cast("bigint") - 1))).drop("k")
    return left, right


def _within(a: DataFrame, b: DataFrame, reach: float, cell_rows: int) -> DataFrame:
    """(a_id, ax, ay, b_id, bx, by, d2) of every two points at most ``reach`` apart, each once."""
    single = a.withColumn("cell", _own_cell(F.col("ax"), F.col("ay"), reach))
    many = b.withColumn("cell", F.explode(_cells(F.col("bx"), F.col("by"), reach)))
    left, right = _salted(single, many, cell_rows)
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, ["cell", "salt"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach).drop("cell", "salt")


def pairs_within(points: DataFrame, key: str, reach: float, x: str = "x", y: str = "y", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs ``(a_id, b_id)``, ``a_id < b_id``, of different keys with positions at most ``reach`` apart.

    Rows with a NULL or non-finite coordinate or a NULL key are left out;
    repeated rows count once; a key with several positions is near wherever one
    of them is.  An empty table gives no pairs.
    """
    p = points.where(usable(x, y) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    a = p.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return _within(a, b, reach, cell_rows).where("a_id < b_id").select("a_id", "b_id").distinct()


def nearest_within(points: DataFrame, key: str, targets: DataFrame, target_key: str, reach: float, x: str = "x", y: str = "y", tx: str = "x", ty: str = "y", cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each position of each key the nearest target at most ``reach`` away: ``(id, x, y, target_id, distance)``.

    Equal distances: the smaller target key.  Positions without a target in
    reach give no row, as do unusable coordinates and NULL keys on either side.
    """
    # the targets stand each in its own cell; the points look into all cells they touch, then the best of them stays
    a = targets.where(usable(tx, ty) & F.col(target_key).isNotNull()).select(F.col(target_key).alias("a_id"), F.col(tx).alias("ax"), F.col(ty).alias("ay")).distinct()
    b = points.where(usable(x, y) & F.col(key).isNotNull()).select(F.col(key).alias("b_id"), F.col(x).alias("bx"), F.col(y).alias("by")).distinct()
    best = _within(a, b, reach, cell_rows).groupBy("b_id", "bx", "by").agg(F.min(F.struct("d2", "a_id")).alias("m"))
    return best.select(F.col("b_id").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("m.a_id").alias("target_id"), F.sqrt("m.d2").alias("distance"))


# ---------------------------------------------------------------- triangles


def _area2(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float(np.sum(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]))


def _side(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _open(ring) -> np.ndarray:
    p = np.asarray(ring, dtype=float).reshape(-1, 2)
    p = p[np.isfinite(p).all(axis=1)]
    keep = np.ones(len(p), bool)
    if len(p):
        keep[1:] = (p[1:] != p[:-1]).any(axis=1)
    p = p[keep]
    return p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p


def _in_cone(before, at, after, m) -> bool:
    """Whether the way from corner ``at`` of a ring (inside on the left) to ``m`` starts inwards."""
    if _side(before, at, after) >= 0:
        return _side(at, m, before) > 0 and _side(m, at, after) > 0
    return not (_side(at, m, after) >= 0 and _side(m, at, before) >= 0)


def _free(m, p, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether the way between two corners neither crosses nor touches any of the edges, but at its ends."""
    x, y = p[0] - m[0], p[1] - m[1]
    side = lambda q: x * (q[:, 1] - m[1]) - y * (q[:, 0] - m[0])
    s1, s2 = side(c), side(d)
    ex, ey = d[:, 0] - c[:, 0], d[:, 1] - c[:, 1]
    t1 = ex * (m[1] - c[:, 1]) - ey * (m[0] - c[:, 0])
    t2 = ex * (p[1] - c[:, 1]) - ey * (p[0] - c[:, 0])
    if ((s1 * s2 < 0) & (t1 * t2 < 0)).any():
        return False
    within = (s1 == 0) & ((c[:, 0] - m[0]) * (c[:, 0] - p[0]) + (c[:, 1] - m[1]) * (c[:, 1] - p[1]) < 0)
    return not within.any()


def _bridged(outer: list, holes: list[list]) -> list:
    """The outer ring with every hole cut open to the nearest corner that sees it, from the rightmost hole leftwards."""
    rest = sorted(holes, key=lambda h: (-max(p[0] for p in h), min(map(tuple, h))))
    for n, hole in enumerate(rest):
        k = max(range(len(hole)), key=lambda i: (hole[i][0], hole[i][1]))
        m = hole[k]
        rings = [outer, *rest[n:]]
        c = np.array([p for r in rings for p in r], float)
        d = np.array([p for r in rings for p in (*r[1:], r[0])], float)
        o = np.array(outer, float)
        for at in np.argsort((o[:, 0] - m[0]) ** 2 + (o[:, 1] - m[1]) ** 2, kind="stable"):
            at = int(at)
            if tuple(outer[at]) == tuple(m) or (_in_cone(outer[at - 1], outer[at], outer[(at + 1) % len(outer)], m) and _in_cone(hole[k - 1], m, hole[(k + 1) % len(hole)], outer[at]) and _free(m, outer[at], c, d)):
                outer = outer[: at + 1] + hole[k:] + hole[: k + 1] + outer[at:]
                break
    return outer


def _sides(rings: list[np.ndarray]) -> np.ndarray:
    """All sides of the rings as rows ax ay bx by."""
    return np.concatenate([np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings])


def _crossings(e: np.ndarray) -> np.ndarray:
    """The heights at which sides cross each other elsewhere than at their ends."""
    out, d = [], e[:, 2:] - e[:, :2]
    step = max(1, 1_000_000 // len(e))
    for k in range(0, len(e), step):
        a, da = e[k : k + step, None, :], d[k : k + step, None, :]
        side = lambda q: da[..., 0] * (q[..., 1] - a[..., 1]) - da[..., 1] * (q[..., 0] - a[..., 0])
        back = lambda q: d[None, :, 0] * (q[..., 1] - e[None, :, 1]) - d[None, :, 1] * (q[..., 0] - e[None, :, 0])
        t1, t2 = back(a[..., :2]), back(a[..., 2:])
        i, j = np.nonzero((side(e[None, :, :2]) * side(e[None, :, 2:]) < 0) & (t1 * t2 < 0))
        t = t1[i, j] / (t1[i, j] - t2[i, j])
        out.append(e[k + i, 1] + t * d[k + i, 1])
    return np.concatenate(out)


def _even_odd(e: np.ndarray, crossings: np.ndarray) -> np.ndarray:
    """Triangles of what lies inside by the even-odd rule: slabs between neighbouring heights, in which no sides cross."""
    ys, out = np.unique(np.concatenate([e[:, 1], e[:, 3], crossings])), []
    for y0, y1 in zip(ys[:-1], ys[1:]):
        mid = (y0 + y1) / 2
        on = e[(np.minimum(e[:, 1], e[:, 3]) < mid) & (np.maximum(e[:, 1], e[:, 3]) > mid)]
        at = lambda y, on=on: on[:, 0] + (y - on[:, 1]) * (on[:, 2] - on[:, 0]) / (on[:, 3] - on[:, 1])
        order = np.argsort(at(mid), kind="stable")
        low, high = at(y0)[order], at(y1)[order]
        for k in range(0, len(order) - 1, 2):
            a, b, c, d = (low[k], y0), (low[k + 1], y0), (high[k + 1], y1), (high[k], y1)
            out += [(*a, *b, *c)] * int(b[0] > a[0]) + [(*a, *c, *d)] * int(c[0] > d[0])
    return np.array(out, dtype=float).reshape(-1, 6)


def triangulate(rings: list) -> np.ndarray:
    """Ear clipping of a polygon with holes: an array (n, 6) of triangles ax ay bx by cx cy.

    The first ring is the outer one.  Rings of fewer than three different
    points, or without area, count as absent.  Of rings that cross themselves
    or each other, or whose triangles don't have the polygon's area, what is
    inside by the even-odd rule is cut into triangles.
    """
    rings = [_open(r) for r in rings or [] if r is not None]
    if not rings or len(rings[0]) < 3 or not np.ptp(rings[0], axis=0).all():
        return np.zeros((0, 6))
    rings = [rings[0], *(h for h in rings[1:] if len(h) >= 3)]
    e = _sides(rings)
    crossings = _crossings(e)
    if not len(crossings):
        t = _ears(rings)
        whole = (abs(_area2(rings[0])) - sum(abs(_area2(h)) for h in rings[1:])) / 2
        x, y = t[:, 0::2], t[:, 1::2]
        area = ((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (y[:, 1] - y[:, 0]) * (x[:, 2] - x[:, 0])).sum() / 2
        if abs(area - whole) <= 1e-6 * abs(_area2(rings[0])):
            return t
    return _even_odd(e, crossings)


def _ears(rings: list[np.ndarray]) -> np.ndarray:
    """The triangles of rings that don't cross."""
    if _area2(rings[0]) == 0:
        return np.zeros((0, 6))
    outer = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
    holes = [(h if _area2(h) < 0 else h[::-1]).tolist() for h in rings[1:] if len(h) >= 3 and _area2(h) != 0]
    pts = [tuple(p) for p in _bridged(outer.tolist(), holes)]
    idx, out = list(range(len(pts))), []
    i, idle = 0, 0
    while len(idx) > 3:
        n = len(idx)
        a, b, c = pts[idx[i - 1]], pts[idx[i % n]], pts[idx[(i + 1) % n]]
        s = _side(a, b, c)
        ear = s > 0
        if ear:
            lo_x, hi_x, lo_y, hi_y = min(a[0], b[0], c[0]), max(a[0], b[0], c[0]), min(a[1], b[1], c[1]), max(a[1], b[1], c[1])
            for j in idx:
                v = pts[j]
                if lo_x <= v[0] <= hi_x and lo_y <= v[1] <= hi_y and v != a and v != b and v != c and _side(a, b, v) >= 0 and _side(b, c, v) >= 0 and _side(c, a, v) >= 0:
                    ear = False
                    break
        if ear or s == 0 or idle > 2 * n:  # flat corners go; after a whole idle round a corner goes in any case
            if s > 0:
                out.append((*a, *b, *c))
            del idx[i % n]
            i, idle = max(i - 1, 0), 0
            i = i % len(idx)
        else:
            i, idle = (i + 1) % n, idle + 1
    a, b, c = (pts[j] for j in idx)
    if _side(a, b, c) > 0:
        out.append((*a, *b, *c))
    return np.array(out, dtype=float).reshape(-1, 6)


class TriangleTree:
    """A bounding-volume hierarchy over triangles, split at the median of the longer side; leaves hold up to eight."""

    LEAF = 8

    def __init__(self, tri: np.ndarray, region: np.ndarray):
        xs, ys = tri[:, 0::2], tri[:, 1::2]
        box = np.stack([xs.min(1), ys.min(1), xs.max(1), ys.max(1)], 1) if len(tri) else np.zeros((0, 4))
        order, boxes, left, lo, hi = np.arange(len(tri)), [], [], [], []
        todo = [(0, len(tri))] if len(tri) else []
        k = 0
        while k < len(todo):  # children of node k stand next to each other
            s, e = todo[k]
            b = box[order[s:e]]
            boxes.append((b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max()))
            lo.append(s), hi.append(e)
            if e - s > self.LEAF:
                axis = int(boxes[-1][3] - boxes[-1][1] > boxes[-1][2] - boxes[-1][0])
                mid = (s + e) // 2
                part = np.argsort(b[:, axis] + b[:, axis + 2], kind="stable")
                order[s:e] = order[s:e][part]
                left.append(len(todo))
                todo += [(s, mid), (mid, e)]
            else:
                left.append(-1)
            k += 1
        self.boxes, self.left = np.array(boxes).reshape(-1, 4), np.array(left, int)
        self.lo, self.hi = np.array(lo, int), np.array(hi, int)
        self.tri, self.region = tri[order], region[order]

    def regions(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, region) of the points in or on a triangle; several triangles of a region may repeat a pair."""
        if not len(self.boxes) or not len(x):
            return np.zeros(0, int), np.zeros(0, self.region.dtype)
        p, node = np.arange(len(x)), np.zeros(len(x), int)
        found_p, found_t = [], []
        while len(p):
            b = self.boxes[node]
            ok = (x[p] >= b[:, 0]) & (x[p] <= b[:, 2]) & (y[p] >= b[:, 1]) & (y[p] <= b[:, 3])
            p, node = p[ok], node[ok]
            leaf = self.left[node] < 0
            for k in range(self.LEAF):
                t = self.lo[node[leaf]] + k
                inside = t < self.hi[node[leaf]]
                q, t = p[leaf][inside], t[inside]
                ax, ay, bx, by, cx, cy = self.tri[t].T
                hit = np.ones(len(q), bool)
                for ux, uy, vx, vy in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)):
                    hit &= (vx - ux) * (y[q] - uy) - (vy - uy) * (x[q] - ux) >= 0
                found_p.append(q[hit]), found_t.append(t[hit])
            p, node = p[~leaf], self.left[node[~leaf]]
            p, node = np.concatenate([p, p]), np.concatenate([node, node + 1])
        return np.concatenate(found_p), self.region[np.concatenate(found_t)]


def triangles(polygons: DataFrame, region: str, rings: str = "rings") -> DataFrame:
    """``(region BIGINT, tri ARRAY<DOUBLE>)``: the triangles of every polygon, cut where the polygons are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tris = [], []
            for r, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = triangulate([[(p["x"], p["y"]) for p in ring if p and p["x"] is not None and p["y"] is not None] for ring in rs or [] if ring])
                ids += [r] * len(t)
                tris += t.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tris, pa.list_(pa.float64()))], ["region", "tri"])

    return polygons.where(F.col(region).isNotNull()).select(F.col(region).cast("bigint").alias("region"), F.col(rings).alias("rings")).mapInArrow(run, "region bigint, tri array<double>")


def _hits(tree: TriangleTree, ids, x, y) -> pd.DataFrame:
    p, r = tree.regions(x, y)
    return pd.DataFrame({"id": np.asarray(ids)[p], "x": x[p], "y": y[p], "region": r}).groupby(["id", "x", "y"], as_index=False, sort=False)["region"].min()


def regions_of_points(points: DataFrame, key: str, polygons: DataFrame, region: str, x: str = "x", y: str = "y", rings: str = "rings", broadcast_triangles: int = BROADCAST_TRIANGLES, tile_points: int = 200_000) -> DataFrame:
    """``(id, x, y, region)`` of every point that lies in a region; boundary points get the smallest region.

    Up to ``broadcast_triangles`` triangles (counted) the hierarchy is
    broadcast and the points are only mapped.  Beyond, triangles and points
    meet per tile of a grid, tiles of over ``tile_points`` points being salted.
    Points with unusable coordinates or NULL keys, and points in no region,
    give no row; repeated rows count once.
    """
    kind = points.schema[key].dataType.simpleString()
    schema = f"id {kind}, x double, y double, region bigint"
    p = points.where(usable(x, y) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    tris = triangles(polygons, region, rings)
    some = tris.limit(broadcast_triangles + 1).toPandas()
    if len(some) <= broadcast_triangles:
        shared = p.sparkSession.sparkContext.broadcast((np.array(some["tri"].tolist(), float).reshape(-1, 6), some["region"].to_numpy(dtype=np.int64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = TriangleTree(*shared.value)
            for b in batches:
                yield _hits(tree, b["id"].to_numpy(), b["x"].to_numpy(), b["y"].to_numpy())

        return p.mapInPandas(run, schema).groupBy("id", "x", "y").agg(F.min("region").alias("region"))

    xs, ys = [F.transform(F.array(*[F.lit(i) for i in k]), lambda i: F.element_at("tri", i)) for k in ((1, 3, 5), (2, 4, 6))]
    boxed = tris.select("region", "tri", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    tile = boxed.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] * 4 + 1e-9
    ix = lambda c: F.floor(F.col(c) / tile)
    keyed = p.withColumns({"tx": ix("x"), "ty": ix("y")})
    salts = keyed.groupBy("tx", "ty").count().select("tx", "ty", F.ceil(F.col("count") / tile_points).cast("bigint").alias("k"))
    left = keyed.join(salts, ["tx", "ty"]).withColumn("salt", F.pmod(F.xxhash64("id", "x", "y"), "k")).drop("k")
    right = (
        boxed.withColumn("tx", F.explode(F.sequence(ix("x0"), ix("x1")))).withColumn("ty", F.explode(F.sequence(ix("y0"), ix("y1"))))
        .join(salts, ["tx", "ty"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select("tx", "ty", "salt", "region", "tri")
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        tree = TriangleTree(np.array(b["tri"].tolist(), float).reshape(-1, 6), b["region"].to_numpy(dtype=np.int64))
        return _hits(tree, a["id"].to_numpy(), a["x"].to_numpy(), a["y"].to_numpy())

    keys = ["tx", "ty", "salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema).groupBy("id", "x", "y").agg(F.min("region").alias("region"))
