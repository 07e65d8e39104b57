"""Percentiles of very large columns by distributed multi-select.

``runs`` turns a table into sorted runs, one per input partition and group, in
map work only.  Runs are the mergeable state: those of several days or
partitions are combined by union.  With ``eps`` = 0 they hold every value and
the percentiles are exact; with ``eps`` > 0 a run keeps one value for each
``eps`` of its weight, and every percentile found is an element whose rank is
off by at most ``eps`` times the number of values.

``select`` then finds the elements of given ranks: every run proposes the
median of what is still possible in it, the weighted median of the proposals
becomes the pivot of its group, all runs count three ways (less, equal,
greater), and the range ruled out is discarded, until the element is found.
The runs stay where they are; a group's range is two values.  A round is one
pass over the runs, which counts against the pivot and at once proposes for
either side of it.  Once a quarter is left of what the runs hold, they are
written anew.  A hot group costs rounds, never a large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.plans.lineage import cut, drop_cut

#: Percentiles of groups that are looked for at a time (some 100 bytes each, broadcast); more groups are taken in parts.
STATES = 500_000
#: Rows that one task sorts at a time; a larger partition gives several runs per group.
RUN_ROWS = 2_000_000
_RUN = "grp bigint, measure string, vals array<double>, wts array<bigint>"


def _thin(v: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Every value, without weights, or for each ``eps`` of the weight the middle one with the weight of its stretch."""
    if not eps:
        return v, np.zeros(0, np.int64)
    size = max(1, int(2 * eps * len(v)))
    starts = np.arange(0, len(v), size)
    ends = np.minimum(starts + size, len(v))
    return v[(starts + ends - 1) // 2], (ends - starts).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _sorted_runs(batches: Iterator[pa.RecordBatch], measures: list[str], eps: float) -> Iterator[pa.RecordBatch]:
    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        grp = table.column(0).to_numpy()
        for i, m in enumerate(measures):
            v = table.column(i + 1).to_numpy(zero_copy_only=False)
            ok = ~np.isnan(v)
            g, x = grp[ok], v[ok]
            order = np.lexsort((x, g))
            g, x = g[order], x[order]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
            parts = [_thin(p, eps) for p in np.split(x, at[1:])] if len(g) else []
            for k in range(0, len(parts), 500):
                some = parts[k : k + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at[k : k + 500]], pa.int64()), pa.array([m] * len(some)), _lists([p for p, _ in some], pa.float64()), _lists([w for _, w in some], pa.int64())],
                    ["grp", "measure", "vals", "wts"],
                )

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN_ROWS:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


def runs(df: DataFrame, group: str, measures: list[str], eps: float = 0.0) -> DataFrame:
    """Sorted runs ``(grp, measure, vals, wts)`` of the values per group, made where the rows are.

    NULL and NaN don't count, nor do rows with a NULL group.
    Unions of runs, of any days or partitions, are runs again.
    """
    src = df.where(F.col(group).isNotNull()).select(F.col(group).cast("bigint").alias("g"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    return src.mapInArrow(lambda it: _sorted_runs(it, measures, eps), _RUN)


def _bisect(v: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For every slice of ``v`` where its value would go, before or behind equal ones."""
    lo, hi = start.copy(), end.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        up = v[mid] <= x[open_] if right else v[mid] < x[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


class _States:
    """The percentiles looked for in this round, by group and measure; sorted, so that a group's stand together."""

    def __init__(self, grp, measure, q, low, high, has_low, has_high, pivot):
        self.grp, self.measure, self.q, self.low, self.high, self.has_low, self.has_high, self.pivot = grp, measure, q, low, high, has_low, has_high, pivot

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(run, state) for every run of the batch and each percentile that is looked for in it."""
        grp, q = b.column("grp").to_numpy(), b.column("q").to_numpy(zero_copy_only=False)
        names = np.array(b.column("measure").to_pylist(), object)
        lo, hi = np.zeros(len(grp), np.int64), np.zeros(len(grp), np.int64)
        for m in set(names.tolist()):
            s, e = np.searchsorted(self.measure, m, "left"), np.searchsorted(self.measure, m, "right")
            mine = np.flatnonzero(names == m)
            lo[mine], hi[mine] = s + np.searchsorted(self.grp[s:e], grp[mine], "left"), s + np.searchsorted(self.grp[s:e], grp[mine], "right")
        n = hi - lo
        run = np.repeat(np.arange(len(grp)), n)
        state = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fits = np.isnan(q[run]) | (q[run] == self.q[state])  # a run written anew belongs to one percentile
        return run[fits], state[fits]

    def ranges(self, b: pa.RecordBatch):
        """Runs, states, the runs' values and weights before each of them, and the slices that are still possible."""
        run, state = self.of(b)
        off = b.column("vals").offsets.to_numpy().astype(np.int64)
        v, w = b.column("vals").flatten().to_numpy(), b.column("wts").flatten().to_numpy(zero_copy_only=False)
        off = off - off[0]
        if 0 < len(w) < len(v):  # runs without weights among others: each of their values counts once
            some = w
            w = np.ones(len(v), np.int64)
            w[np.repeat(np.diff(b.column("wts").offsets.to_numpy()) > 0, np.diff(off))] = some
        cum = np.concatenate([[0], np.cumsum(w)]) if len(w) else np.arange(len(v) + 1)
        s, e = off[run], off[run + 1]
        s = np.where(self.has_low[state], _bisect(v, s, e, self.low[state], True), s)
        e = np.where(self.has_high[state], _bisect(v, s, e, self.high[state], False), e)
        keep = e > s
        return run[keep], state[keep], v, w, cum, s[keep], e[keep]


_COUNTS = ["state", "less", "same", "below", "above", "mid_left", "w_left", "mid_right", "w_right"]


def _middle(v: np.ndarray, cum: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted median and the weight of every slice; of empty ones 0."""
    weight = cum[e] - cum[s]
    at = np.searchsorted(cum, cum[s] + (weight + 1) // 2, side="left") - 1
    return np.where(weight > 0, v[np.clip(at, 0, len(v) - 1)] if len(v) else 0.0, 0.0), weight


def _count(batches: Iterator[pa.RecordBatch], states: _States) -> Iterator[pa.RecordBatch]:
    """Three-way counts of every run against the pivots, the pivots' neighbours, and proposals for both sides."""
    for b in batches:
        run, state, v, _, cum, s, e = states.ranges(b)
        p = states.pivot[state]
        lo, eq = _bisect(v, s, e, p, False), _bisect(v, s, e, p, True)
        below = np.where(lo > s, v[np.maximum(lo - 1, 0)] if len(v) else 0.0, -np.inf)
        above = np.where(eq < e, v[np.minimum(eq, max(len(v) - 1, 0))] if len(v) else 0.0, np.inf)
        cols = [state, cum[lo] - cum[s], cum[eq] - cum[lo], below, above, *_middle(v, cum, s, lo), *_middle(v, cum, eq, e)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _COUNTS)


def _propose(batches: Iterator[pa.RecordBatch], states: _States) -> Iterator[pa.RecordBatch]:
    """The first proposals: the medians of whole runs."""
    for b in batches:
        run, state, v, _, cum, s, e = states.ranges(b)
        nothing = np.zeros(len(state), np.int64)
        ends = np.full(len(state), np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (state, nothing, nothing, -ends, ends, np.zeros(len(state)), nothing, *_middle(v, cum, s, e))], _COUNTS)


def _narrow(batches: Iterator[pa.RecordBatch], states: _States) -> Iterator[pa.RecordBatch]:
    """The runs' slices that are still possible, each for one percentile."""
    for b in batches:
        run, state, v, w, _, s, e = states.ranges(b)
        some = pa.array(run)
        yield pa.RecordBatch.from_arrays(
            [b.column("grp").take(some), b.column("measure").take(some), pa.array(states.q[state]),
             _lists([v[i:j] for i, j in zip(s, e)], pa.float64()), _lists([w[i:j] if len(w) else w for i, j in zip(s, e)], pa.int64())],
            ["grp", "measure", "q", "vals", "wts"],
        )


def _part(held: DataFrame, totals: pd.DataFrame, quantiles: list[float]) -> pd.DataFrame:
    """(grp, measure, q, n, value) of the groups in ``totals``, whose runs are ``held``."""
    context, own = held.sparkSession.sparkContext, None
    st = totals.merge(pd.DataFrame({"q": [float(q) for q in dict.fromkeys(quantiles)]}), how="cross")
    position = st.q * (st.n - 1)
    st["rank"], st["part"] = np.floor(position).astype(np.int64), position - np.floor(position)
    st["left"], st["low"], st["high"], st["has_low"], st["has_high"] = st.n, 0.0, 0.0, False, False
    st["mid"], st["value"], st["upper"] = np.nan, np.nan, np.nan
    st = st.sort_values(["measure", "grp", "q"], ignore_index=True)
    done, size = [], int(st.n.sum() // max(1, len(set(quantiles))))

    def run(step, kind: str) -> DataFrame:
        shared = context.broadcast(_States(*(st[c].to_numpy() for c in ("grp", "measure", "q", "low", "high", "has_low", "has_high", "mid"))))
        return held.mapInArrow(lambda it: step(it, shared.value), kind)

    first = True
    while len(st):
        rows = run(_propose if first else _count, "state bigint, less bigint, same bigint, below double, above double, mid_left double, w_left bigint, mid_right double, w_right bigint")
        got = rows.groupBy("state").agg(
            F.sum("less").alias("less"), F.sum("same").alias("same"), F.max("below").alias("below"), F.min("above").alias("above"),
            F.expr("percentile(mid_left, 0.5, w_left)").alias("pl"), F.expr("percentile(mid_right, 0.5, w_right)").alias("pr"),
        ).toArrow().to_pandas().set_index("state")
        st = st.join(got)
        if not first:
            le = st.less + st.same
            hit = (st["rank"] >= st.less) & (st["rank"] < le)
            edge = (st["rank"] == st.less - 1) & (st.part > 0)  # the largest of the lesser ones, and the next element is the pivot or above it
            above = np.where(np.isfinite(st.above) | ~st.has_high, st.above, st.high)
            here = np.where(hit, st.mid, st.below)
            over = np.where(hit, np.where(st["rank"] + 1 < le, st.mid, above), np.where(st.same > 0, st.mid, above))
            ended = hit | edge
            end = st[ended].copy()
            with np.errstate(invalid="ignore"):
                end["value"] = here[ended] + np.where((end.part > 0) & (over[ended] != here[ended]), (over[ended] - here[ended]) * end.part, 0.0)
            done.append(end[["grp", "measure", "q", "n", "value"]])
            down = st["rank"] < st.less
            # the range ruled out goes; its bound is an element, or the pivot where that is none
            high = np.where(st.same > 0, st.mid, above)
            st["high"], st["has_high"] = np.where(down, high, st.high), st.has_high | down
            low = np.where(st.same > 0, st.mid, st.below)
            st["low"], st["has_low"] = np.where(down, st.low, low), st.has_low | ~down
            st["left"], st["rank"] = np.where(down, st.less, st.left - le), np.where(down, st["rank"], st["rank"] - le)
            st["mid"] = np.where(down, st.pl, st.pr)
            st = st[~ended]
        else:
            st["mid"] = st.pr
        st = st.drop(columns=["less", "same", "below", "above", "pl", "pr"]).reset_index(drop=True)
        st["mid"] = st.mid.fillna(0.0)  # between the two infinities
        first = False
        if len(st) and st.left.sum() * 4 <= size and size > 100_000:
            narrowed = cut(run(_narrow, "grp bigint, measure string, q double, vals array<double>, wts array<bigint>"))
            if own is not None:
                drop_cut(own)
            held = own = narrowed
            size = int(st.left.sum())
    return pd.concat(done, ignore_index=True)


def select(run_table: DataFrame, quantiles: list[float], least: int = 1, states: int = STATES) -> DataFrame:
    """``(grp, measure, q, n, value)`` for every group with at least ``least`` values: percentiles with linear interpolation between ranks.

    Exact over exact runs.  Groups without values give no row; equal values
    are one step of the search, however many there are.  Beyond ``states``
    percentiles the groups are taken in parts, by hash, each with runs of its own.
    """
    spark = run_table.sparkSession
    weight = F.when(F.size("wts") > 0, F.aggregate("wts", F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.size("vals").cast("bigint"))
    held = cut(run_table.select("grp", "measure", F.lit(None).cast("double").alias("q"), "vals", "wts"))
    totals = cut(held.groupBy("grp", "measure").agg(F.sum(weight).alias("n")).where(F.col("n") >= least))
    parts = max(1, -(-totals.count() * len(quantiles) // states))
    if parts > 1:
        by = F.pmod(F.xxhash64("grp", "measure"), F.lit(parts)).alias("part")
        held, whole = cut(held.select("*", by), by=["part"]), held
        totals = totals.select("*", by)
        drop_cut(whole)
    kind, out = "grp bigint, measure string, q double, n bigint, value double", None
    for k in range(parts):
        mine = totals.where(F.col("part") == k).drop("part").toArrow().to_pandas() if parts > 1 else totals.toArrow().to_pandas()
        if len(mine):
            found = _part(held.where(F.col("part") == k).drop("part") if parts > 1 else held, mine, quantiles)
            table = cut(spark.createDataFrame(pa.Table.from_pandas(found, preserve_index=False), kind))
            out = table if out is None else out.unionByName(table)
    return spark.createDataFrame([], kind) if out is None else out
