"""Searches on the directed network, and its components.

The network is broadcast in compressed rows while it has at most ``MAX_EDGES``
edges (counted); sources are spread over tasks.  A task searches from a block
of sources at a time: frontiers of all of them are relaxed together by array
operations, nearest first (delta stepping), and each touches only what it
reaches within the limit.  Larger networks take the relational twins, which
relax frontiers by joins: the functions choose by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.operators.nearness import pairs_within
from strideflow.plans.lineage import cut, drop_cut

#: Edges up to which the network is broadcast (some 36 bytes each).
MAX_EDGES = 20_000_000
#: Places of (source, node) that one block of sources has (16 bytes each).
BLOCK = 4_000_000
#: Places that a block of sources should reach, and may reach, where only what is reached has room.
FEW, MOST = 250_000, 1_000_000


class Tree:
    """What a block of sources reaches: by source and then by seconds."""

    def __init__(self, key: np.ndarray, nodes: int, seconds: np.ndarray, edge: np.ndarray, parent: np.ndarray, place: Callable[[np.ndarray], np.ndarray]):
        self.key, self.nodes, self.seconds, self.edge, self.parent = key, nodes, seconds, edge, parent
        self.source, self.node = np.divmod(key, max(nodes, 1))
        self._place = place  # by key; what isn't reached has any place

    def along(self, values: np.ndarray) -> np.ndarray:
        """The sum of the edges' values on the way to each place, by pointer jumping."""
        if not len(values) or not len(self.key):
            return np.zeros(len(self.key), values.dtype)
        return self._summed(np.where(self.edge >= 0, values[self.edge], 0))

    def _summed(self, total: np.ndarray) -> np.ndarray:
        up = self.parent
        while True:
            higher = up[up]
            if (higher == up).all():
                return total
            total, up = total + total[up], higher

    def pushed(self, load: np.ndarray) -> np.ndarray:
        """Loads of the places, each added to all places on its way back: the farthest first."""
        depth = self._summed((self.edge >= 0).astype(np.int64))
        order = np.argsort(-depth, kind="stable")
        load, at = load.copy(), 0
        for end in np.searchsorted(-depth[order], -np.arange(int(depth.max()) if len(depth) else 0, 0, -1), "right").tolist():
            k = order[at:end]
            np.add.at(load, self.parent[k], load[k])
            at = end
        return load

    def find(self, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Places of (source, node), -1 where it isn't reached. Only before the next search."""
        if not len(self.key):
            return np.full(len(source), -1)
        key = source.astype(np.int64) * self.nodes + np.maximum(node, 0)
        at = np.minimum(self._place(key), len(self.key) - 1)
        return np.where((node >= 0) & (self.key[at] == key), at, -1)


class _Room:
    """Seconds and edges of all places of a block, by key."""

    def __init__(self, need: int):
        self.seconds, self.edge, self.place = np.full(need, np.inf), np.full(need, -1, np.int32), np.zeros(need, np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.seconds[key]

    def put(self, key: np.ndarray, seconds: np.ndarray, edge: np.ndarray) -> None:
        self.touched.append(key[np.isinf(self.seconds[key])])
        self.seconds[key], self.edge[key] = seconds, edge

    def begin(self) -> None:
        self.touched = []

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.concatenate(self.touched)
        seconds, edge = self.seconds[key], self.edge[key]
        self.seconds[key] = np.inf  # the room is as before for the next search
        return key, seconds, edge

    def placed(self, key: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        self.place[key] = np.arange(len(key))
        return lambda k: self.place[k]


class _Reached:
    """The same of what is reached only, in the order of the keys: for sources that reach few of many nodes."""

    def begin(self) -> None:
        self.key, self.seconds, self.edge = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)

    def _at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, key)
        k = np.minimum(at, len(self.key) - 1)
        return at, self.key[k] == key if len(self.key) else np.zeros(len(key), bool)

    def of(self, key: np.ndarray) -> np.ndarray:
        at, known = self._at(key)
        out = np.full(len(key), np.inf)
        out[known] = self.seconds[at[known]]
        return out

    def put(self, key: np.ndarray, seconds: np.ndarray, edge: np.ndarray) -> None:
        at, known = self._at(key)
        self.seconds[at[known]], self.edge[at[known]] = seconds[known], edge[known]
        at, new = at[~known], ~known
        if len(at):
            self.key, self.seconds, self.edge = np.insert(self.key, at, key[new]), np.insert(self.seconds, at, seconds[new]), np.insert(self.edge, at, edge[new])

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.key, self.seconds, self.edge

    def placed(self, key: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        order = np.argsort(key)
        by_key = key[order]
        return lambda k: order[np.minimum(np.searchsorted(by_key, k), len(order) - 1)]


class Graph:
    """Compressed rows over the node ids that occur."""

    def __init__(self, u: np.ndarray, v: np.ndarray, seconds: np.ndarray, metres: np.ndarray, link: np.ndarray, direction: np.ndarray):
        self.ids = np.union1d(u, v)
        a, b = np.searchsorted(self.ids, u).astype(np.int32), np.searchsorted(self.ids, v).astype(np.int32)
        order = np.lexsort((link, b, a))
        self.tail, self.head = a[order], b[order]
        self.seconds, self.metres, self.link, self.direction = seconds[order], metres[order], link[order], direction[order]
        self.first = np.searchsorted(self.tail, np.arange(len(self.ids) + 1))
        self.step = float(np.mean(self.seconds)) * 2 if len(u) else 1.0
        self._room, self._reach = None, FEW / 64

    def __getstate__(self):
        return self.__dict__ | {"_room": None, "_reach": FEW / 64}

    def indexes(self, nodes: np.ndarray) -> np.ndarray:
        """Positions of node ids, -1 where the network lacks them."""
        if not len(self.ids):
            return np.full(len(nodes), -1)
        i = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[i] == nodes, i, -1)

    def trees(self, roots: np.ndarray, limit: float = np.inf) -> Iterator[tuple[int, int, Tree]]:
        """Ranges of sources that are searched together, each with its tree; a root of -1 reaches nothing.

        While there is a limit and the sources before reached few nodes within
        it, blocks are large and hold what is reached; else they are as many as
        all of their places have room for.
        """
        whole, i = int(max(1, min(BLOCK // max(1, len(self.ids)), 4096))), 0
        while i < len(roots):
            few = int(min(4096, FEW // self._reach)) if limit < np.inf else 0  # without a limit there are many rounds, and each would move what is reached
            j = min(len(roots), i + max(few, whole))
            starts = np.flatnonzero(roots[i:j] >= 0)
            t = self.search(roots[i:j][starts], limit, starts, MOST if few > whole else None)
            if t is None:  # more than it may: again with fewer sources
                self._reach *= 8
                continue
            self._reach = max(len(t.key) / (j - i), self._reach / 4, 1.0)
            yield i, j, t
            i = j

    def search(self, roots: np.ndarray, limit: float = np.inf, starts: np.ndarray | None = None, most: int | None = None) -> Tree | None:
        """Least seconds from every root by itself, in one block; with ``starts`` the sources' numbers, several roots may be one source.

        The limit is inclusive.  Of equally quick ways the one over the first
        edge in the order of ends and link ids counts.  With ``most`` only what
        is reached has room; beyond so many places there is no tree.
        """
        n = len(self.ids)
        starts = np.arange(len(roots)) if starts is None else starts
        if most is None:
            need = (int(starts.max()) + 1) * n if len(starts) else 0
            if self._room is None or len(self._room.seconds) < need:
                self._room = _Room(need)
            room = self._room
        else:
            room = _Reached()
        room.begin()
        pending = np.unique(starts.astype(np.int64) * n + roots)
        room.put(pending, np.zeros(len(pending)), np.full(len(pending), -1, np.int32))
        while len(pending):
            near = room.of(pending)
            now = near <= near.min() + self.step
            keys, pending, near = pending[now], pending[~now], near[now]
            node = keys % n
            count = self.first[node + 1] - self.first[node]
            e = np.repeat(self.first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            reach = np.repeat(near, count) + self.seconds[e]
            within = np.flatnonzero(reach <= limit)
            reach, e = reach[within], e[within]
            to = np.repeat(keys - node, count)[within] + self.head[e]
            better = np.flatnonzero(reach < room.of(to))
            if not len(better):
                continue
            to, reach, e = to[better], reach[better], e[better]
            order = np.lexsort((e, reach, to))
            to, reach, e = to[order], reach[order], e[order]
            fresh = np.concatenate([[True], to[1:] != to[:-1]])
            to = to[fresh]
            room.put(to, reach[fresh], e[fresh])
            if most is not None and len(room.key) > most:
                return None
            pending = np.union1d(pending, to) if len(pending) else to
        at, seconds, by = room.end()
        order = np.lexsort((at, seconds, at // max(n, 1)))
        at, seconds, by = at[order], seconds[order], by[order].astype(np.int64)
        place = room.placed(at)
        parent = np.arange(len(at))
        on = np.flatnonzero(by >= 0)
        parent[on] = place(at[on] // n * n + self.tail[by[on]]) if len(on) else 0
        return Tree(at, n, seconds, by, parent, place)


def collect_graph(edges: DataFrame) -> Graph:
    """The network on the driver; callers have checked its size."""
    e = edges.select("u", "v", "travel_time_s", "length_m", "link_id", F.col("direction").cast("int").alias("direction")).toArrow()
    columns = [e.column(c).to_numpy() for c in ("u", "v", "travel_time_s", "length_m", "link_id", "direction")]
    del e  # the columns are copies; the driver needn't hold both
    return Graph(*columns)


_shared: list[DataFrame] = []


def shared_graph(edges: DataFrame) -> Broadcast:
    """The network's broadcast, once for all searches on one table; of the table before it is let go."""
    if getattr(edges, "_graph", None) is None:
        while _shared:
            _shared.pop()._graph = None
        _shared.append(edges)
        edges._graph = edges.sparkSession.sparkContext.broadcast(collect_graph(edges))
    return edges._graph


def fits(edges: DataFrame, most: int) -> bool:
    """Whether the network may be broadcast."""
    return edges.limit(most + 1).count() <= most


def _spread(sources: DataFrame) -> DataFrame:
    """The sources in as many partitions as there is work for, whatever their few bytes suggest."""
    return sources.repartition(_tasks(sources), F.xxhash64(sources.columns[0]))


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    """Columns of their kinds; None and a text stand for a column of nothing else."""
    n = len(columns["value"])
    return pa.RecordBatch.from_arrays([pa.nulls(n, kinds[k]) if c is None else pa.repeat(c, n) if isinstance(c, str) else pa.array(c, kinds[k]) for k, c in columns.items()], list(columns))


def od_matrix(edges: DataFrame, sources: DataFrame, limit: float, most: int = MAX_EDGES, targets: DataFrame | None = None) -> DataFrame:
    """``(origin, destination, seconds, metres)`` from every source (``node_id``) to all nodes, or ``targets`` (``node_id``), within ``limit`` seconds; metres along the fastest way."""
    if not fits(edges, most):
        tree = relational_tree(edges, sources, limit).select("origin", "destination", "seconds", "metres")
        return tree if targets is None else tree.join(targets.select(F.col("node_id").alias("destination")).distinct(), "destination", "left_semi").select(tree.columns)
    network, asked = shared_graph(edges), None
    if targets is not None:  # one flag for each node of the network
        asked = np.zeros(len(network.value.ids), bool)
        at = network.value.indexes(targets.select("node_id").where("node_id is not null").join(edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi").distinct().toArrow().column(0).to_numpy())
        asked[at] = True
    flags = edges.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, asked = network.value, flags.value
        for b in batches:
            nodes = b.column(0).to_numpy()
            at = g.indexes(nodes)
            nodes, at = nodes[at >= 0], at[at >= 0]
            for i, j, t in g.trees(at, limit):
                k = slice(None) if asked is None else np.flatnonzero(asked[t.node])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i:j][t.source[k]]), pa.array(g.ids[t.node[k]]), pa.array(t.seconds[k]), pa.array(t.along(g.metres)[k])], ["origin", "destination", "seconds", "metres"])

    return _spread(sources.select("node_id").where("node_id is not null").distinct()).mapInArrow(run, "origin bigint, destination bigint, seconds double, metres double")


def least_cost(edges: DataFrame, sources: DataFrame, limit: float, most: int = MAX_EDGES) -> DataFrame:
    """``(destination, seconds)`` from the nearest of all sources: one search from all of them at once."""
    if not fits(edges, most):
        return relational_tree(edges, sources, limit, together=True).select("destination", "seconds")
    shared = shared_graph(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        roots = [g.indexes(b.column(0).to_numpy()) for b in batches]
        roots = np.concatenate(roots) if roots else np.zeros(0, np.int64)
        roots = roots[roots >= 0]
        t = g.search(roots, limit, np.zeros(len(roots), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[t.node]), pa.array(t.seconds)], ["destination", "seconds"])

    # sources are nodes of the network, so one task holds no more than the network
    return sources.select("node_id").where("node_id is not null").distinct().coalesce(1).mapInArrow(run, "destination bigint, seconds double")


_PATH = "origin bigint, destination bigint, left int, link_id bigint, direction int, u bigint, v bigint"


def paths(edges: DataFrame, pairs: DataFrame, limit: float, most: int = MAX_EDGES) -> DataFrame:
    """``(origin, destination, left, link_id, direction, u, v)``: the edges of the fastest way of every pair, ``left`` counting those still to go."""
    wanted = pairs.select("origin", "destination").where("origin is not null and destination is not null").distinct()
    if not fits(edges, most):
        return relational_paths(edges, wanted, limit).select("origin", "destination", "left", "link_id", "direction", "u", "v")
    shared = shared_graph(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for origins, dest, _, first in _by_origin(batches):
            roots = g.indexes(origins)
            for i, j, t in g.trees(roots, limit):
                d = dest[first[i] : first[j]]
                owner = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                use = roots[i:j][owner] >= 0
                d, owner = d[use], owner[use]
                place = t.find(owner, g.indexes(d))
                on = np.flatnonzero((place >= 0))
                place, o, d, left = place[on], origins[i:j][owner[on]], d[on], 0
                while len(place):  # all ways one edge at a time
                    go = t.edge[place] >= 0
                    place, o, d = place[go], o[go], d[go]
                    e = t.edge[place]
                    cols = [o, d, np.full(len(o), left, np.int32), g.link[e], g.direction[e], g.ids[g.tail[e]], g.ids[g.head[e]]]
                    if len(o):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["origin", "destination", "left", "link_id", "direction", "u", "v"])
                    place, left = t.parent[place], left + 1

    return _sorted_by_origin(wanted).mapInArrow(run, _PATH)


def _sorted_by_origin(pairs: DataFrame) -> DataFrame:
    """Pairs with an origin's rows together in one task, whatever their number: they are read in blocks, never gathered in a list."""
    return _spread(pairs).sortWithinPartitions("origin", "destination")


#: Pairs that a task holds at a time.
PAIRS = 500_000


def _by_origin(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """(origins, destinations, values, where each origin's begin) of sorted rows, some hundred thousand pairs at a time; an origin may come in several parts."""
    held, n = [], 0

    def made(held):
        t = pa.Table.from_batches(held)
        o, d = t.column(0).to_numpy(), t.column(1).to_numpy()
        w = t.column(2).to_numpy() if t.num_columns > 2 else None
        at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        return o[at], d, w, np.append(at, len(o))

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PAIRS:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


_TREE = ["origin", "destination", "seconds", "metres", "u", "link_id", "direction"]


def relational_tree(edges: DataFrame, sources: DataFrame, limit: float, rounds: int | None = None, together: bool = False) -> DataFrame:
    """``(origin, destination, seconds, metres, u, link_id, direction)``: the search by frontier relaxation with joins, with the last edge of every way.

    No broadcast of the network; sources that it lacks reach nothing.  With ``together`` all sources are one, with
    NULL as origin.  The rounds end when no row gets better.  That takes at most
    as many as the network has nodes, unless a cycle's time is below zero;
    beyond ``rounds``, by default that number, it raises.
    """
    origin = F.lit(0).cast("bigint") if together else F.col("node_id")
    nothing = lambda t: F.lit(None).cast(t)
    known = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    best = cut(sources.where("node_id is not null").join(known, "node_id", "left_semi").select(origin.alias("origin"), F.col("node_id").alias("destination"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("metres"), nothing("bigint").alias("u"), nothing("bigint").alias("link_id"), nothing("int").alias("direction")).distinct())
    front = best
    step = edges.select(F.col("u").alias("destination"), "v", "travel_time_s", "length_m", F.col("link_id").alias("l"), F.col("direction").cast("int").alias("d"))
    done = 0
    while True:
        reached = front.join(step, "destination").select(
            "origin", F.col("v").alias("destination"),
            F.struct((F.col("seconds") + F.col("travel_time_s")).alias("seconds"), F.col("destination").alias("u"), F.col("l").alias("link_id"), F.col("d").alias("direction"), (F.col("metres") + F.col("length_m")).alias("metres")).alias("way"),
        ).where(F.col("way.seconds") <= limit)
        new = reached.groupBy("origin", "destination").agg(F.min("way").alias("way"))
        better = F.col("seconds").isNull() | (F.col("way.seconds") < F.col("seconds"))
        take = lambda c: F.when(better, F.col(f"way.{c}")).otherwise(F.col(c)).alias(c)
        both = cut(best.join(new, ["origin", "destination"], "full_outer").select("origin", "destination", *[take(c) for c in _TREE[2:]], F.coalesce(better, F.lit(False)).alias("better")))
        drop_cut(best)
        best, front = both.drop("better"), both.where("better").drop("better")
        best._cut_path = both._cut_path
        if both.where("better").isEmpty():
            return best
        done += 1
        if rounds is None and done == 200:  # counted only where the ways are long
            rounds = edges.select(F.explode(F.array("u", "v")).alias("n")).distinct().count()
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"ways still get better after {done} rounds")


def relational_matrix(edges: DataFrame, sources: DataFrame, limit: float, rounds: int | None = None) -> DataFrame:
    """The seconds of :func:`od_matrix` by joins alone."""
    return relational_tree(edges, sources, limit, rounds).select("origin", "destination", "seconds")


def relational_paths(edges: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """:func:`paths` by joins alone, with ``seconds`` and ``metres`` of the whole way: all ways are walked back together, one edge a round."""
    tree = cut(relational_tree(edges, pairs.select(F.col("origin").alias("node_id")).distinct(), limit))
    at = cut(pairs.join(tree.select("origin", "destination", F.col("metres").alias("whole")), ["origin", "destination"]).select("origin", "destination", F.col("destination").alias("v"), "whole"))
    left, out = 0, None
    back = tree.where("link_id is not null").select("origin", F.col("destination").alias("v"), "u", "link_id", "direction")
    while True:
        step = cut(at.join(back, ["origin", "v"]).select("origin", "destination", F.lit(left).alias("left"), "link_id", "direction", "u", "v", "whole"))
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            return out
        at, left = step.where("u <> origin").select("origin", "destination", F.col("u").alias("v"), "whole"), left + 1


_ASSIGNED = "kind string, link_id bigint, direction int, origin bigint, destination bigint, value double"
_KINDS = {"kind": pa.string(), "link_id": pa.int64(), "direction": pa.int32(), "origin": pa.int64(), "destination": pa.int64(), "value": pa.float64()}


def assign(edges: DataFrame, demand: DataFrame, limit: float, selected: list[int] | None = None, most: int = MAX_EDGES, kinds: tuple[str, ...] = ("volume", "length", "missed", "via")) -> DataFrame:
    """All-or-nothing assignment: rows ``(kind, link_id, direction, origin, destination, value)``.

    ``demand`` (``origin``, ``destination``, ``demand``) by nodes; what isn't
    above zero is dropped, what stays in its node is neither loaded nor missed.
    ``kind`` is ``volume`` (per edge and task, to be added up), ``length`` (per
    pair, metres along its way) or ``missed`` (per pair, its demand).  With
    ``selected`` link ids only the pairs whose way uses one of them are loaded,
    and they come as ``via`` with their demand.  Only rows of ``kinds`` are made.
    """
    loaded = demand.where("demand > 0 and origin <> destination").select("origin", "destination", "demand")
    if not fits(edges, most):
        return _relational_assign(edges, loaded.groupBy("origin", "destination").agg(F.sum("demand").alias("demand")), limit, selected).where(F.col("kind").isin(*kinds))
    # an origin's rows move once: they are added up where they are searched from
    wanted = loaded.repartition(_tasks(edges), "origin").groupBy("origin", "destination").agg(F.sum("demand").alias("demand"))
    network, chosen = shared_graph(edges), edges.sparkSession.sparkContext.broadcast(None if selected is None else np.array(sorted(set(selected)), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = network.value
        flow = np.zeros(len(g.head))
        hit = None if chosen.value is None else np.isin(g.link, chosen.value).astype(np.int64)

        def rows(kind: str, o, d, x) -> pa.RecordBatch:
            return _batch({"kind": kind, "link_id": None, "direction": None, "origin": o, "destination": d, "value": x}, _KINDS)

        for origins, dest, amount, first in _by_origin(batches):
            roots = g.indexes(origins)
            for i, j, t in g.trees(roots, limit):
                d, x = dest[first[i] : first[j]], amount[first[i] : first[j]]
                owner = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                place = np.full(len(d), -1)
                use = np.flatnonzero(roots[i:j][owner] >= 0)
                place[use] = t.find(owner[use], g.indexes(d[use]))
                o, lost = origins[i:j][owner], place < 0
                if "missed" in kinds and lost.any():
                    yield rows("missed", o[lost], d[lost], x[lost])
                if lost.all():
                    continue
                o, d, x, place = o[~lost], d[~lost], x[~lost], place[~lost]
                if "length" in kinds:
                    yield rows("length", o, d, t.along(g.metres)[place])
                if hit is not None:
                    via = t.along(hit)[place] > 0
                    o, d, x, place = o[via], d[via], x[via], place[via]
                    if "via" in kinds:
                        yield rows("via", o, d, x)
                if "volume" not in kinds:
                    continue
                load = t.pushed(np.bincount(place, x, len(t.node)))
                on = t.edge >= 0
                np.add.at(flow, t.edge[on], load[on])
        used = np.flatnonzero(flow)
        yield _batch({"kind": "volume", "link_id": g.link[used], "direction": g.direction[used], "origin": g.ids[g.tail[used]], "destination": g.ids[g.head[used]], "value": flow[used]}, _KINDS)

    return wanted.sortWithinPartitions("origin", "destination").mapInArrow(run, _ASSIGNED)


def _relational_assign(edges: DataFrame, wanted: DataFrame, limit: float, selected: list[int] | None) -> DataFrame:
    """The rows of :func:`assign` by joins alone; volumes are whole sums."""
    wanted = cut(wanted)
    ways = cut(relational_paths(edges, wanted.select("origin", "destination"), limit))
    served = ways.where("left = 0")
    row = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("link_id"), F.lit(None).cast("int").alias("direction"), "origin", "destination", F.col(value).alias("value"))
    out = row(wanted.join(served, ["origin", "destination"], "left_anti"), "missed", "demand").unionByName(row(served, "length", "whole"))
    if selected is not None:
        chosen = edges.sparkSession.createDataFrame([(int(k),) for k in set(selected)], "link_id bigint")
        via = cut(wanted.join(ways.join(F.broadcast(chosen), "link_id", "left_semi").select("origin", "destination").distinct(), ["origin", "destination"]))
        out, wanted = out.unionByName(row(via, "via", "demand")), via
    loaded = ways.join(wanted, ["origin", "destination"]).groupBy("link_id", "direction", "u", "v").agg(F.sum("demand").alias("value"))
    return out.unionByName(loaded.select(F.lit("volume").alias("kind"), "link_id", "direction", F.col("u").alias("origin"), F.col("v").alias("destination"), "value"))


def link_volumes(assigned: DataFrame) -> DataFrame:
    """``(link_id, direction, u, v, volume)`` over all tasks."""
    return assigned.where("kind = 'volume'").groupBy("link_id", "direction", F.col("origin").alias("u"), F.col("destination").alias("v")).agg(F.sum("value").alias("volume"))


def zone_sums(edges: DataFrame, points: DataFrame, limit: float, rate: float | None = None, most: int = MAX_EDGES) -> DataFrame:
    """``(origin, destination, den, num, length, logs)`` over the pairs of access points that reach each other within ``limit``.

    ``points`` (``zone``, ``node_id``, ``weight``, ``access_s``, and where
    wanted ``access_m``); ``den`` is the sum of the pairs' weights, ``num`` and
    ``length`` that of the weighted seconds and metres with both access legs,
    ``logs`` that of the weighted exp(-``rate`` · seconds), NULL without a rate.
    A point's pair with itself is left out.  Pairs of points never leave a task.
    """
    spark = edges.sparkSession
    access_m = F.col("access_m") if "access_m" in points.columns else F.lit(0.0)
    listed = points.where("node_id is not null").select("zone", "node_id", F.col("weight").cast("double"), F.col("access_s").cast("double"), access_m.cast("double").alias("access_m"))
    if not fits(edges, most) or not fits(listed, most):
        return _relational_zone_sums(edges, listed, limit, rate)
    network, p = shared_graph(edges), listed.toArrow()
    graph = network.value
    node = graph.indexes(p.column("node_id").to_numpy())
    zones, zone = np.unique(p.column("zone").to_numpy(), return_inverse=True)
    order = np.argsort(node, kind="stable")
    order = order[node[order] >= 0]
    begin = np.searchsorted(node[order], np.arange(len(graph.ids) + 1))
    shared = spark.sparkContext.broadcast((zones, zone[order], *(p.column(c).to_numpy()[order] for c in ("weight", "access_s", "access_m")), begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (zones, zone, weight, access, access_m, begin) = network.value, shared.value
        for b in batches:
            roots = g.indexes(b.column(0).to_numpy())
            roots = roots[roots >= 0]
            for i, j, t in g.trees(roots, limit):
                metres = t.along(g.metres)
                # each reached place with the points that stand there, then with the points at its source
                place, target = _expand(np.arange(len(t.node)), begin[t.node], begin[t.node + 1])
                home = roots[i:j][t.source[place]]
                k, own = _expand(np.arange(len(place)), begin[home], begin[home + 1])
                place, target = place[k], target[k]
                other = (t.node[place] != home[k]) | (zone[own] != zone[target])
                place, target, own = place[other], target[other], own[other]
                if not len(place):  # sums of nothing would be integers, which the batches' schema isn't
                    continue
                w = weight[own] * weight[target]
                s = t.seconds[place] + access[own] + access[target]
                m = metres[place] + access_m[own] + access_m[target]
                key, inverse = np.unique(zone[own].astype(np.int64) * len(zones) + zone[target], return_inverse=True)
                total = lambda x: np.bincount(inverse, x, len(key))
                logs = total(w * np.exp(-rate * s)) if rate is not None else np.zeros(len(key))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (zones[key // len(zones)], zones[key % len(zones)], total(w), total(w * s), total(w * m), logs)], ["origin", "destination", "den", "num", "length", "logs"])

    parts = _spread(listed.select("node_id").distinct()).mapInArrow(run, "origin bigint, destination bigint, den double, num double, length double, logs double")
    return parts.groupBy("origin", "destination").agg(*[F.sum(c).alias(c) for c in ("den", "num", "length", "logs")])


def _expand(items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, position) for every position of the items' ranges."""
    n = hi - lo
    return np.repeat(items, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _relational_zone_sums(edges: DataFrame, listed: DataFrame, limit: float, rate: float | None) -> DataFrame:
    m = relational_tree(edges, listed.select("node_id").distinct(), limit)
    end = lambda k, zone: listed.select(F.col("node_id").alias(k), F.col("zone").alias(zone), *[F.col(c).alias(f"{c}_{k[0]}") for c in ("weight", "access_s", "access_m")])
    both = m.withColumnsRenamed({"origin": "a_node", "destination": "b_node"}).join(end("a_node", "origin"), "a_node").join(end("b_node", "destination"), "b_node").where("not (a_node = b_node and origin = destination)")
    w, s = F.col("weight_a") * F.col("weight_b"), F.col("seconds") + F.col("access_s_a") + F.col("access_s_b")
    return both.groupBy("origin", "destination").agg(
        F.sum(w).alias("den"), F.sum(w * s).alias("num"), F.sum(w * (F.col("metres") + F.col("access_m_a") + F.col("access_m_b"))).alias("length"),
        (F.sum(w * F.exp(-rate * s)) if rate is not None else F.lit(0.0)).alias("logs"),
    )


def zone_matrix(edges: DataFrame, points: DataFrame, limit: float, least_fraction: float = 0.0, rate: float | None = None, metres: bool = False, most: int = MAX_EDGES) -> DataFrame:
    """``(origin, destination, seconds, fraction)``, on request also ``metres``, between zones given by weighted access points (``zone``, ``node_id``, ``weight``, ``access_s``).

    The mean over the pairs of points that reach each other, weighted by both
    weights and with both access legs; pairs of one point with itself are left
    out.  With ``rate`` the seconds are the logsum -log(mean exp(-rate · s)) /
    rate instead.  ``least_fraction`` of the weight must be reached.
    """
    sums = zone_sums(edges, points, limit, rate, most)
    own = points.groupBy(F.col("zone").alias("origin")).agg(F.sum(F.col("weight") * F.col("weight")).alias("self"))
    full = sums.join(own, "origin").withColumn("full", F.when(F.col("origin") == F.col("destination"), 1 - F.col("self")).otherwise(1.0))
    fraction = F.col("den") / F.col("full")
    seconds = F.col("num") / F.col("den") if rate is None else -F.log(F.col("logs") / F.col("den")) / rate
    more = [(F.col("length") / F.col("den")).alias("metres")] if metres else []
    return full.where(fraction >= least_fraction - 1e-9).select("origin", "destination", seconds.alias("seconds"), fraction.alias("fraction"), *more)


def strong_components(edges: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """``(node_id, component)``: the largest node of the nodes that reach each other both ways, by colouring forwards and gathering backwards."""
    if not fits(edges, most):
        raise ValueError(f"strong components of over {most} edges aren't built")
    kind = "node_id bigint, component bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, idx = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[strong_labels(idx[: t.num_rows], idx[t.num_rows :], len(ids))])], ["node_id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, kind)  # two numbers an edge, of a network that would be broadcast as well


def strong_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The largest node of each node's strong component."""
    label, left = np.full(n, -1), np.ones(n, bool)
    while left.any():
        while True:  # a node without a way in or out is its own
            keep = left[a] & left[b]
            a, b = a[keep], b[keep]
            lone = np.flatnonzero(left & ~((np.bincount(a, minlength=n) > 0) & (np.bincount(b, minlength=n) > 0)))
            if not len(lone):
                break
            label[lone], left[lone] = lone, False
        colour = np.arange(n)
        order = np.argsort(b, kind="stable")
        ends, at = np.unique(b[order], return_index=True)
        while len(ends):  # the largest node that reaches each one
            new = np.maximum(colour[ends], np.maximum.reduceat(colour[a[order]], at))
            if (new == colour[ends]).all():
                break
            colour[ends] = new
        same = colour[a] == colour[b]
        sa, sb = a[same], b[same]
        found = left & (colour == np.arange(n))
        while True:  # back from each colour's node
            new = sa[found[sb] & ~found[sa]]
            if not len(new):
                break
            found[new] = True
        label[found], left[found] = colour[found], False
    return label


def weak_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node_id, component)``: the smallest node each node hangs together with; by hooking to the smallest neighbour and contraction."""
    e = cut(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).distinct())
    levels = []
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("p")).withColumnRenamed("u", "n"))
        levels.append(parent)
        a, b = parent.withColumnsRenamed({"n": "u", "p": "pu"}), parent.withColumnsRenamed({"n": "v", "p": "pv"})
        e = cut(e.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct().unionByName(
            # a parent that itself hooked on: its own way up stays in the graph
            parent.select(F.col("p").alias("n2")).distinct().join(parent, F.col("n2") == F.col("n")).where("p <> n").select(F.col("p").alias("u"), F.col("n").alias("v")).distinct()).distinct())
    if not levels:
        return e.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    label = levels[-1].select("n", F.col("p").alias("c"))
    for parent in reversed(levels[:-1]):
        up = label.withColumnsRenamed({"n": "p", "c": "higher"})
        label = parent.join(up, "p", "left").select("n", F.coalesce("higher", "p").alias("c"))
    return label.select(F.col("n").alias("node_id"), F.col("c").alias("component"))


def gap_connectors(nodes: DataFrame, groups: DataFrame, reach: float) -> DataFrame:
    """``(u, v, gap_m)``: the shortest gaps of at most ``reach`` that join groups of nodes, as a forest (Boruvka).

    ``nodes`` (``node_id``, ``x``, ``y``), ``groups`` (``node_id``,
    ``component``).  Each round every group takes its shortest gap to another
    one, ties by the nodes; the groups so joined are one in the next round.
    """
    at = cut(nodes.join(groups, "node_id").select("node_id", "x", "y", "component"))
    near = pairs_within(at, "node_id", reach)
    end = lambda k: at.select(F.col("node_id").alias(f"{k}_id"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), F.col("component").alias(f"{k}c"))
    gap = near.join(end("a"), "a_id").join(end("b"), "b_id").where("ac <> bc").select("a_id", "b_id", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("gap"), "ac", "bc")
    gap, chosen = cut(gap), None
    while not gap.isEmpty():
        each = gap.select("*", F.explode(F.array("ac", "bc")).alias("g")).groupBy("g").agg(F.min(F.struct("gap", "a_id", "b_id", "ac", "bc")).alias("m")).select("m.*").distinct()
        each = cut(each)
        chosen = each if chosen is None else chosen.unionByName(each)
        label = cut(weak_components(each, "ac", "bc"))
        a, b = label.select(F.col("node_id").alias("ac"), F.col("component").alias("na")), label.select(F.col("node_id").alias("bc"), F.col("component").alias("nb"))
        gap = cut(gap.join(a, "ac", "left").join(b, "bc", "left").select("a_id", "b_id", "gap", F.coalesce("na", "ac").alias("ac"), F.coalesce("nb", "bc").alias("bc")).where("ac <> bc"))
    if chosen is None:
        return at.select(F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("x").alias("gap_m")).limit(0)
    return chosen.select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), F.col("gap").alias("gap_m"))
