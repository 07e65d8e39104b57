"""Consolidating pairwise matches into groups on a two-dimensional grid.

Vertices are hashed into blocks; an edge belongs to the cell (block of one end,
block of the other).  Every cell runs a union-find of its own and sends each of
its vertices' local representative along the vertex' row and column, where the
smallest becomes the parent.  The other representatives of that vertex are tied
to it by new edges, over representatives only, and the next round runs on
these, until no edge is left.  Then the parents are followed back, round by
round.

No group is ever in one task: a cell holds at most ``cell_edges`` edges (larger
cells, as those of a hub, are cut into slices, each with its own union-find),
and a vertex has at most one representative from each slice that it is in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.plans.lineage import cut, drop_cut
from strideflow.plans.skew import HOT_ROWS, lookup

#: Edges that one task unites at a time (16 bytes each).
CELL_EDGES = 1_000_000
#: Blocks of the grid's side at least: every round exchanges along rows and columns.
LEAST_BLOCKS = 2


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of the component of each) by batched union-find: hook larger roots on smaller ones, halve paths, repeat."""
    names, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[: len(u)], idx[len(u) :]
    parent = np.arange(len(names))
    while len(a):
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return names, names[parent]


def _unite(table: pa.Table) -> pa.Table:
    v, r = union_find(table.column("u").to_numpy(), table.column("v").to_numpy())
    return pa.table({"vertex": pa.array(v, pa.int64()), "root": pa.array(r, pa.int64())})


def _round(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    """(vertex, root) of every slice of every cell of the grid, whose side follows from the number of edges."""
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(2 * n / cell_edges)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = edges.withColumn("bi", F.least(block("u"), block("v"))).withColumn("bj", F.greatest(block("u"), block("v")))
    # a cell's own count decides into how many slices it is cut; at most blocks² rows
    sizes = placed.groupBy("bi", "bj").count().where(F.col("count") > cell_edges).select("bi", "bj", F.ceil(F.col("count") / cell_edges).cast("int").alias("slices"))
    placed = placed.join(F.broadcast(sizes), ["bi", "bj"], "left").withColumn("slice", F.pmod(F.xxhash64("v", "u"), F.coalesce("slices", F.lit(1))))
    return placed.groupBy("bi", "bj", "slice").applyInArrow(_unite, "vertex bigint, root bigint")


def components(edges: DataFrame, u: str = "u", v: str = "v", cell_edges: int = CELL_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(vertex BIGINT, root BIGINT)``: for every vertex of ``edges`` the smallest vertex it hangs together with.

    Rows with a NULL end are left out; a loop makes its vertex known; repeated
    and reversed edges change nothing.  No edges: no rows.
    """
    pairs = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.least(F.col(u), F.col(v)).cast("bigint").alias("u"), F.greatest(F.col(u), F.col(v)).cast("bigint").alias("v")).distinct()
    current, levels = cut(pairs), []
    while (n := current.count()) > 0:
        local = cut(_round(current, n, cell_edges))
        parents = cut(local.groupBy("vertex").agg(F.min("root").alias("parent")))
        rest = cut(
            local.join(parents, "vertex").where("root <> parent")
            .select(F.least("parent", "root").alias("u"), F.greatest("parent", "root").alias("v")).distinct()
        )
        levels.append(parents)
        drop_cut(local), drop_cut(current)
        current = rest
    if not levels:
        return current.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    # a vertex' parent is a root of its round and so a vertex of the next one, or final
    label = levels[-1].select("vertex", F.col("parent").alias("root"))
    for parents in reversed(levels[:-1]):
        up = label.select(F.col("vertex").alias("parent"), F.col("root").alias("higher"))
        label = lookup(parents, up, "parent", "left", hot_rows).select("vertex", F.coalesce("higher", "parent").alias("root"))
    return label


def link_groups(links: DataFrame, key: str = "link_id", u: str = "u", v: str = "v", cell_edges: int = CELL_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, group_id)``: every key once, with the smallest key of all rows that hang together through equal ends.

    NULL and 0 are unknown ends and join nothing; a key without a known end is
    a group of its own.  Rows that repeat a key are one link with the ends of
    all of them.  NULL keys are left out.
    """
    end = lambda c: F.when(F.col(c) != 0, F.col(c).cast("bigint"))
    rows = links.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), end(u).alias("a"), end(v).alias("b"))
    anchored = cut(rows.groupBy("k").agg(F.min(F.least("a", "b")).alias("anchor")))
    known = anchored.where("anchor is not null")
    ends = rows.select("k", F.explode(F.array("a", "b")).alias("end")).where("end is not null")
    roots = cut(components(ends.join(known, "k").select(F.col("anchor").alias("u"), F.col("end").alias("v")), cell_edges=cell_edges, hot_rows=hot_rows))
    # a hub is the anchor of many links and a large group the root of many: both are looked up without putting their links together
    of = cut(lookup(known, roots.withColumnRenamed("vertex", "anchor"), "anchor", hot_rows=hot_rows).select("k", "root"))
    smallest = cut(of.groupBy("root").agg(F.min("k").alias("group_id")))
    joined = lookup(of, smallest, "root", hot_rows=hot_rows).select("k", "group_id")
    alone = anchored.where("anchor is null").select("k", F.col("k").alias("group_id"))
    return joined.unionByName(alone).withColumnRenamed("k", key)
