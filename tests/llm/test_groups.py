import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.llm.groups import components, link_groups, union_find
from tests.conftest import rows


def _roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_union_find():
    r = random.Random(1)
    e = [(r.randrange(500), r.randrange(500)) for _ in range(350)]
    v, c = union_find(np.array([a for a, _ in e]), np.array([b for _, b in e]))
    assert dict(zip(v.tolist(), c.tolist())) == _roots(e)


@pytest.mark.parametrize("cell_edges", [1_000_000, 40])
def test_components_with_long_chain_and_hub(spark, cell_edges):
    r = random.Random(2)
    perm = list(range(5000, 5600))
    r.shuffle(perm)
    e = [(perm[i], perm[i + 1]) for i in range(399)] + [(7, x) for x in perm[400:550]] + [(7, 7), (8, 8)] + [(perm[560], perm[561])] * 5
    df = spark.createDataFrame([*e, (None, 3), (3, None)], "u long, v long")
    assert dict(rows(components(df, cell_edges=cell_edges))) == dict(rows(components(df, cell_edges=cell_edges, hot_rows=20))) == _roots(e)
    assert components(df.limit(0)).count() == 0


def test_link_groups(spark):
    t = [(10, 1, 2), (11, 2, 3), (12, 0, None), (13, None, 0), (14, 9, 9), (15, -4, 3), (16, 20, 21), (16, 22, None), (17, 22, 0), (10, 1, 2), (None, 1, 1)]
    df = spark.createDataFrame(t, "link_id long, u long, v long").withColumn("root", F.lit("clash")).withColumn("k", F.lit("clash"))
    assert rows(link_groups(df)) == [(10, 10), (11, 10), (12, 12), (13, 13), (14, 14), (15, 10), (16, 16), (17, 16)]
    assert link_groups(df.limit(0)).count() == 0
    lonely = spark.createDataFrame([(1, None, None), (2, 0, 0)], "link_id long, u long, v long")
    assert rows(link_groups(lonely)) == [(1, 1), (2, 2)]


def test_a_third_of_all_rows_at_one_node(spark):
    t = spark.range(3000).select(F.col("id").alias("link_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("u"), (F.col("id") + 100_000).alias("v"))
    for hot in (1_000_000, 50):
        got = dict(rows(link_groups(t, cell_edges=100, hot_rows=hot)))
        assert got == {i: (0 if i % 3 == 0 else i) for i in range(3000)}
