import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.llm.quantiles import runs, select

QS = [0.0, 0.05, 0.5, 0.77, 1.0]


def _table(spark):
    r = random.Random(3)
    out = [(1, r.lognormvariate(0, 2)) for _ in range(3000)] + [(2, float(r.randrange(4))) for _ in range(700)] + [(3, 5.0)] * 300 + [(4, 1.5), (5, 1.0), (5, 2.0)]
    out += [(1, None), (1, float("nan")), (6, None), (None, 1.0), (7, float("inf"))]
    return out, spark.createDataFrame(out, "g long, x double").withColumn("vals", F.lit("clash")).repartition(5)


def _want(values):
    by = {}
    for g, x in values:
        if g is not None and x is not None and not np.isnan(x):
            by.setdefault(g, []).append(x)
    def at(v, q):
        k, v = q * (len(v) - 1), sorted(v)
        low, high = v[int(k)], v[min(int(k) + 1, len(v) - 1)]
        return low + (high - low) * (k - int(k)) if high != low else low

    return {(g, q): at(v, q) for g, v in by.items() for q in QS}


@pytest.mark.parametrize("states", [500_000, 9])
def test_exact_percentiles(spark, states):
    values, df = _table(spark)
    got = {(r.grp, r.q): r.value for r in select(runs(df, "g", ["x"]), QS, states=states).collect()}
    want = _want(values)
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)


def test_runs_of_days_combine_and_least(spark):
    values, df = _table(spark)
    a, b = df.where("x < 1"), df.where("not x < 1 or x is null")
    got = {(r.grp, r.q): r.value for r in select(runs(a, "g", ["x"]).unionByName(runs(b, "g", ["x"])), QS, least=40).collect()}
    want = {k: v for k, v in _want(values).items() if k[0] in (1, 2, 3)}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)


def test_thinned_runs_keep_the_rank_bound(spark):
    values, df = _table(spark)
    eps = 0.01
    x = np.sort([v for g, v in values if g == 1 and v is not None and np.isfinite(v)])
    for r in select(runs(df.where("g = 1"), "g", ["x"], eps), [0.1, 0.5, 0.9]).collect():
        assert r.n == len(x) and abs(np.searchsorted(x, r.value) - r.q * len(x)) <= eps * len(x) + 5  # one rank more for each of the five runs


def test_empty(spark):
    df = spark.createDataFrame([], "g long, x double")
    assert select(runs(df, "g", ["x"]), [0.5]).count() == 0


def test_infinities_and_exact_beside_thinned_runs(spark):
    inf = float("inf")
    t = [(1, -inf), (1, -inf), (1, inf), (1, inf), (2, -inf), (2, 3.0), (2, inf), (3, 1.0), (3, inf)] + [(4, float(k % 97)) for k in range(5000)]
    df = spark.createDataFrame(t, "g long, x double").repartition(3)
    got = {(r.grp, r.q): r.value for r in select(runs(df, "g", ["x"]), [0.0, 0.5, 1.0]).collect()}
    assert [got[(2, q)] for q in (0.0, 0.5, 1.0)] == [-inf, 3.0, inf] and got[(1, 0.0)] == -inf and got[(1, 1.0)] == inf and got[(3, 0.5)] == inf
    mixed = runs(df.where("g = 4 and x < 50"), "g", ["x"]).unionByName(runs(df.where("g = 4 and x >= 50"), "g", ["x"], 0.01))
    r = select(mixed, [0.25, 0.9]).orderBy("q").collect()
    assert r[0].n == 5000 and abs(r[0].value - 24) <= 1 and abs(r[1].value - 87) <= 2


def test_a_hot_group_goes_through_the_loop(spark):
    df = spark.range(200_000).selectExpr("id % 3 as g", "cast(id * 7919 % 200003 as double) as x").repartition(8)
    got = {(r.grp, r.q): r.value for r in select(runs(df, "g", ["x"]), [0.5, 0.95]).collect()}
    x = df.toPandas()
    assert all(abs(got[(g, q)] - v.x.quantile(q)) < 1e-6 for g, v in x.groupby("g") for q in (0.5, 0.95))
