import itertools
import math

import pytest

from strideflow.llm.entities import match_roads, propagate
from tests.conftest import rows

G = "array<struct<x:double,y:double>>"


def pt(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_propagation_is_exact_on_a_tree(spark):
    prior = {1: 1.0, 2: 0.5, 3: -0.3, 4: 2.0}
    factors = {"a": [1, 2], "b": [2, 3], "c": [3, 4]}
    total, marg = 0.0, dict.fromkeys(prior, 0.0)
    for bits in itertools.product((0, 1), repeat=4):
        x = dict(zip(prior, bits))
        if all(sum(x[p] for p in f) <= 1 for f in factors.values()):
            w = math.exp(sum(prior[p] for p in prior if x[p]))
            total += w
            for p in prior:
                marg[p] += w * x[p]
    pairs = spark.createDataFrame(list(prior.items()), "pair long, prior double")
    members = spark.createDataFrame([(p, f) for f, ps in factors.items() for p in ps] + [(4, "alone")], "pair long, factor string")
    got = {r.pair: 1 / (1 + math.exp(-r.belief)) for r in propagate(pairs, members, tolerance=1e-9, rounds=80).collect()}
    assert all(abs(got[p] - marg[p] / total) < 1e-5 for p in prior)


def test_no_factors_keeps_the_prior(spark):
    pairs = spark.createDataFrame([(1, 0.7)], "pair long, prior double")
    assert propagate(pairs, spark.createDataFrame([], "pair long, factor string")).first().belief == 0.7


def test_propagation_goes_on_until_it_settles(spark):
    pairs = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 2.0)], "pair long, prior double")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "pair long, factor string")
    settled = {r.pair: r.belief for r in propagate(pairs, members).collect()}
    early = {r.pair: r.belief for r in propagate(pairs, members, rounds=5).collect()}
    assert all(abs(early[p] - settled[p]) < 5e-3 for p in settled)
    with pytest.raises(RuntimeError, match="still change"):
        propagate(pairs, members, tolerance=1e-9, rounds=1)


def test_roads(spark):
    links = [
        (1, pt((0, 0), (60, 0)), "Pitkätie", 5), (2, pt((60, 0), (120, 0)), None, 5), (3, pt((0, 14), (60, 14)), "Toinenkatu", 5), (4, pt((120, 0), (240, 0)), "Pitkätie", 5),
        (5, None, "Pitkätie", 5), (6, pt((1, 1), (1, 1)), "x", None), (7, pt((30, -60), (30, 60)), "Poikki", 5),
    ]
    lines = [(10, pt((121, 3), (-1, 4)), "Pitkatie", 5), (11, pt((0, -4), (122, -5)), "Pitkätie", None), (12, pt(), None, None), (13, pt((120, 2), (170, 2)), "Pitkätie", 5)]
    a = spark.createDataFrame(links, f"link long, geometry {G}, name string, road_class int")
    b = spark.createDataFrame(lines, f"line long, geometry {G}, name string, road_class int")
    m = match_roads(a, b).cache()
    assert rows(m.where("belief > 0").select("link", "line")) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    assert all(0 <= r.confidence <= 1 and r.offset_m < 20 for r in m.collect())
    assert match_roads(a.limit(0), b).count() == 0
