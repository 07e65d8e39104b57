import random

import pytest
from pyspark.sql import functions as F

from strideflow.llm.mixing import mix, sainte_lague, shares_reached


def test_sainte_lague():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    for seats in (0, 1, 10, 997):
        v = {"a": 0.31, "b": 0.29, "c": 0.4, "d": 0.0}
        got, want = sainte_lague(v, seats), {k: 0 for k in v if v[k]}
        for _ in range(seats):
            k = min(want, key=lambda k: (-v[k] / (2 * want[k] + 1), k))
            want[k] += 1
        assert got == want
    assert sainte_lague({"a": 1.0, "b": 1.0}, 10, {"a": 2}) == {"a": 2, "b": 8} and sainte_lague({"a": 1.0}, 5, {"a": 3}) == {"a": 3}


def _docs(spark):
    r = random.Random(8)
    word = lambda: r.choice(["river", "stone", "alpha", "beta", "gamma", "delta"])
    out = [(k, s, " ".join(word() for _ in range(r.randrange(5, 60)))) for k, s in enumerate(r.choice(["big"] * 8 + ["mid"] * 3 + ["small"]) for _ in range(1200))]
    out += [(5000 + k, "mid", out[k][2]) for k in range(50)] + [(6000, None, "no source"), (6001, "big", None), (6002, "big", ""), (6003, "other", "no target"), (6004, "small", "the same"), (6005, "small", "the same")]
    return out, spark.createDataFrame(out, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, 1)]


@pytest.mark.parametrize("shard", [200_000_000, 3000])
def test_mix(spark, shard):
    listed, docs = _docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    got = mix(docs, t, shard_tokens=shard).cache()
    text = {d: x for d, _, x in listed}
    uses, most = {}, {s: m for s, _, m in TARGETS}
    for r in got.collect():
        uses[text[r.doc_id]] = uses.get(text[r.doc_id], 0) + r.copies
        assert uses[text[r.doc_id]] <= most[r.source]
    rep = {r.source: r for r in shares_reached(got, t).collect()}
    assert set(rep) == {"big", "mid", "small", "none"} and rep["none"].tokens == 0
    for s, share, m in TARGETS:
        assert abs(rep[s].reached_share - share) < 0.015 and rep[s].most_copies <= m
    assert max(rep[s].most_copies / m for s, _, m in TARGETS if rep[s].texts) == 1  # one source is used up
    half = mix(docs, t, total_tokens=4000, shard_tokens=shard)
    assert abs(half.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - 4000) < 400
    again = mix(docs.repartition(7), t, shard_tokens=shard)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_empty(spark):
    _, docs = _docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix(docs.limit(0), t).count() == 0 and mix(docs, t.limit(0)).count() == 0
    assert shares_reached(mix(docs.limit(0), t), t).where("tokens > 0").count() == 0


def test_blocks_larger_than_a_shard_keep_the_shares(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], f"river stone {k} alpha beta") for k in range(2000)], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    for kw in ({}, {"blocks": 20, "shard_tokens": 300}, {"blocks": 20, "shard_tokens": 300, "total_tokens": 7000}):
        rep = shares_reached(mix(docs, t, **kw), t).collect()
        assert all(abs(r.reached_share - 0.5) < 0.01 for r in rep) and abs(sum(r.tokens for r in rep) - kw.get("total_tokens", 1e9)) < 300 or not kw.get("total_tokens")
