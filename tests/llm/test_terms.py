import random
from collections import Counter

from pyspark.sql import functions as F

from strideflow.llm import queries
from strideflow.llm.terms import marked, record_suffixes, term_counts


def _brute(records, max_n):
    tf, df = Counter(), Counter()
    for g, terms, w in records:
        terms = [t for t in terms or [] if t is not None]
        grams = [(g, tuple(terms[i : i + n])) for n in range(1, max_n + 1) for i in range(len(terms) - n + 1)]
        for x in grams:
            tf[x] += w
        for x in set(grams):
            df[x] += w
    return {x: (tf[x], df[x]) for x in tf}


def test_against_brute_force(spark):
    r = random.Random(4)
    recs = [(r.choice(["a", "b", None]), [r.choice("uvwxyz") for _ in range(r.randrange(9))], r.randrange(1, 4)) for _ in range(300)]
    recs += [("a", None, 1), ("a", [], 5), ("b", [None, "u", None, "u"], 1), ("a", ["u"] * 3000, 1), ("c", ["t"], 200)]
    df = spark.createDataFrame(recs, "g string, t array<string>, w long").withColumn("suffix", F.lit("clash")).repartition(6)
    for n in (1, 3):
        got = {(x.grp, tuple(x.term)): (x.tf, x.df) for x in term_counts(df, "t", "g", "w", n).collect()}
        assert got == _brute(recs, n)
    assert term_counts(df.limit(0), "t").count() == 0


def test_suffix_array_of_a_record():
    assert record_suffixes(list("abab"), 2) == [(["a", "b"], 0), (["a", "b"], 2), (["b"], 0), (["b", "a"], 1)]


def test_marks(spark):
    c = spark.createDataFrame([("g", "x", 3), ("g", "y", 4), ("g", "z", 26), ("g", "v", 25), (None, "w", 90)], "grp string, term string, df long")
    s = spark.createDataFrame([("g", 100), (None, 100)], "grp string, total long")
    assert {r.term: r.mark for r in marked(c, s).collect()} == {"x": "rare", "y": None, "z": "common", "v": None, "w": "common"}


def test_sequences_are_as_long_as_the_fields(spark, monkeypatch):
    v = spark.createDataFrame([("surface", list("abcde"), 4), ("surface", ["a"], 1)], "tag_field string, terms array<string>, weight long")
    monkeypatch.setattr(queries, "_values", lambda *a: v)
    got = {r.term: (r.n, r.tf, r.df) for r in queries.p7_all_sequences(spark, "").collect()}
    assert len(got) == 15 and got["a > b > c > d > e"] == (5, 4, 4) and got["a"] == (1, 5, 5)
