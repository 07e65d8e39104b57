import random

from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from strideflow.llm.canonical import BKTree, Spelling, distances, encode, fold, map_values, pair_distances, split_value
from strideflow.llm.queries import COUNTERS
from tests.conftest import rows


def _lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        n = [i + 1]
        for j, y in enumerate(b):
            n.append(min(p[j] + (x != y), p[j + 1] + 1, n[-1] + 1))
        p = n
    return p[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", max_size=70), min_size=1, max_size=40), st.text("abcd", max_size=70))
def test_distances(words, query):
    codes, lengths = encode(words)
    assert distances(query, codes, lengths).tolist() == [_lev(query, w) for w in words]


def test_tree_returns_every_word_in_radius():
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(3, 12))) for _ in range(400)]
    tree = BKTree.build(words)
    for q in words[:20] + ["", "zzzz", "abcde"]:
        for radius in (0, 1, 3):
            assert sorted(tree.within(q, radius)) == sorted((w, _lev(q, w)) for w in set(words) if _lev(q, w) <= radius)
    assert BKTree.build([]).within("a", 3) == []


def test_split_value():
    assert fold("VÃ¤ylÃ¤ ä") == "vayla a"
    assert split_value("LAM 412 Jänanometsänt. länsi", COUNTERS) == ("jananometsant", "lansi", None)
    assert split_value("#56 Pelto-katuPP", COUNTERS) == ("peltokatu", "", None)
    assert split_value("etelä Halmomimäkin kuja", COUNTERS) == ("halmomimakinkuja", "etela", None)
    assert split_value("Kylä: Tie länsi", COUNTERS, ["kyla"]) == ("tie", "lansi", "kyla")


LINES = [(1, "Kylä", "Pitkäniementie", 0.0, 0.0), (2, "Kylä", "Lyhytrannankatu etelä", 1000.0, 0.0), (3, "Kylä", "Lyhytrannankatu pohjoinen", 1100.0, 0.0), (4, "Salo", "Pitkäniementie", 5000.0, 0.0), (5, None, None, None, None)]


def _mapped(spark, obs, lines=LINES, **kw):
    o = spark.createDataFrame(obs, "o long, city string, name string, x double, y double").withColumn("candidates", F.lit("clash"))
    e = spark.createDataFrame(lines, "id long, c string, n string, lx double, ly double")
    return dict(rows(map_values(o, "o", "city", "name", "x", "y", e, "id", "c", "n", "lx", "ly", COUNTERS, **kw)))


def test_mapping(spark):
    obs = [
        (1, "KYLÄ ", "pitkaniementie", None, None), (2, "Salo", "Pitkäniementie PP", None, None), (3, None, "Pitkäniementie", None, None), (4, None, "Pitkäniementie", 5010.0, 3.0),
        (5, "Kylä", "Lyhytrannank. pohj.", None, None), (6, "Kylä", "Lyhytrannankatu", None, None), (7, "Kylä", "Lyhytrannankatu", 1001.0, 0.0), (8, "Kylä", "sairaala", None, None),
        (9, "Kylä", "n/a", None, None), (10, "Kylä", "  ", None, None), (11, "Kylä", None, None, None), (12, "Kylä", "Pitkäniemetnite", float("nan"), None), (1, "KYLÄ ", "pitkaniementie", None, None),
        (13, "Kylä", "x" * 5000, None, None), (14, "Nowhere", "Salo, Pitkäniementie", None, None),
    ]
    got = _mapped(spark, obs)
    assert got == {1: 1, 2: 4, 3: -1, 4: 4, 5: 3, 6: -1, 7: 2, 8: -1, 9: -1, 12: 1, 13: -1, 14: 4}
    assert _mapped(spark, obs[:2], LINES[4:]) == {1: -1, 2: -1}


def test_spelling_without_rules(spark):
    assert split_value("A b-c", Spelling()) == ("abc", "", None)


def test_shards_give_what_one_tree_gives(spark):
    lines = [(1, "Helsinki", "Kauppatori", 0.0, 0.0), (2, "Turku", "Kauppatori", 9000.0, 0.0), (3, "Espoo", "Kauppatorin", 500.0, 0.0), (4, "Turku", "Aho", 1.0, 1.0), (5, "Helsinki", "Rantatie", 0.0, 9.0), (6, "Vantaa", "Rantatei", 0.0, 9.0)]
    obs = [(1, "Helsinki", "Kauppatori", None, None), (2, "Turku", "kauppatori", None, None), (3, "Espoo", "Kauppatori", None, None), (4, "Turku", "AHO", None, None), (5, None, "Aho", None, None), (6, None, "Kauppatori", None, None), (7, "Lahti", "Rantatie", None, None)]
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: -1, 7: 5}
    assert _mapped(spark, obs, lines) == want
    for n in (1, 2, 3):
        assert _mapped(spark, obs, lines, shard_entries=n) == want


def test_the_metric_tells_all_letters_apart():
    a = "\u0430bc"  # another script's letter, 255 places and more away from others
    for x, y in ((a, "abc"), (a, "4bc"), (chr(300) + "x", chr(45) + "x"), (chr(555), chr(300)), ("", "abc"), ("x" * 80, "y" * 70)):
        assert distances(x, *encode([y]))[0] == _lev(x, y)
    r = random.Random(3)
    w = ["".join(r.choice("abcд字") for _ in range(r.randrange(0, 70))) for _ in range(60)]
    codes, lengths = encode(w)
    q, k = [r.randrange(60) for _ in range(400)], [r.randrange(60) for _ in range(400)]
    import numpy as np

    assert pair_distances(codes, lengths, np.array(q), codes, lengths, np.array(k)).tolist() == [_lev(w[i], w[j]) for i, j in zip(q, k)]
