from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strideflow.operators.packed import build_automaton, cut_fields, known_values, learn_dictionary, segment, unpack
from tests.conftest import rows

A = build_automaton(["asphalt", "wood", "asphalt | patched", "a/b", "no"])


def test_delimiters_and_quotes():
    assert segment("asphalt;;wood", A) == ["asphalt", "wood"]
    assert segment(' "asphalt | patched" ; Wood ,', A) == ["asphalt | patched", "Wood"]
    assert segment('x;"boards, 2"" thick"', A) == ["x", 'boards, 2" thick']
    assert segment("'a, b'\tc", A) == ["a, b", "c"]
    assert segment("gravel；sand·no", A) == ["gravel", "sand", "no"]


def test_known_values_protect_their_delimiters():
    assert segment("wood; asphalt | patched", A) == ["wood", "asphalt | patched"]
    assert segment("wood | a/b | no", A) == ["wood", "a/b", "no"]
    assert segment("asphalt | new", A) == ["asphalt", "new"]
    assert segment("xa/bx", A) == ["xa", "bx"]


def test_empty_unbalanced_and_unknown():
    assert segment(None, A) == [] and segment("", A) == [] and segment(" ", A) == [] and segment(";;", A) == []
    assert segment('5" pipe;wood', A) == ['5" pipe', "wood"]
    assert segment('"open;wood', A) == ['"open', "wood"]
    assert segment("paving_stones:30;metal-grid", None) == ["paving_stones:30", "metal-grid"]
    assert segment("wood" + ";wood" * 20_000, A) == ["wood"] * 20_001


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc:_-", min_size=1, max_size=6), min_size=1, max_size=6), st.sampled_from(list(";,|/+&")))
def test_joined_values_come_back(values, delimiter):
    assert segment(f" {delimiter} ".join(values), build_automaton(values)) == values
    assert segment(delimiter.join(f'"{v}"' for v in values), None) == values


def test_unpack(spark):
    t = spark.createDataFrame([(1, "a;b", None, "x"), (2, "a", "c|c", "x"), (2, "a", "c|c", "x"), (3, None, "", "x"), (4, " ; a ", "'d;e'", "x")], "link_row long, f string, g string, items string")
    assert rows(unpack(t, "link_row", ["f", "g"])) == [(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "g", 1, "c"), (2, "g", 1, "c"), (2, "g", 2, "c"), (2, "g", 2, "c")]
    single = rows(unpack(t, "link_row", ["f", "g"], multi_only=False))
    assert (4, "g", 1, "d;e") in single and (4, "f", 1, "a") in single and not [r for r in single if r[0] == 3]
    assert unpack(t.limit(0), "link_row", ["f"]).count() == 0
    assert learn_dictionary(t, ["f", "g"], min_count=1) == ["a", "d;e"]


def test_rare_values_with_a_delimiter_are_known(spark):
    t = spark.createDataFrame([(1, "'d;e'"), (2, "x;d;e"), *[(3, "a")] * 3, *[(4, "b")] * 2], "link_row long, f string")
    assert learn_dictionary(t, ["f"], max_entries=1) == ["a", "d;e"]
    assert [r for r in rows(unpack(t, "link_row", ["f"])) if r[0] == 2] == [(2, "f", 1, "x"), (2, "f", 2, "d;e")]


def test_shards_of_a_large_dictionary_give_the_same(spark):
    t = spark.createDataFrame([(1, "'d;e'"), (2, "x;d;e"), (3, "'a/b'"), (4, "'b/c'"), (5, "c"), (6, "a/b/c"), (7, None), (8, "İx|y"), (9, "İX;D;E")], "key long, raw string").withColumn("tag_field", F.lit("f"))
    words = known_values(t, ["raw"])
    one, many = (rows(cut_fields(t.select("key", "tag_field", "raw"), words, n)) for n in (100, 2))
    assert one == many and dict((r[0], r[2]) for r in one)[2] == ["x", "d;e"] and dict((r[0], r[2]) for r in one)[6] == ["a/b", "c"]
    assert dict((r[0], r[2]) for r in one)[9] == ["İX", "D;E"] and dict((r[0], r[2]) for r in one)[7] == []


def test_no_value_is_too_rare(spark):
    t = spark.createDataFrame([(k, f"'v{k}/w'") for k in range(300)] + [(1000 + k, f"x;v{k}/w") for k in range(300)], "link_row long, f string")
    got = {r[0]: r[3] for r in rows(unpack(t, "link_row", ["f"])) if r[2] == 2}
    assert got == {1000 + k: f"v{k}/w" for k in range(300)}
