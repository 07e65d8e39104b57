import pytest

from strideflow.plans.pipeline import Step, read_settings, run_stale
from strideflow.sources.files import append_observations, read_demand, read_network, read_points, sniff_delimiter, write_network
from tests.conftest import rows


def test_points(spark, tmp_path):
    assert sniff_delimiter("id;lon;lat") == ";" and sniff_delimiter("a,b") == "," and sniff_delimiter("one") == ";"
    (tmp_path / "p.csv").write_text("id;lon;lat;w\na;24,5;60 000,25;2\nb;x;1;\nc;1;2;-3\nd;1;2;abc\n")
    got = rows(read_points(spark, str(tmp_path / "p.csv"), "id", "lon", "lat", "w").na.fill(-1.0))
    assert got == [("a", 24.5, 60000.25, 2.0), ("b", -1.0, 1.0, 1.0), ("c", 1.0, 2.0, 0.0), ("d", 1.0, 2.0, 0.0)]


def test_demand(spark, tmp_path):
    (tmp_path / "d.csv").write_text("from,to,trips\n1,2,3.5\n1,x,1\n2,2,\n1,2,0.5\n")
    assert rows(read_demand(spark, str(tmp_path / "d.csv"), "from", "to", "trips")) == [(1, 2, 0.5), (1, 2, 3.5)]


def test_network_is_refused_for_another_mode(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 3.0)], "u long, v long, travel_time_s double")
    write_network(e, str(tmp_path / "n"), "bike")
    assert rows(read_network(spark, str(tmp_path / "n"), "bike")) == [(1, 2, 3.0)]
    with pytest.raises(ValueError, match="for bike"):
        read_network(spark, str(tmp_path / "n"), "walk")
    spark.createDataFrame([('{"version": 99, "mode": "bike"}',)], "value string").write.mode("overwrite").text(str(tmp_path / "n/note"))
    with pytest.raises(ValueError, match="version 99"):
        read_network(spark, str(tmp_path / "n"), "bike")


def test_observations_are_appended(spark, tmp_path):
    for k in (1, 2):
        append_observations(spark.createDataFrame([(k, "x")], "k long, v string"), str(tmp_path / "o"))
    assert rows(spark.read.json(str(tmp_path / "o")).select("k", "v")) == [(1, "x"), (2, "x")]


def test_only_stale_steps_run(tmp_path):
    (tmp_path / "in").write_text("1")
    ran = []

    def step(name, reads, writes, **settings):
        def run():
            ran.append(name)
            for w in writes:
                (tmp_path / w).write_text(name + str(len(ran)))

        return Step(name, run, [str(tmp_path / r) for r in reads], [str(tmp_path / w) for w in writes], settings)

    def go(speed=1, **kw):
        ran.clear()
        return run_stale([step("a", ["in"], ["mid"]), step("b", ["mid"], ["out"], speed=speed)], tmp_path / "state.json", **kw)

    assert [n for n, _ in go()] == ["a", "b"] and ran == ["a", "b"]
    assert go() == [] and ran == []
    assert go(speed=2) == [("b", "inputs or settings changed")] and ran == ["b"]
    assert [n for n, _ in go(speed=2, force={"a"}, dry_run=True)] == ["a"] and ran == []
    (tmp_path / "out").unlink()
    assert go(speed=2) == [("b", "an output is missing")]
    (tmp_path / "mid").write_text("by hand, longer")
    assert [n for n, _ in go(speed=2)] == ["a", "b"] and ran == ["b"]
    (tmp_path / "in").write_text("22")
    assert [n for n, _ in go(speed=2)] == ["a", "b"] and ran == ["a", "b"]


def test_settings(tmp_path):
    (tmp_path / "base.toml").write_text("speed = 1\nmode = 'walk'\n[zones]\nspeed = 3\n")
    (tmp_path / "own.toml").write_text("extends = 'base.toml'\nmode = 'bike'\n")
    assert read_settings(tmp_path / "own.toml") == {"speed": 1, "mode": "bike"}
    assert read_settings(tmp_path / "own.toml", section="zones") == {"speed": 3, "mode": "bike"}
    with pytest.raises(ValueError, match="did you mean 'speed'"):
        (tmp_path / "bad.toml").write_text("sped = 1\n")
        read_settings(tmp_path / "bad.toml", {"speed"})
    (tmp_path / "loop.toml").write_text("extends = 'loop.toml'\n")
    with pytest.raises(ValueError, match="extends itself"):
        read_settings(tmp_path / "loop.toml")
