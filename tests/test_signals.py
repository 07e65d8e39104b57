from strideflow.plans import signals as S
from tests.conftest import rows


def _tables(spark):
    """A signalled crossroads with a footway over one arm at a zebra, and a mid-block light on a road further on."""
    nodes = [(1, 0.0, 0.0), (2, 100.0, 0.0), (3, -100.0, 0.0), (4, 0.0, 100.0), (5, 12.0, 0.0), (6, 12.0, 20.0), (7, 12.0, -60.0), (8, 500.0, 0.0), (9, 560.0, 0.0), (10, 440.0, 0.0)]
    links = [(0, 3, 1, "primary"), (1, 1, 5, "primary"), (2, 5, 2, "primary"), (3, 1, 4, "residential"), (4, 6, 5, "footway"), (5, 5, 7, "footway"), (6, 10, 8, "tertiary"), (7, 8, 9, "tertiary"), (8, None, 4, "path")]
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "node_id long")
    return spark.createDataFrame(links, "link_row long, u long, v long, highway string"), spark.createDataFrame(nodes, "node_id long, x double, y double"), ids(1, 8), ids(1), ids(5)


def test_layout_and_codes(spark):
    t, *rest = _tables(spark)
    lay = S.layout(t, *rest).cache()
    got = {r.node_id: (r.junction, r.code) for r in lay.collect()}
    assert got[1] == got[5] == (1, S.PRIMARY) and got[6] == (1, S.PRIMARY) and got[7] == (None, None)
    assert got[8] == (8, S.MIDBLOCK) and got[2] == (None, None)
    codes = {r.link_row: tuple(r)[1:] for r in S.signal_codes(t, lay).collect()}
    assert codes[0] == (S.PRIMARY, 0, 0, 0) and codes[1] == (0, 0, 0, 0) and codes[2] == (0, S.PRIMARY, 0, 0)
    assert codes[4] == codes[5] == (0, 0, 0, 0)  # a zebra is free to cross
    assert codes[6] == (S.MIDBLOCK, 0, 0, 0) and 8 not in codes


def test_crossings_get_twins(spark):
    t, *rest = _tables(spark)
    moved, con = S.split_crossings(t, S.layout(t, *rest))
    assert rows(con) == [(-1, 5, "crossing_entry")]
    assert {r.link_row: (r.u, r.v) for r in moved.collect()}[4] == (6, -1) and {r.link_row: (r.u, r.v) for r in moved.collect()}[1] == (1, 5)


def test_no_signals(spark):
    t, nodes, signals, lights, crossings = _tables(spark)
    lay = S.layout(t, nodes, signals.limit(0), lights.limit(0), crossings)
    assert lay.where("junction is not null").count() == 0
    assert S.signal_codes(t, lay).where("signal_entry + signal_entry_reverse + signal_cross_start + signal_cross_end > 0").count() == 0
