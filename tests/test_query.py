"""Retrieval: ranges, tags, errors, odd values."""

import math

import pytest

from tidemark.functions import bits
from tidemark.model import NEW_POINTS, EngineConfig, InvalidTimeRange, SegmentConfig, SeriesNotFound
from tidemark.operators import query as q

NORTH, SOUTH = {"site": "north", "unit": "u7"}, {"site": "south", "unit": "u9"}
BASIC = [("pump", 1010, 3.25, NORTH), ("pump", 1040, 2.5, NORTH), ("pump", 1075, 7.0, SOUTH), ("pump", 1025, -4.5, NORTH), ("pump", 1040, 2.75, SOUTH)]


def engine(spark, tmp_path, rows=(), **config):
    from tidemark.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/db", EngineConfig(**config))
    if rows:
        e.ingest(spark.createDataFrame(list(rows), NEW_POINTS))
        e.flush()
    return e


def got(df):
    return sorted((r["ts"], r["value"]) for r in df.collect())


def test_range_and_tags(spark, tmp_path):
    e = engine(spark, tmp_path, BASIC)
    for start, end, tags in (
        (0, 2000, None), (1015, 1041, None), (0, 2000, {"site": "north"}), (0, 2000, {"site": "north", "unit": "u7"}), (0, 2000, {"unit": "u9"}),
        (1040, 1075, {"unit": "u9"}), (0, 2000, {"site": "west"}), (0, 2000, {"site": "north", "unit": "u9"}), (0, None, {}), (1010, 1011, None),
        (0, 1010, None), (90_000, 95_000, None),
    ):
        want = sorted((t, v) for _, t, v, have in BASIC if start <= t < (end or 10**9) and (tags or {}).items() <= have.items())
        assert got(e.query("pump", start, end, tags)) == want, (start, end, tags)


def test_errors(spark, tmp_path):
    e = engine(spark, tmp_path, BASIC)
    with pytest.raises(SeriesNotFound):
        e.query("valve")
    for start, end in ((77, 30), (77, 77), (-3, 12)):
        with pytest.raises(InvalidTimeRange):
            e.query("valve", start, end)


def test_ragged_tags(spark, tmp_path):
    rows = [
        ("s", 1, 1.0, {"zone": "hall", "line": "l4", "role": "mix"}),
        ("s", 2, 2.0, {"zone": "hall", "line": "l4", "role": "fill"}),
        ("s", 3, 3.0, {"maker": "Ø-werk", "rev": "9.1"}),
        ("s", 4, 4.0, {"blank": "", "name": "насос 漢"}),
        ("s", 5, 5.0, {f"k{i}": str(i * i) for i in range(12)}),
        ("s", 6, 6.0, {}),
    ]
    e = engine(spark, tmp_path, rows)
    for tags in ({"zone": "hall", "line": "l4"}, {"role": "mix"}, {"maker": "Ø-werk", "rev": "9.1"}, {"blank": ""}, {"name": "насос 漢"}, {"k1": "1", "k5": "25", "k11": "121"}, {"none": "x"}, {}):
        assert got(e.query("s", tags=tags)) == sorted((t, v) for _, t, v, have in rows if tags.items() <= have.items())


def test_index_changes_nothing_but_skips(spark, tmp_path):
    rows = [("m", 40, 1.5, {"site": "x"}), ("m", 55, 2.5, {"site": "y"}), ("m", 56, 3.5, {"site": "y"}), ("n", 7, 0.0, {"site": "z"})]
    for use in (True, False):
        e = engine(spark, tmp_path / str(use), segment_store=SegmentConfig(enable_tag_index=use))
        for r in rows:
            e.insert(*r)
            e.flush()
        assert got(e.query("m", tags={"site": "y"})) == [(55, 2.5), (56, 3.5)]
        assert got(e.query("m", tags={"site": "z"})) == []
        assert bool(e.get_metrics()["counters"].get("tag_postings_segment_skips")) is use


def test_pairs_on_different_points(spark, tmp_path):
    e = engine(spark, tmp_path, [("s", 1, 1.0, {"a": "1", "b": "x"}), ("s", 2, 2.0, {"a": "2", "b": "y"})])
    assert got(e.query("s", tags={"a": "1", "b": "y"})) == []


def test_odd_floats_and_duplicates(spark, tmp_path):
    rows = [("s", 7, math.inf, NORTH), ("s", 12, -0.0, SOUTH), ("s", 12, 6.5, NORTH), ("s", 13, 6.5, NORTH), ("s", 13, 6.5, NORTH), ("s", 21, math.nan, NORTH), ("s", 3 * 10**11, -math.inf, SOUTH)]
    e = engine(spark, tmp_path, rows)
    out = [r["value"] for r in e.query("s").collect()]
    assert len(out) == 7 and sum(math.isnan(v) for v in out) == 1 and sum(math.isinf(v) for v in out) == 2
    assert any(v == 0 and math.copysign(1, v) < 0 for v in out)


def test_bits_round_trip(spark):
    import struct

    patterns = [0x7FF8000000000001, 0x7FF8000000000000, 0, 1 << 62, 0x3FF0000000000000]
    rows = spark.createDataFrame([(p,) for p in patterns], "value_bits long")
    back = bits.with_bits(bits.from_bits(rows), out="again").collect()
    assert [r["again"] for r in back] == patterns
    assert struct.unpack("<d", struct.pack("<q", patterns[-1]))[0] == back[-1]["value"]


def test_pushdown(spark, tmp_path):
    e = engine(spark, tmp_path, BASIC)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = e.query("pump", 1020, 1060, {"site": "north"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(series,pump)" in plan and "GreaterThanOrEqual(ts,1020)" in plan and "LessThan(ts,1060)" in plan
    assert "seq" not in plan.split("ReadSchema")[1]


def test_reports(spark, tmp_path):
    e = engine(spark, tmp_path, BASIC + [("t", 5, 1.0, {})])
    assert sorted(r[0] for r in e.list_series().collect()) == ["pump", "t"]
    assert [r[0] for r in e.list_series({"site": "south"}).collect()] == ["pump"]
    d = {(r["series"], r["slot_start"]): (r["n_points"], r["first_value"], r["last_value"]) for r in e.downsample(50).collect()}
    assert d["pump", 1000] == (4, 3.25, 2.75) and d["pump", 1050] == (1, 7.0, 7.0) and d["t", 0] == (1, 1.0, 1.0)
    e.sql_view("pts")
    assert spark.sql("select count(*) from pts").first()[0] == 6


def test_range_check_alone():
    q.check_range(0, None)
    with pytest.raises(InvalidTimeRange):
        q.check_range(0, 1 << 63)
