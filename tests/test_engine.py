"""Storage: flush, retention, compaction, limits, snapshots, recovery, streams."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import storage
from tidemark.config import load
from tidemark.engine import Engine
from tidemark.model import NEW_POINTS, CardinalityLimitExceeded, ConfigError, Corruption, Encoding, EngineConfig, SegmentConfig
from tidemark.plans.catalog import ConcurrentWrite
from tidemark.sources import segments as seg


def points(spark, rows):
    return spark.createDataFrame(rows, NEW_POINTS)


def engine(spark, path, **config):
    return Engine(spark, f"file://{path}", EngineConfig(**config))


def values(df):
    return sorted((r["ts"], r["value"]) for r in df.collect())


def line(n, step=1, series="s"):
    return [(series, t, float(t), {}) for t in range(0, n, step)]


def test_unflushed_is_invisible_and_sequence_is_dense(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(10)), order=["ts"])
    assert e.points().count() == 0
    assert e.flush() == 10 and e.flush() == 0
    e.ingest(points(spark, line(5, series="t")), order=["ts"])
    e.close()
    assert sorted(r["seq"] for r in e.points().collect()) == list(range(15))


def test_retention(spark, tmp_path):
    e = engine(spark, tmp_path / "db", enable_wal=False)
    for k in range(4):
        e.ingest(points(spark, [("s", t, float(t), {}) for t in range(50 * k, 50 * k + 50)]))
        e.flush()
    e.set_delete_before(120)
    e.set_delete_before(60)
    assert e.delete_before == 120 and min(values(e.query("s")))[0] == 120
    assert e.compact() == (4, 1) and min(values(e.query("s")))[0] == 120
    again = engine(spark, tmp_path / "db")
    assert again.delete_before == 120 and len(values(again.query("s"))) == 80
    again.set_delete_before(130)
    assert again.reclaim() == 1 and all(s.min_ts >= 130 and s.level == 1 for s in again.manifest.segments)
    again.set_delete_before(1000)
    again.reclaim()
    assert not again.manifest.segments
    with pytest.raises(ConfigError):
        engine(spark, tmp_path / "m", enable_segments=False).set_delete_before(1)


def test_late_points_below_the_watermark_are_dropped(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.set_delete_before(5)
    e.ingest(points(spark, line(10)))
    assert e.flush() == 5
    e.ingest(points(spark, line(5)))
    assert e.flush() == 0 and len(e.manifest.segments) == 1


def test_ttl(spark, tmp_path):
    now = [10**12]
    e = Engine(spark, f"file://{tmp_path}/db", EngineConfig(retention_ttl_s=10), clock=lambda: now[0])
    e.ingest(points(spark, [("s", 10**12 - 5 * 10**9, 1.0, {}), ("s", 10**12 - 20 * 10**9, 2.0, {})]))
    assert e.flush() == 1
    now[0] += 8 * 10**9
    e.maintain()
    assert e.points().count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 9999), st.floats(allow_nan=False)), min_size=1, max_size=60))
def test_compaction_keeps_the_bag(spark, tmp_path_factory, ops):
    e = engine(spark, tmp_path_factory.mktemp("db"), enable_wal=False)
    for k in range(0, len(ops), 20):
        e.ingest(points(spark, [(s, t, v, {}) for s, t, v in ops[k : k + 20]]))
        e.flush()
    before = sorted((r["series"], r["ts"], r["seq"], r["value"]) for r in e.points().collect())
    e.compact()
    assert sorted((r["series"], r["ts"], r["seq"], r["value"]) for r in e.points().collect()) == before
    assert len(before) == len(ops)


def test_compaction_triggers(spark, tmp_path):
    now = [0]
    e = Engine(spark, f"file://{tmp_path}/db", EngineConfig(enable_wal=False), clock=lambda: now[0])
    c = e.config.segment_store
    for k in range(2):
        e.ingest(points(spark, line(3)))
        e.flush()
    assert not e.compaction_due()
    c.l0_compaction_trigger_total_bytes = 1
    assert e.compaction_due()
    c.l0_compaction_trigger_total_bytes, c.l0_compaction_trigger_max_age_s = None, 5
    assert not e.compaction_due()
    now[0] = 6 * 10**9
    assert e.maintain() == (2, 1) and e.compact() == (0, 0)
    assert e.reap() == 0 and e.reap(now[0] + 10**13) == 2
    assert values(e.query("s")) == sorted([(t, float(t)) for t in range(3)] * 2)


def test_limit(spark, tmp_path):
    e = engine(spark, tmp_path / "db", max_series_cardinality=2)
    e.ingest(points(spark, [("s", 1, 1.0, {"a": "1"}), ("s", 2, 1.0, {"a": "2"}), ("s", 3, 1.0, {"a": "1"})]))
    with pytest.raises(CardinalityLimitExceeded) as x:
        e.ingest(points(spark, [("s", 4, 1.0, {"a": "3"})]))
    assert (x.value.current, x.value.limit, x.value.scope) == (2, 2, "default")
    rejected = e.ingest(points(spark, [("s", 5, 1.0, {"a": "3"}), ("s", 6, 1.0, {"a": "2"})]), on_limit="split")
    assert [r["ts"] for r in rejected.collect()] == [5]
    e.flush()
    assert len(values(e.query("s"))) == 4
    e.checkpoint_keys()
    again = engine(spark, tmp_path / "db", max_series_cardinality=2)
    with pytest.raises(CardinalityLimitExceeded):
        again.ingest(points(spark, [("t", 4, 1.0, {"a": "1"})]))
    assert again.get_metrics()["counters"]["cardinality_limit_rejections"] == 1
    assert 'series_cardinality{scope="default"} 2' in again.metrics.render()


def test_limit_per_scope_and_seeding(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, [("s", 1, 1.0, {"tenant": "acme/prod"})]))
    e.flush()
    e = engine(spark, tmp_path / "db", max_series_cardinality=1, cardinality_scope_tag_key="tenant")
    out = e.ingest(points(spark, [("t", 1, 1.0, {"tenant": "acme/prod"}), ("t", 2, 1.0, {"tenant": "beta"}), ("t", 3, 1.0, {"tenant": ""}), ("u", 4, 1.0, {})]), on_limit="split")
    assert sorted(r["ts"] for r in out.collect()) == [1, 4]


def test_snapshot_and_restore(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(5)))
    path = e.snapshot()
    e.ingest(points(spark, line(3, series="t")))
    e.flush()
    storage.hadoop_path(spark, f"{e.path}/snapshots/.open-99999")[0].mkdirs(storage.hadoop_path(spark, f"{e.path}/snapshots/.open-99999")[1])
    assert e.restore() == 5 and e.restore(path) == 5
    assert [r[0] for r in e.list_series().collect()] == ["s"]
    with pytest.raises(ConfigError):
        engine(spark, tmp_path / "n", enable_snapshots=False).snapshot()


def test_recovery(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, [("a", 10, 1.25, {}), ("a", 11, 2.25, {})]))
    e = engine(spark, tmp_path / "db")
    fs, p = storage.hadoop_path(spark, f"{e.root}/seg-0000000099-l0")
    fs.mkdirs(p)
    assert e.recover() == 2 and values(e.query("a")) == [(10, 1.25), (11, 2.25)]
    assert not fs.exists(p) and e.recover() == 0
    e.ingest(points(spark, [("a", 12, 3.0, {})]))
    e.flush()
    assert sorted(r["seq"] for r in e.points().collect()) == [0, 1, 2]


def test_memory_mode(spark, tmp_path):
    e = engine(spark, tmp_path / "db", enable_segments=False)
    e.ingest(points(spark, line(4)))
    e.flush()
    e.snapshot()
    e.ingest(points(spark, [("s", 9, 9.0, {})]))
    e = engine(spark, tmp_path / "db", enable_segments=False)
    assert e.recover() == 1 and len(values(e.query("s"))) == 5 and e.compact() == (0, 0)


def test_corruption(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(4)))
    e.flush()
    other = engine(spark, tmp_path / "db")
    e.set_delete_before(1)
    with pytest.raises(ConcurrentWrite):
        other.set_delete_before(2)
    storage.delete(spark, f"{e.manifest.segments[0].path}/index")
    with pytest.raises(Corruption):
        engine(spark, tmp_path / "db")
    name = sorted((tmp_path / "db" / "manifest").glob("v*.json"))[-1]
    name.write_text(name.read_text().replace("segments", "segmentz"))
    (name.parent / f".{name.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corruption):
        engine(spark, tmp_path / "db")


def test_bad_points(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    with pytest.raises(ConfigError):
        e.ingest(points(spark, [("s", -1, 1.0, {})]))
    e.ingest(points(spark, []))
    assert e.flush() == 0


def test_delete(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(10) + [("s", 3, 7.0, {"k": "v"})]))
    e.flush()
    assert e.delete("s", 3, 4, {"k": "v"}) == 1 and e.delete("s", 8) == 2 and len(values(e.query("s"))) == 8


def test_encodings_and_size(spark, tmp_path):
    rows = points(spark, [("s", 10**12 + i * 1000, (i % 97) * 0.5, {"host": f"h{i % 4}", "region": "r1", "app": "x"}) for i in range(20000)])
    sizes = {}
    for name, enc in (("raw", Encoding()), ("small", Encoding("gorillaxor", compression="zstd", level=1)), ("lz4", Encoding(compression="lz4"))):
        e = engine(spark, tmp_path / name, enable_wal=False, segment_store=SegmentConfig(encoding=enc))
        e.ingest(rows)
        e.flush()
        assert e.query("s").count() == 20000
        sizes[name] = seg.size(spark, f"{e.manifest.segments[0].path}/points")
    assert sizes["small"] < 0.2 * sizes["raw"] and sizes["lz4"] < sizes["raw"]
    with pytest.raises(ConfigError):
        Encoding(compression="lzma").options()


def test_stream_is_exactly_once(spark, tmp_path):
    from tidemark.streaming.sink import write_stream

    source = tmp_path / "in"
    e = engine(spark, tmp_path / "db", segment_store=SegmentConfig(l0_compaction_trigger_segment_count=2))
    for k in range(3):
        points(spark, [("s", 10 * k + i, float(i), {}) for i in range(10)]).coalesce(1).write.mode("append").parquet(str(source))
        rows = spark.readStream.schema(NEW_POINTS).parquet(str(source))
        write_stream(rows, e, "in", f"file://{tmp_path}/offsets").awaitTermination()
    assert sorted(r["ts"] for r in e.points().collect()) == list(range(30))
    assert not e.ingest_stream_batch(points(spark, line(3)), "in", 0) and e.points().count() == 30


def test_stateful_limit_equals_batch(spark, tmp_path):
    from tidemark.operators.cardinality import admit
    from tidemark.streaming.cardinality import admit_stream

    rows = [("s", i, i, 1.0, {"tenant": f"t{i % 2}", "k": str(i % 5)}) for i in range(20)]
    p = spark.createDataFrame(rows, "series string, ts long, seq long, value double, tags map<string,string>")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = admit_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), 2, "tenant")
    stream.writeStream.format("memory").queryName("adm").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    seen = {r["seq"] for r in spark.table("adm").where("admitted").collect()}
    assert seen == {r["seq"] for r in admit(p, 2, "tenant")[0].collect()} and 0 < len(seen) < 20


def test_config_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("wal_buffer_size = 5\nenable_wal = false\n[segment_store]\nenable_tag_index = false\n[segment_store.encoding]\ncompression = 'zstd'\n")
    c = load(str(f), {"TIDEMARK__ENABLE_WAL": "true", "TIDEMARK__SEGMENT_STORE__ENCODING__LEVEL": "7", "OTHER": "x"}, wal_buffer_size=9)
    assert (c.wal_buffer_size, c.enable_wal, c.segment_store.enable_tag_index) == (9, True, False)
    assert (c.segment_store.encoding.compression, c.segment_store.encoding.level) == ("zstd", 7)
    for bad in ({"TIDEMARK__NOPE": "1"}, {"TIDEMARK__WAL_BUFFER_SIZE": "x"}):
        with pytest.raises(ConfigError):
            load(None, bad)


def test_events(spark, tmp_path):
    seen = []
    e = engine(spark, tmp_path / "db", event_listener=lambda name, fields: seen.append((name, fields)))
    e.ingest(points(spark, line(3)))
    e.snapshot()
    e.set_delete_before(1)
    assert [n for n, _ in seen] == ["SnapshotCreated", "RetentionAdvanced"]
