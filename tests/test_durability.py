"""What a crash, a restore or damage leaves behind; lifetimes of staged tables; large limits; promoted tags; rollups and rules."""

import glob
import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.engine import Engine
from tidemark.model import NEW_POINTS, POINTS, ConfigError, Corruption, EngineConfig, SegmentConfig
from tidemark.operators.cardinality import CardinalityTracker, admit


def points(spark, rows):
    return spark.createDataFrame(rows, NEW_POINTS)


def engine(spark, path, **config):
    return Engine(spark, f"file://{path}", EngineConfig(**config))


def line(n, series="s", start=0):
    return [(series, t, float(t), {}) for t in range(start, start + n)]


def seqs(e):
    return sorted(r["seq"] for r in e.points().collect())


def test_crash_between_commit_and_removal_of_the_log(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(10)))
    e.wal.truncate = lambda *a: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        e.flush()
    with engine(spark, tmp_path / "db") as again:
        assert len(again.wal.batches()) == 1
    assert seqs(again) == list(range(10)) and not again.wal.batches()


def test_ingest_after_a_crash_numbers_above_the_log(spark, tmp_path):
    engine(spark, tmp_path / "db").ingest(points(spark, line(10)))
    with engine(spark, tmp_path / "db") as again:
        again.ingest(points(spark, line(5, start=10)))
    assert seqs(again) == list(range(15))


def test_stream_batch_does_not_hide_what_waits_in_the_log(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(4)))
    e.ingest_stream_batch(points(spark, line(3, "t")), "in", 0)
    again = engine(spark, tmp_path / "db")
    assert again.recover() == 4 and seqs(again) == list(range(7))


def test_memory_mode_keeps_restored_points(spark, tmp_path):
    e = engine(spark, tmp_path / "db", enable_segments=False)
    e.ingest(points(spark, line(10)))
    first = e.snapshot()
    e.ingest(points(spark, line(2, start=20)))
    e.snapshot()
    assert e.restore(first) == 10
    e.ingest(points(spark, line(1, start=50)))
    e.flush()
    assert len(e.fetch("s")) == 11
    again = engine(spark, tmp_path / "db", enable_segments=False)
    again.recover()
    assert [t for t, _ in again.fetch("s")] == [*range(10), 50]
    assert again.delete("s", 5, 7) == 2 and again.delete("s", 5, 7) == 0
    third = engine(spark, tmp_path / "db", enable_segments=False)
    third.recover()
    assert [t for t, _ in third.fetch("s")] == [0, 1, 2, 3, 4, 7, 8, 9, 50]


def test_delete_counts_visible_points_only(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(10)))
    e.flush()
    e.set_delete_before(5)
    version = e.manifest.version
    assert e.delete("s", 2, 5) == 0 and e.manifest.version == version
    assert e.delete("s", 9) == 1 and seqs(e) == [5, 6, 7, 8]


def test_restore_is_one_commit(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, line(5)))
    e.snapshot()
    version = e.manifest.version
    e.restore()
    assert e.manifest.version == version + 1 and len(e.manifest.segments) == 1
    from tidemark.sources import segments as seg

    monkeypatch.setattr(seg, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        e.restore()
    assert len(engine(spark, tmp_path / "db").manifest.segments) == 1


def damage(folder):
    """Change bytes in the middle of the values of the first file."""
    import pyarrow.parquet as pq

    file = sorted(glob.glob(f"{folder}/*.parquet"))[0]
    group = pq.ParquetFile(file).metadata.row_group(0)
    c = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "value")
    p = pathlib.Path(file)
    raw = bytearray(p.read_bytes())
    at = c.data_page_offset + c.total_compressed_size - 8
    raw[at : at + 4] = bytes(b ^ 0xFF for b in raw[at : at + 4])
    p.write_bytes(raw)
    p.with_name(f".{p.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("part", ["log", "segment", "snapshot"])
def test_damage_is_an_error_of_the_engine(spark, tmp_path, part):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, [("pump", 999, 3.14, {"k": "v"}), ("pump", 1005, 2.5, {})]))
    if part == "log":
        damage(next((tmp_path / "db" / "wal").glob("batch-*")))
        again = engine(spark, tmp_path / "db")
        act = again.recover
    elif part == "segment":
        e.flush()
        damage(next((tmp_path / "db" / "segments").glob("seg-*/points")))
        act = lambda: e.fetch("pump")
        with pytest.raises(Corruption):
            e.verify()
    else:
        e.snapshot()
        e.verify()
        damage(next((tmp_path / "db" / "snapshots").glob("snapshot-*")))
        act = e.restore
    with pytest.raises(Corruption) as x:
        act()
    assert (x.value.series, x.value.timestamp) == ("pump", 999)


def test_nothing_stays_staged(spark, tmp_path, monkeypatch):
    made = []  # of this process; others may use the same folder
    inner = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda *a: made.append(inner(*a)) or made[-1])
    e = engine(spark, tmp_path / "db", max_series_cardinality=5000, segment_store=SegmentConfig(reap_grace_s=0))
    for k in range(20):
        e.ingest(points(spark, line(5, f"s{k}")))
        e.flush()
        if k % 7 == 0:
            e.maintain()
    e.delete("s3", 0, 2)
    assert len(e.tracker.paths) <= 17 and len(e.fetch("s3")) == 3
    left = [p for p in made if storage.exists(spark, p)]
    assert len(made) > 60 and [p.rsplit("/", 1)[1].split("-")[0] for p in left] == ["rejected"]


def test_large_limit_is_exact_and_spread(spark):
    n = 4000
    rows = spark.range(n).select(
        F.lit("s").alias("series"), F.col("id").alias("ts"), (F.col("id") * 7919 % n).alias("seq"), F.lit(1.0).alias("value"),
        F.create_map(F.lit("t"), F.when(F.col("id") % 3 == 0, "a").otherwise("hot"), F.lit("k"), (F.col("id") % 2500).cast("string")).alias("tags"),
    )
    known = spark.createDataFrame([("hot", "s", [("k", "7"), ("t", "hot")])], "scope string, series string, key_tags array<struct<key:string,value:string>>")
    good, bad, new = admit(rows, 1500, "t", known)
    taken, allowed = [], {("hot", "7")}
    count = {"hot": 1, "a": 0}
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        key = (r["tags"]["t"], r["tags"]["k"])
        if key not in allowed and count[key[0]] < 1500:
            allowed.add(key)
            count[key[0]] += 1
        if key in allowed:
            taken.append(r["seq"])
    assert sorted(r["seq"] for r in good.collect()) == taken and bad.count() == n - len(taken)
    assert new.count() == len(allowed) - 1
    assert "WindowGroupLimit" not in new._jdf.queryExecution().toString()


def test_tracker_plan_does_not_grow(spark):
    t = CardinalityTracker(spark)
    rows = spark.createDataFrame([("s", k, k, 1.0, {"k": str(k)}) for k in range(6)], POINTS)
    for k in range(4):
        good, bad = t.register(rows.where(F.col("seq") <= k), 3)
    assert (good.count(), bad.count(), t.current_count()) == (3, 1, 3)
    assert t.keys._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_promoted_tags_change_no_result(spark, tmp_path):
    rows = [("s", k, float(k), {"Host": f"h{k % 50}", "host": "x"} if k % 2 else {"a": "b"}) for k in range(2000)]
    plain = engine(spark, tmp_path / "a")
    plain.ingest(points(spark, rows))
    plain.flush()
    mine = engine(spark, tmp_path / "a", segment_store=SegmentConfig(promoted_tags=("Host",)))
    mine.ingest(points(spark, rows))
    mine.flush()
    assert [s.promoted for s in mine.manifest.segments] == [(), ("Host",)]
    for tags in ({"Host": "h7"}, {"Host": "h7", "host": "x"}, {"host": "h7"}, {"a": "b"}, {"Host": "nope"}):
        want = sorted((t, v) for _, t, v, have in rows if tags.items() <= have.items())
        assert mine.fetch("s", tags=tags) == sorted(want * 2)
    plan = mine.query("s", tags={"Host": "h7"})._jdf.queryExecution().toString()
    assert "EqualTo(tag__48_ost,h7)" in plan


def test_postings_use_the_times_of_pairs(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, [("s", 1, 1.0, {"k": "a"}), ("s", 9, 2.0, {"k": "b"})]))
    e.flush()
    assert e.fetch("s", 5, None, {"k": "a"}) == [] and e.metrics.counters["tag_postings_segment_skips"] == 1
    assert e.fetch("s", 5) == [(9, 2.0)]


def test_rollup_and_downsample_of_a_range(spark, tmp_path):
    e = engine(spark, tmp_path / "db")
    e.ingest(points(spark, [("s", t, float(t), {"k": str(t % 2)}) for t in range(20)]))
    e.flush()
    assert [(r["slot_start"], r["n_points"]) for r in e.downsample(10, "s", 5, 15, {"k": "1"}).orderBy("slot_start").collect()] == [(0, 3), (10, 2)]
    with pytest.raises(ConfigError):
        e.rollup(7, 10)
    assert e.rollup(10, 10) == 10
    assert e.fetch("s", 0, 10) == [(0, 4.0), (0, 5.0)] and len(e.fetch("s", 10)) == 10


def test_rules(spark, tmp_path):
    seen = []
    e = engine(spark, tmp_path / "db", event_listener=lambda n, f: seen.append(n))
    e.add_rule(f"file://{tmp_path}/out", lambda p: p.where("value > 2").select("series", "ts"))
    e.add_rule(f"file://{tmp_path}/bad", lambda p: p.select("nothing"))
    for k in range(2):
        e.ingest(points(spark, line(5, start=10 * k)))
        e.flush()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 7 and seen == ["RuleFailed"] * 2
