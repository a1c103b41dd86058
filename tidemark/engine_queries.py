"""Queries of the engine's life: crashes, restarts, memory mode, limits, maintenance, settings, endpoints; registered with the others."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.config import load
from tidemark.engine import Engine
from tidemark.functions.bits import from_bits, with_bits
from tidemark.model import ConfigError, Encoding, EngineConfig, EngineError, SegmentConfig, SeriesNotFound
from tidemark.operators.cardinality import admit
from tidemark.queries import ADMITTED, MID, SQL, A, B, P, _by_series, _day_engine, _engine, _events, query
from tidemark.sources import segments as seg

POINT = ("series", "ts", "value")
DAY = 86_400_000_000_000


def _new(spark: SparkSession, path: str | None = None, **config) -> Engine:
    return Engine(spark, path or storage.new_path(spark, "engine"), EngineConfig(**config))


def _unnumbered(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).drop("seq")


# ---- crashes and restarts


@query
def crash_replay_once(spark, d):
    """A process that ends between the commit of a flush and the removal of its log; the next one opens, flushes and closes."""
    e = _new(spark)
    e.ingest(_unnumbered(spark, d), order=["ts"])
    e._store(e.wal.read(), log_floor=e.next_seq)
    with _new(spark, e.path):
        pass
    return _new(spark, e.path).points().select(*POINT, "seq")


SQL["crash_replay_once"] = f"WITH {P} SELECT series, ts, value, row_number() OVER (ORDER BY ts) - 1 AS seq FROM p"


@query
def reopen_ingest(spark, d):
    """A process that ends with a log; the next one takes in more and closes."""
    points = _unnumbered(spark, d)
    e = _new(spark)
    e.ingest(points.where(F.col("ts") < MID), order=["ts"])
    with _new(spark, e.path) as again:
        again.ingest(points.where(F.col("ts") >= MID), order=["ts"])
    return again.points().select(*POINT, "seq")


SQL["reopen_ingest"] = SQL["crash_replay_once"]


@query
def close_flushes(spark, d):
    with _new(spark) as e:
        e.ingest(_unnumbered(spark, d))
        assert e.get_config().enable_wal
    return _new(spark, e.path).points().select(*POINT)


SQL["close_flushes"] = f"WITH {P} SELECT series, ts, value FROM p"


@query
def log_scan(spark, d):
    e = _new(spark)
    e.ingest(_unnumbered(spark, d).where(F.col("ts") < MID), order=["ts"])
    return e.wal.read().select("series", "ts", "value", "seq", F.col("tags")["k"].alias("k"))


SQL["log_scan"] = f"WITH {P} SELECT series, ts, value, row_number() OVER (ORDER BY ts) - 1 AS seq, k FROM p WHERE ts < {MID}"


@query
def log_markers(spark, d):
    """Batches in the log and markers of flushes, after each of three steps."""
    e, rows = _new(spark), []
    points = _unnumbered(spark, d)
    for step in (lambda: e.ingest(points.where(F.col("ts") < A)), e.flush, lambda: (e.ingest(points.where(F.col("ts") >= B)), e.flush())):
        step()
        rows.append((len(rows), len(e.wal.batches()), len(e.wal.flushes())))
    return spark.createDataFrame(rows, "step int, batches int, markers int")


SQL["log_markers"] = "SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (2, 0, 1)) AS t(step, batches, markers)"


@query
def latest_snapshot(spark, d):
    """Of two snapshots the newest is restored, into a store that has gone on since."""
    points, now = _unnumbered(spark, d), [10**18]
    e = Engine(spark, storage.new_path(spark, "engine"), EngineConfig(), clock=lambda: now[0])
    for lo, hi in ((0, A), (A, MID), (MID, B)):
        e.ingest(points.where((F.col("ts") >= lo) & (F.col("ts") < hi)))
        now[0] += 10**9
        if hi != B:
            e.snapshot()
    e.flush()
    e.restore()
    return e.points().select(*POINT)


SQL["latest_snapshot"] = f"WITH {P} SELECT series, ts, value FROM p WHERE ts < {MID}"


# ---- memory mode


@query
def memory_query(spark, d):
    e = _new(spark, enable_segments=False)
    points = _unnumbered(spark, d)
    for part in (points.where(F.col("ts") < MID), points.where(F.col("ts") >= MID)):
        e.ingest(part)
        e.flush()
    return e.query("view", A, B, {"k": "39"})


SQL["memory_query"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'view' AND ts >= {A} AND ts < {B} AND k = '39'"


@query
def memory_restore_ingest(spark, d):
    e = _new(spark, enable_segments=False)
    points = _unnumbered(spark, d)
    e.ingest(points.where(F.col("ts") < A))
    e.snapshot()
    e.ingest(points.where((F.col("ts") >= A) & (F.col("ts") < MID)))
    e.flush()
    e.restore()
    e.ingest(points.where(F.col("ts") >= B))
    e.flush()
    again = _new(spark, e.path, enable_segments=False)
    again.recover()
    return e.points().unionByName(again.points()).select(*POINT)


SQL["memory_restore_ingest"] = f"""WITH {P}, kept AS (SELECT series, ts, value FROM p WHERE ts < {A} OR ts >= {B})
SELECT * FROM kept UNION ALL SELECT * FROM kept"""


@query
def memory_series(spark, d):
    e = _new(spark, enable_segments=False, enable_wal=False)
    e.ingest(_unnumbered(spark, d))
    e.flush()
    return e.list_series({"user": "7"})


SQL["memory_series"] = f"WITH {P} SELECT DISTINCT series FROM p WHERE u = '7'"


# ---- retrieval


@query
def range_errors(spark, d):
    """What a store says to ranges and series: the name of the error, or the number of points."""
    e, rows = _day_engine(spark, d), []
    for series, start, end in (("view", MID, MID), ("view", B, A), ("view", -1, None), ("none", A, B), ("none", B, A), ("view", 0, 1), ("view", A, B)):
        try:
            rows.append((series, start, end, str(e.query(series, start, end).count())))
        except EngineError as error:
            rows.append((series, start, end, type(error).__name__))
    return spark.createDataFrame(rows, "series string, from_ts long, to_ts long, said string")


SQL["range_errors"] = f"""WITH {P} SELECT * FROM (VALUES ('view', {MID}, {MID}, 'InvalidTimeRange'), ('view', {B}, {A}, 'InvalidTimeRange'),
 ('view', -1, NULL, 'InvalidTimeRange'), ('none', {A}, {B}, 'SeriesNotFound'), ('none', {B}, {A}, 'InvalidTimeRange'), ('view', 0, 1, '0')) AS t(series, from_ts, to_ts, said)
UNION ALL SELECT 'view', {A}, {B}, CAST(count(*) AS VARCHAR) FROM p WHERE series = 'view' AND ts >= {A} AND ts < {B}"""


@query
def known_series(spark, d):
    e, rows = _day_engine(spark, d), []
    for name in ("view", "click", "error", "View", "", "zzz"):
        try:
            e.query(name, A, A + 1)
            rows.append((name, True))
        except SeriesNotFound:
            rows.append((name, False))
    return spark.createDataFrame(rows, "series string, known boolean")


SQL["known_series"] = f"""WITH {P} SELECT n AS series, n IN (SELECT series FROM p) AS known
FROM (VALUES ('view'), ('click'), ('error'), ('View'), (''), ('zzz')) AS t(n)"""


@query
def index_toggle(spark, d):
    """The same query with postings, with postings that the reader ignores, and without any."""
    on, off = _day_engine(spark, d), _engine(spark, enable_tag_index=False)
    off._store(_events(spark, d))
    ignoring = Engine(spark, on.path, EngineConfig(segment_store=SegmentConfig(enable_tag_index=False)))
    out = None
    for e in (on, ignoring, off):
        part = e.query("view", tags={"k": "39", "user": "7"})
        out = part if out is None else out.unionByName(part)
    return out


SQL["index_toggle"] = f"""WITH {P}, q AS (SELECT ts, value FROM p WHERE series = 'view' AND k = '39' AND u = '7')
SELECT * FROM q UNION ALL SELECT * FROM q UNION ALL SELECT * FROM q"""


@query
def promoted_tag_query(spark, d):
    """Segments with and without columns of their own for tags, in one query."""
    e = _engine(spark)
    e._store(_events(spark, d).where(F.col("ts") < MID))
    e = Engine(spark, e.path, EngineConfig(enable_wal=False, segment_store=SegmentConfig(promoted_tags=("k", "user"))))
    e._store(_events(spark, d).where(F.col("ts") >= MID))
    return e.query("view", tags={"k": "39"})


SQL["promoted_tag_query"] = SQL["tag_filter_single"]


@query
def sorted_points(spark, d):
    """The place of each point in the files of a segment: by series, time and number."""
    e = _engine(spark)
    e._store(_events(spark, d))
    rows = seg.points_of(spark, list(e.manifest.segments)).select("series", "ts", "seq", "_metadata.file_name", "_metadata.row_index")
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = rows.groupBy("file_name").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return rows.join(files, "file_name").select("series", "ts", "seq", (F.col("before") + F.col("row_index") + 1).alias("place"))


SQL["sorted_points"] = f"WITH {P} SELECT series, ts, seq, row_number() OVER (ORDER BY series, ts, seq) AS place FROM p"


@query
def downsample_range(spark, d):
    return _day_engine(spark, d).downsample(DAY, "view", A, B, {"k": "39"}).drop("total")


SQL["downsample_range"] = f"""WITH {P} SELECT series, ts // {DAY} * {DAY} AS slot_start, count(*) AS n_points, min(value) AS low, max(value) AS high,
 arg_min(value, (ts, seq)) AS first_value, arg_max(value, (ts, seq)) AS last_value
FROM p WHERE series = 'view' AND ts >= {A} AND ts < {B} AND k = '39' GROUP BY 1, 2"""


@query
def rollup_replaces(spark, d):
    e = _day_engine(spark, d)
    e.rollup(MID, DAY)
    return e.points().select("series", "ts", F.col("tags")["k"].alias("k"), F.round("value", 6).alias("value"))


SQL["rollup_replaces"] = f"""WITH {P} SELECT series, ts, k, round(value, 6) AS value FROM p WHERE ts >= {MID}
UNION ALL SELECT series, ts // {DAY} * {DAY}, k, round(avg(value), 6) FROM p WHERE ts < {MID} GROUP BY series, ts // {DAY}, u, k"""


@query
def sql_view_query(spark, d):
    _day_engine(spark, d).sql_view("tidemark_points")
    return spark.sql("SELECT series, tags['k'] AS k, count(*) AS n FROM tidemark_points GROUP BY 1, 2 HAVING count(*) > 3")


SQL["sql_view_query"] = f"WITH {P} SELECT series, k, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 3"


# ---- storage


@query
def encodings_roundtrip(spark, d):
    out = None
    for encoding in (Encoding(), Encoding("gorillaxor", compression="zstd", level=1), Encoding(compression="lz4")):
        e = _engine(spark, encoding=encoding)
        e._store(_events(spark, d))
        part = e.points().select("seq", "ts", "value", F.col("tags")["user"].alias("user"), F.lit(f"{encoding.float_encoding} {encoding.compression}").alias("encoding"))
        out = part if out is None else out.unionByName(part)
    return out


SQL["encodings_roundtrip"] = f"""WITH {P} SELECT seq, ts, value, u AS user, encoding
FROM p, (VALUES ('raw64 none'), ('gorillaxor zstd'), ('raw64 lz4')) AS t(encoding)"""


@query
def bits_roundtrip(spark, d):
    rows = with_bits(_events(spark, d).select("seq", "value"))
    return from_bits(rows.drop("value")).select("seq", "value", (F.col("value_bits") < 0).alias("negative"))


SQL["bits_roundtrip"] = f"WITH {P} SELECT seq, value, value < 0 AS negative FROM p"


@query
def delete_counts(spark, d):
    """Numbers that a deletion returns: visible points only, each once."""
    e, rows = _day_engine(spark, d), []
    e.set_delete_before(MID)
    for what, arguments in (("hidden", (0, MID)), ("one tag", (A, B, {"k": "39"})), ("again", (A, B, {"k": "39"})), ("rest", ())):
        rows.append((what, e.delete("view", *arguments)))
    left = e.points().where("series = 'view'").count()
    return spark.createDataFrame([*rows, ("left", left)], "what string, n long")


SQL["delete_counts"] = f"""WITH {P}, v AS (SELECT *, ts < {B} AND k = '39' AS tagged FROM p WHERE series = 'view' AND ts >= {MID})
SELECT 'hidden' AS what, 0 AS n UNION ALL SELECT 'one tag', count(*) FILTER (tagged) FROM v UNION ALL SELECT 'again', 0
UNION ALL SELECT 'rest', count(*) FILTER (NOT tagged) FROM v UNION ALL SELECT 'left', 0"""


@query
def ttl_visible(spark, d):
    """A time to live of 14 days at a fixed clock: what is older is hidden at once and gone after maintenance."""
    now = [B]
    config = EngineConfig(enable_wal=False, retention_ttl_s=14 * 86400)
    e = Engine(spark, storage.new_path(spark, "engine"), config, clock=lambda: now[0])
    e.ingest(_unnumbered(spark, d))
    e.flush()
    now[0] += DAY
    e.maintain()
    return e.points().select(*POINT)


SQL["ttl_visible"] = f"WITH {P} SELECT series, ts, value FROM p WHERE ts >= {B} + {DAY} - 14 * {DAY}"


@query
def compaction_triggers(spark, d):
    """Whether compaction is due with four segments under several settings, and the counts it returns."""
    e, rows = _day_engine(spark, d), []
    c = e.config.segment_store
    total, oldest = sum(s.bytes for s in e.manifest.segments), min(s.created_ns for s in e.manifest.segments)
    e.clock = lambda: oldest + 10 * 10**9
    for what, settings in (
        ("count 4", (4, None, None)), ("count 5", (5, None, None)), ("bytes", (9, total, None)), ("more bytes", (9, total + 1, None)),
        ("age", (9, None, 10.0)), ("more age", (9, None, 10.5)),
    ):
        c.l0_compaction_trigger_segment_count, c.l0_compaction_trigger_total_bytes, c.l0_compaction_trigger_max_age_s = settings
        rows.append((what, str(e.compaction_due())))
    rows += [("compacted", str(e.compact())), ("again", str(e.compact())), ("levels", str([s.level for s in e.manifest.segments]))]
    return spark.createDataFrame(rows, "what string, said string")


SQL["compaction_triggers"] = """SELECT * FROM (VALUES ('count 4', 'True'), ('count 5', 'False'), ('bytes', 'True'), ('more bytes', 'False'), ('age', 'True'),
 ('more age', 'False'), ('compacted', '(4, 1)'), ('again', '(0, 0)'), ('levels', '[1]')) AS t(what, said)"""


@query
def reap_after_grace(spark, d):
    """Folders of segments on disk after compaction, within the grace period and after it."""
    e, rows = _day_engine(spark, d), []
    e.compact()
    grace = int(e.config.segment_store.reap_grace_s * 1e9)
    for what, at in (("within", 0), ("after", 2 * grace)):
        n = e.reap(e.clock() + at)
        rows.append((what, n, len(storage.listing(spark, e.root))))
    return spark.createDataFrame(rows, "what string, reaped int, folders int")


SQL["reap_after_grace"] = "SELECT * FROM (VALUES ('within', 0, 5), ('after', 4, 1)) AS t(what, reaped, folders)"


@query
def background_loop(spark, d):
    """Flush, maintenance and snapshots by the loop; the query waits until it has done each."""
    config = EngineConfig(flush_interval_s=0.1, snapshot_interval_s=0.1, segment_store=SegmentConfig(l0_compaction_trigger_segment_count=2, compaction_check_interval_s=0.1))
    e, points = Engine(spark, storage.new_path(spark, "engine"), config), _unnumbered(spark, d)
    e.start()
    until = time.monotonic() + 120
    for part in (points.where(F.col("ts") < MID), points.where(F.col("ts") >= MID)):
        n = e.metrics.counters["flush_points"]
        e.ingest(part)
        while e.metrics.counters["flush_points"] == n and time.monotonic() < until:
            time.sleep(0.05)
    while not ([s.level for s in e.manifest.segments] == [1] and e.snapshots.times()) and time.monotonic() < until:
        time.sleep(0.05)
    e.close()
    return e.points().select(*POINT, F.lit(len(e.manifest.segments)).alias("segments"), F.lit(len(e.snapshots.times()) > 0).alias("snapshots"))


SQL["background_loop"] = f"WITH {P} SELECT series, ts, value, CAST(1 AS INTEGER) AS segments, true AS snapshots FROM p"


@query
def rule_output(spark, d):
    """A continuous query over two flushes and a micro-batch of a stream."""
    e, target, points = _new(spark), storage.new_path(spark, "rule"), _unnumbered(spark, d)
    e.add_rule(target, lambda p: p.where("series = 'error'").select("ts", "value"))
    for part in (points.where(F.col("ts") < A), points.where((F.col("ts") >= A) & (F.col("ts") < MID))):
        e.ingest(part)
        e.flush()
    e.ingest_stream_batch(points.where(F.col("ts") >= MID), "in", 0)
    return spark.read.parquet(target)


SQL["rule_output"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'error'"


# ---- limits


@query
def cardinality_admit_large(spark, d):
    """A limit above the size at which Spark cuts a ranking early, so that hot scopes are ranked in pieces."""
    return admit(_by_series(spark, d), 1500, "type")[0].select("series", "ts", "seq", "value")


SQL["cardinality_admit_large"] = f"WITH {ADMITTED} SELECT series, ts, seq, value FROM p JOIN r USING (series, u, k) WHERE n <= 1500"


@query
def limit_survives_restart(spark, d):
    """Keys of a first process, half of them in the log only, count in the second; retention frees none."""
    points = _by_series(spark, d).drop("seq")
    config = {"max_series_cardinality": 300, "cardinality_scope_tag_key": "type"}
    e = _new(spark, **config)
    e.ingest(points.where(F.col("ts") < A), order=["ts"], on_limit="split")
    e.flush()
    e.ingest(points.where((F.col("ts") >= A) & (F.col("ts") < MID)), order=["ts"], on_limit="split")
    e = _new(spark, e.path, **config)
    e.set_delete_before(A)
    e.maintain()
    e.ingest(points.where(F.col("ts") >= MID), order=["ts"], on_limit="split")
    e.close()
    return e.points().select("series", "ts", "value")


SQL["limit_survives_restart"] = f"""WITH {P}, s AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM p),
f AS (SELECT series, u, k, min(pos) AS first FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY first) AS n FROM f)
SELECT series, ts, value FROM s JOIN r USING (series, u, k) WHERE n <= 300 AND ts >= {A}"""


@query
def scope_names(spark, d):
    """Scopes with characters that mean something in paths, stored, read by another process, and counted."""
    odd = F.concat_ws("", F.element_at(F.array(*[F.lit(x) for x in ("a/b", "c=d", "e%20f", "007", "é 漢", "")]), (F.col("seq") % 6 + 1).cast("int")))
    points = _events(spark, d).withColumn("tags", F.map_concat("tags", F.create_map(F.lit("tenant"), odd))).drop("seq")
    config = {"max_series_cardinality": 10**9, "cardinality_scope_tag_key": "tenant"}
    e = _new(spark, **config)
    e.ingest(points)
    return _new(spark, e.path, **config).tracker.counts()


SQL["scope_names"] = f"""WITH {P} SELECT ['a/b', 'c=d', 'e%20f', '007', 'é 漢', 'default'][seq % 6 + 1] AS scope, count(DISTINCT (series, u, k)) AS series_keys
FROM p GROUP BY 1"""


@query
def stateful_limit(spark, d):
    """The limit as a stateful operator on a stream of three micro-batches, in order of number."""
    from tidemark.streaming.cardinality import admit_stream

    source, points = storage.new_path(spark, "stream"), _by_series(spark, d)
    n = points.count()
    for k in range(3):  # files of later numbers are newer, so they come in later batches
        points.where((F.col("seq") * 3 >= n * k) & (F.col("seq") * 3 < n * (k + 1))).coalesce(1).write.mode("append").parquet(source)
    top = points.where(F.col("seq") * 3 >= n * 3)
    if not top.isEmpty():
        top.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = storage.new_path(spark, "admitted")
    admit_stream(stream, 200, "type").writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("series", "ts", "seq", "admitted")


SQL["stateful_limit"] = f"WITH {ADMITTED} SELECT series, ts, seq, n <= 200 AS admitted FROM p JOIN r USING (series, u, k)"


# ---- what others see of an engine


@query
def metrics_counts(spark, d):
    """Counters after a batch, a rejected part of one, a flush and a skip by postings."""
    e = _new(spark, max_series_cardinality=100, cardinality_scope_tag_key="type")
    e.ingest(_by_series(spark, d).drop("seq"), order=["ts"], on_limit="split")
    e.flush()
    e.query("view", tags={"k": "no such"})
    c = e.get_metrics()
    rows = [(n, int(c["counters"][n])) for n in ("ingest_points", "flush_points", "cardinality_limit_rejections", "tag_postings_segment_skips")]
    rows += [(n, int(c["timings"][n][0])) for n in ("flush_duration_seconds", "flush_end_to_end_seconds", "wal_fsync_duration_seconds")]
    rows += [(n, int(x)) for n, x in c["gauges"].items() if n.startswith("series_cardinality")]
    return spark.createDataFrame(rows, "name string, n long")


SQL["metrics_counts"] = f"""WITH {P}, s AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM p),
f AS (SELECT series, u, k, min(pos) AS first FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY first) AS n FROM f),
c AS (SELECT count(*) FILTER (n <= 100) AS good, count(*) FILTER (n > 100) AS bad FROM s JOIN r USING (series, u, k))
SELECT 'ingest_points' AS name, good AS n FROM c UNION ALL SELECT 'flush_points', good FROM c UNION ALL SELECT 'cardinality_limit_rejections', bad FROM c
UNION ALL SELECT name, 1 FROM (VALUES ('tag_postings_segment_skips'), ('flush_duration_seconds'), ('flush_end_to_end_seconds'), ('wal_fsync_duration_seconds')) AS t(name)
UNION ALL SELECT 'series_cardinality{{scope=' || series || '}}', count(*) FILTER (n <= 100) FROM r GROUP BY series"""


@query
def events_emitted(spark, d):
    seen: list[str] = []
    e = _new(spark, event_listener=lambda name, fields: seen.append(name))
    e.ingest(_unnumbered(spark, d).where(F.col("ts") < A))
    e.start()
    e.stop()
    e.snapshot()
    e.set_delete_before(1)
    e.set_delete_before(1)
    return spark.createDataFrame(list(enumerate(seen)), "step int, name string")


SQL["events_emitted"] = """SELECT CAST(step AS INTEGER) AS step, name FROM (VALUES (0, 'FlushThreadStarted'), (1, 'FlushThreadStopping'), (2, 'SnapshotCreated'),
 (3, 'RetentionAdvanced')) AS t(step, name)"""


@query
def config_layers(spark, d):
    """Defaults, a variable of the environment over them, an argument over both, and what is refused."""
    c = load(None, {"TIDEMARK__FLUSH_INTERVAL_S": "5", "TIDEMARK__SEGMENT_STORE__ENCODING__COMPRESSION": "zstd", "TIDEMARK__WAL_BUFFER_SIZE": "7"}, wal_buffer_size=9)
    rows = [("flush_interval_s", str(c.flush_interval_s)), ("compression", c.segment_store.encoding.compression), ("wal_buffer_size", str(c.wal_buffer_size)), ("snapshot_interval_s", str(c.snapshot_interval_s))]
    for env in ({"TIDEMARK__NO_SUCH": "1"}, {"TIDEMARK__WAL_BUFFER_SIZE": "many"}):
        try:
            load(None, env)
        except ConfigError:
            rows.append((next(iter(env)), "refused"))
    return spark.createDataFrame(rows, "name string, value string")


SQL["config_layers"] = """SELECT * FROM (VALUES ('flush_interval_s', '5.0'), ('compression', 'zstd'), ('wal_buffer_size', '9'), ('snapshot_interval_s', '900.0'),
 ('TIDEMARK__NO_SUCH', 'refused'), ('TIDEMARK__WAL_BUFFER_SIZE', 'refused')) AS t(name, value)"""


@query
def health_endpoints(spark, d):
    from tidemark.daemon import Service

    e = _new(spark)
    e.ingest(_unnumbered(spark, d).where(F.col("ts") < A))
    s, rows = Service(Engine(spark, e.path, EngineConfig()), port=0), []
    rows.append(("before", s.answer("/readyz")[0]))
    s.start()
    for path in ("/healthz", "/readyz", "/metrics", "/nothing"):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{s.port}{path}", timeout=10) as r:
                rows.append((path, r.status))
        except urllib.error.HTTPError as error:
            rows.append((path, error.code))
    s.stop()
    rows.append(("points", Engine(spark, e.path).points().count()))
    return spark.createDataFrame(rows, "asked string, answer long")


SQL["health_endpoints"] = f"""WITH {P} SELECT * FROM (VALUES ('before', 503), ('/healthz', 200), ('/readyz', 200), ('/metrics', 200), ('/nothing', 404)) AS t(asked, answer)
UNION ALL SELECT 'points', count(*) FROM p WHERE ts < {A}"""


@query
def tenant_isolation(spark, d):
    """The same series and times in two namespaces; what one deletes stays in the other."""
    from tidemark.tenants import Tenants

    root, points = storage.new_path(spark, "tenants"), _unnumbered(spark, d)
    t = Tenants(spark, root)
    for name, part in (("acme/Prod", points.where(F.col("ts") < MID)), ("beta é", points.where(F.col("ts") < A))):
        t.engine(name).ingest(part)
        t.engine(name).flush()
    t.engine("acme/Prod").delete("view")
    t.close()
    t, out = Tenants(spark, root), None
    for name in t.names():
        part = t.engine(name).points().select(F.lit(name).alias("tenant"), *POINT)
        out = part if out is None else out.unionByName(part)
    return out


SQL["tenant_isolation"] = f"""WITH {P} SELECT 'acme/Prod' AS tenant, series, ts, value FROM p WHERE ts < {MID} AND series <> 'view'
UNION ALL SELECT 'beta é', series, ts, value FROM p WHERE ts < {A}"""
