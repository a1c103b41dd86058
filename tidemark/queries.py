"""Queries over the test tables by name, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.engine import Engine
from tidemark.functions.tags import scope, series_key, tag_terms
from tidemark.model import EngineConfig, SegmentConfig
from tidemark.operators import query as q
from tidemark.operators.cardinality import admit
from tidemark.operators import grid, incremental, late, rolling, small_files, spikes
from tidemark.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# The bounds between the units of time, as in functions.clean.
NS = """CASE WHEN abs(ts) < 100000000000 THEN ts * 1000000000 WHEN abs(ts) < 100000000000000 THEN ts * 1000000
 WHEN abs(ts) < 100000000000000000 THEN ts * 1000 ELSE ts END"""
POINTS = f"pts AS (SELECT DISTINCT series, {NS} AS ts, seq, value FROM points)"
FINITE = "fin AS (SELECT * FROM pts WHERE NOT isnan(value) AND NOT isinf(value))"
BASE = r"regexp_extract(trim(url_decode(replace(trim(file_name), '+', '%2B'))), '([^/\\]*)$', 1)"


def _compacted(spark: SparkSession, d: str) -> small_files.Compaction:
    out = storage.new_path(spark, "compacted")
    return small_files.compact(spark, f"{d}/segment_rows.parquet", table(spark, d, "segments"), out)


@query
def p2_found(spark, d):
    # from the packed output and the list of copies that is published with it
    return small_files.overlapping_segments(_compacted(spark, d).presence, table(spark, d, "segments"))


SQL["p2_found"] = f"""
WITH live AS (SELECT DISTINCT segment_id, {BASE} AS file FROM segments WHERE retired_at IS NULL),
held AS (SELECT DISTINCT segment_id, file, seq FROM live JOIN (SELECT DISTINCT {BASE} AS file, seq FROM segment_rows) USING (file))
SELECT DISTINCT a.segment_id AS segment_a, b.segment_id AS segment_b FROM held a JOIN held b ON a.seq = b.seq AND a.segment_id < b.segment_id
UNION SELECT a.segment_id, b.segment_id FROM live a JOIN live b ON a.file = b.file AND a.segment_id < b.segment_id"""


@query
def p2_compacted(spark, d):
    return _compacted(spark, d).records.select("series", "ts", "seq", "value", F.size("tags").alias("n_tags"))


SQL["p2_compacted"] = f"""
SELECT series, ts, seq, value, CAST(cardinality(tags) AS INTEGER) AS n_tags FROM (
 SELECT DISTINCT series, ts, seq, value, tags FROM segment_rows
 WHERE {BASE} IN (SELECT {BASE} FROM segments WHERE retired_at IS NULL))"""


@query
def p3_found(spark, d):
    return rolling.inactive_days(rolling.rolling_totals(table(spark, d, "points"), (7, 30)), 30)


SQL["p3_found"] = f"""
WITH {POINTS}, {FINITE},
days AS (SELECT DISTINCT series, ts // 86400000000000 AS day FROM fin),
gaps AS (SELECT series, day, lead(day) OVER (PARTITION BY series ORDER BY day) AS next_day FROM days)
SELECT series, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS calendar_day
FROM gaps, unnest(range(day + 1, next_day)) AS u(d) WHERE next_day - day BETWEEN 2 AND 30"""


@query
def p3_rolling(spark, d):
    r = rolling.rolling_totals(table(spark, d, "points"), (7, 30))
    out = ["series", F.date_format("day", "yyyy-MM-dd").alias("calendar_day")]
    for w in (7, 30):
        total = F.round(f"total_{w}d", 6)
        n = F.col(f"points_{w}d")
        out += [total.alias(f"total_{w}d"), F.when(n > 0, total / n).alias(f"avg_{w}d"), n]
    return r.select(*out)


SQL["p3_rolling"] = f"""
WITH {POINTS}, {FINITE},
daily AS (SELECT series, ts // 86400000000000 AS day, sum(value) AS t, count(*) AS n FROM fin GROUP BY 1, 2),
cal AS (SELECT series, unnest(range(min(day), max(day) + 1)) AS day FROM daily GROUP BY series),
w AS (SELECT c.series, c.day,
 round(coalesce(sum(t) FILTER (c.day - d.day < 7), 0), 6) AS t7, CAST(coalesce(sum(n) FILTER (c.day - d.day < 7), 0) AS BIGINT) AS n7,
 round(coalesce(sum(t), 0), 6) AS t30, CAST(coalesce(sum(n), 0) AS BIGINT) AS n30
 FROM cal c LEFT JOIN daily d ON c.series = d.series AND d.day BETWEEN c.day - 29 AND c.day GROUP BY 1, 2)
SELECT series, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS calendar_day,
 t7 AS total_7d, CASE WHEN n7 > 0 THEN t7 / n7 END AS avg_7d, n7 AS points_7d,
 t30 AS total_30d, CASE WHEN n30 > 0 THEN t30 / n30 END AS avg_30d, n30 AS points_30d FROM w"""


@query
def p4_found(spark, d):
    return spikes.implausible(table(spark, d, "points"), table(spark, d, "series_catalog"))


@query
def p5_found(spark, d):
    made = grid.regular_grid(table(spark, d, "points"), table(spark, d, "series_catalog"), max_gap_days=30)
    return grid.missing_slots(made, 30)


STEPS = "steps AS (SELECT series, min(step_ms) * 1000000 AS step FROM series_catalog WHERE step_ms > 0 GROUP BY series)"
SLOTS = f"""{POINTS}, {FINITE}, {STEPS},
r AS (SELECT series, ts, seq, value, step, ts // step AS slot FROM fin JOIN steps USING (series))"""
SQL["p5_found"] = f"""
WITH {SLOTS},
g AS (SELECT series, step, slot, ts, lead(ts) OVER w AS next_ts, lead(slot) OVER w AS next_slot FROM r
 WINDOW w AS (PARTITION BY series ORDER BY ts, seq, value))
SELECT series, s * step AS slot_start FROM g, unnest(range(slot + 1, next_slot)) AS u(s)
WHERE next_slot > slot + 1 AND next_ts - ts <= 2592000000000000"""


@query
def p5_grid(spark, d):
    made = grid.regular_grid(table(spark, d, "points"), table(spark, d, "series_catalog"))
    return made.withColumns({c: F.col(c) + 0.0 for c in ("value", "carried")})  # one zero, as in the SQL


SQL["p5_grid"] = f"""
WITH {SLOTS},
s AS (SELECT series, step, slot, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(value, (ts, seq, value)) AS v FROM r GROUP BY 1, 2, 3),
g AS (SELECT *, lead(slot) OVER w AS next_slot, lead(first_ts) OVER w AS next_ts FROM s WINDOW w AS (PARTITION BY series ORDER BY slot))
SELECT series, slot * step AS slot_start, 'observed' AS state, v + 0.0 AS value, v + 0.0 AS carried, last_ts AS prev_ts, last_ts AS next_ts FROM g
UNION ALL SELECT series, k * step, 'missing', NULL, v + 0.0, last_ts, next_ts FROM g, unnest(range(slot + 1, next_slot)) AS u(k) WHERE next_slot > slot + 1"""


@query
def p6_found(spark, d):
    wal = table(spark, d, "wal_entries")
    ledger = incremental.Ledger(spark, storage.new_path(spark, "ledger"))
    within = wal.where((F.col("kind") == "Insert") & F.col("seq").isNotNull())
    ledger.adopt(incremental.held_values(table(spark, d, "segment_rows"), table(spark, d, "segments"), within))
    return ledger.run(wal).select("seq")


SQL["p6_found"] = f"""
WITH latest AS (SELECT seq, arg_max(value, entry_no) AS value FROM wal_entries WHERE kind = 'Insert' AND seq IS NOT NULL GROUP BY seq),
held AS (SELECT DISTINCT seq, value FROM segment_rows WHERE {BASE} IN (SELECT {BASE} FROM segments WHERE retired_at IS NULL))
SELECT seq FROM latest l WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.seq = l.seq AND h.value IS NOT DISTINCT FROM l.value)"""


@query
def p6_second_run(spark, d):
    """What a second run finds after one over the first half of the log, whose output keeps neither numbers nor values."""
    wal = table(spark, d, "wal_entries")
    lo, hi = wal.agg(F.min("entry_no"), F.max("entry_no")).first()
    ledger = incremental.Ledger(spark, storage.new_path(spark, "ledger"))
    ledger.run(wal.where(F.col("entry_no") <= ((lo + hi) // 2 if lo is not None else 0)), lambda todo: todo.groupBy("series").count())
    return ledger.run(wal).select("seq", "value")


SQL["p6_second_run"] = """
WITH cut AS (SELECT (min(entry_no) + max(entry_no)) // 2 AS mid FROM wal_entries),
ins AS (SELECT * FROM wal_entries WHERE kind = 'Insert' AND seq IS NOT NULL),
one AS (SELECT seq, arg_max(value, entry_no) AS value FROM ins, cut WHERE entry_no <= mid GROUP BY seq),
two AS (SELECT seq, arg_max(value, entry_no) AS value FROM ins, cut WHERE entry_no > mid GROUP BY seq)
SELECT seq, value FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.seq = two.seq AND one.value IS NOT DISTINCT FROM two.value)"""


@query
def p7_found(spark, d):
    points = table(spark, d, "points")
    lo, hi = points.agg(F.min("seq"), F.max("seq")).first()
    views = late.LambdaHours(points, table(spark, d, "series_catalog"), keep_late=True)
    if lo is not None:
        views.batch(lo + (hi - lo) // 2)
        views.fast(lo + (hi - lo) * 3 // 4)
        views.fast(hi + 1)
    return views.serve_late()


LATE = f"""{POINTS},
late_ns AS (SELECT series, coalesce(max(lateness_s), 0) * 1000000000 AS ln FROM series_catalog GROUP BY series),
m AS (SELECT p.*, p.ts // 3600000000000 AS hour, coalesce(ln, 0) AS ln,
 max(ts) OVER (PARTITION BY p.series ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
 FROM pts p LEFT JOIN late_ns USING (series)),
marked AS (SELECT *, coalesce(seen >= (hour + 1) * 3600000000000 + ln, false) AS late FROM m)"""
SQL["p7_found"] = f"WITH {LATE} SELECT DISTINCT seq FROM marked WHERE late"


def _hours(spark: SparkSession, d: str, *shares: tuple[str, int]) -> DataFrame:
    """Hours served after steps (``batch`` or ``fast``) that reach so many eighths of the numbers of arrival."""
    points = table(spark, d, "points")
    lo, hi = points.agg(F.min("seq"), F.max("seq")).first()
    views = late.LambdaHours(points, table(spark, d, "series_catalog"))
    for step, share in shares if lo is not None else ():
        getattr(views, step)(lo + (hi + 1 - lo) * share // 8)
    return views.serve().withColumn("total", F.round("total", 6))


@query
def p7_hourly(spark, d):
    return _hours(spark, d, ("batch", 4), ("fast", 6), ("fast", 8))


SQL["p7_hourly"] = f"""
WITH {LATE}, f AS (SELECT *, NOT late AND NOT isnan(value) AND NOT isinf(value) AS used FROM marked)
SELECT series, hour, count(*) FILTER (used) AS points, round(sum(value) FILTER (used), 6) AS total, min(value) FILTER (used) AS low,
 max(value) FILTER (used) AS high, count(*) FILTER (late) AS left_out FROM f GROUP BY 1, 2"""


@query
def p7_rebatched(spark, d):
    return _hours(spark, d, ("batch", 3), ("fast", 5), ("batch", 6), ("fast", 7), ("fast", 8), ("batch", 7))


SQL["p7_rebatched"] = SQL["p7_hourly"]


# ---- storage and retrieval, over events as points

P = """p AS (SELECT event_type AS series, epoch_us(ts) * 1000 AS ts, event_id AS seq, value,
 CAST(user_id AS VARCHAR) AS u, json_extract_string(props, '$.k') AS k FROM events)"""
# Times of the queries, in ns: 2024-01-08, 2024-01-15 and 2024-01-22, 0 h UTC.
A, MID, B = 1704672000000000000, 1705276800000000000, 1705881600000000000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.from_events(table(spark, d, "events"))


def _engine(spark: SparkSession, **segment_config) -> Engine:
    return Engine(spark, storage.new_path(spark, "engine"), EngineConfig(enable_wal=False, segment_store=SegmentConfig(**segment_config)))


def _day_engine(spark: SparkSession, d: str, cuts: tuple[int, ...] = (A, MID, B)) -> Engine:
    """Events in four segments by time, with the numbers that the events have."""
    e, points = _engine(spark), _events(spark, d)
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = points
        part = part if lo is None else part.where(F.col("ts") >= lo)
        part = part if hi is None else part.where(F.col("ts") < hi)
        e._store(part)
    return e


@query
def range_scan(spark, d):
    return q.select_points(_events(spark, d), "error", A, B)


SQL["range_scan"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'error' AND ts >= {A} AND ts < {B}"


@query
def range_boundary(spark, d):
    points = _events(spark, d)
    lo, hi = points.where("series = 'error'").agg(F.min("ts"), F.max("ts")).first()
    return q.select_points(points, "error", lo, hi)


SQL["range_boundary"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'error' AND ts < (SELECT max(ts) FROM p WHERE series = 'error')"


@query
def tag_filter_single(spark, d):
    return q.select_points(_events(spark, d), "view", tags={"k": "39"})


SQL["tag_filter_single"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'view' AND k = '39'"


@query
def tag_filter_and(spark, d):
    return q.select_points(_events(spark, d), "view", tags={"k": "39", "user": "7"})


SQL["tag_filter_and"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'view' AND k = '39' AND u = '7'"


@query
def tag_filter_empty(spark, d):
    return q.select_points(_events(spark, d), "view", tags={})


SQL["tag_filter_empty"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'view'"


@query
def tag_filter_nomatch(spark, d):
    return q.select_points(_events(spark, d), "view", tags={"k": "39", "rack": "r1"})


SQL["tag_filter_nomatch"] = f"WITH {P} SELECT ts, value FROM p WHERE false"


@query
def retention_visible(spark, d):
    e = _day_engine(spark, d)
    e.set_delete_before(MID)
    return e.query("click", A)


SQL["retention_visible"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'click' AND ts >= greatest({A}, {MID})"


@query
def segment_union_bag(spark, d):
    e, points = _engine(spark), _events(spark, d)
    e._store(points.where(F.col("ts") < B))
    e._store(points.where(F.col("ts") >= A))
    return e.query("purchase")


SQL["segment_union_bag"] = f"""WITH {P} SELECT ts, value FROM p WHERE series = 'purchase' AND ts < {B}
UNION ALL SELECT ts, value FROM p WHERE series = 'purchase' AND ts >= {A}"""


@query
def compaction_preserves(spark, d):
    e = _day_engine(spark, d)
    e.compact()
    return e.query("signup", tags={"k": "5"})


SQL["compaction_preserves"] = f"WITH {P} SELECT ts, value FROM p WHERE series = 'signup' AND k = '5'"


@query
def reclaim_physical(spark, d):
    e = _day_engine(spark, d)
    e.set_delete_before(MID + 3_600_000_000_000)
    e.reclaim()
    return e.points().select("series", "ts", "seq", "value")


SQL["reclaim_physical"] = f"WITH {P} SELECT series, ts, seq, value FROM p WHERE ts >= {MID} + 3600000000000"


@query
def ingest_drop_late(spark, d):
    e = _engine(spark)
    e.set_delete_before(MID)
    e.ingest(_events(spark, d).drop("seq"), order=["ts"])
    e.flush()
    return e.points().select("series", "ts", "value")


SQL["ingest_drop_late"] = f"WITH {P} SELECT series, ts, value FROM p WHERE ts >= {MID}"


@query
def ingest_sequence(spark, d):
    e = _engine(spark)
    e.ingest(_events(spark, d).drop("seq"), order=["ts"])
    e.flush()
    return e.points().select("series", "ts", "seq")


SQL["ingest_sequence"] = f"WITH {P} SELECT series, ts, row_number() OVER (ORDER BY ts) - 1 AS seq FROM p"


@query
def series_stats(spark, d):
    return q.series_stats(_events(spark, d))


SQL["series_stats"] = f"WITH {P} SELECT series, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_points, max(seq) AS max_seq FROM p GROUP BY series"


@query
def segment_stats(spark, d):
    rows = [(s.segment_id, s.min_ts, s.max_ts, s.rows, s.max_seq) for s in _day_engine(spark, d).manifest.segments]
    return spark.createDataFrame(rows, "segment_id long, min_ts long, max_ts long, n_points long, max_seq long")


SQL["segment_stats"] = f"""WITH {P} SELECT CAST(1 + (ts >= {A})::INT + (ts >= {MID})::INT + (ts >= {B})::INT AS BIGINT) AS segment_id,
 min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_points, max(seq) AS max_seq FROM p GROUP BY 1"""


@query
def max_persisted_seq(spark, d):
    return spark.createDataFrame([(_day_engine(spark, d).manifest.max_persisted_seq,)], "max_seq long")


SQL["max_persisted_seq"] = f"WITH {P} SELECT max(seq) AS max_seq FROM p"


@query
def zone_map_segments(spark, d):
    from tidemark.plans.pruning import choose

    found = choose(spark, _day_engine(spark, d).manifest.segments, "view", A, MID, None)
    return spark.createDataFrame([(s.segment_id,) for s in found.read], "segment_id long")


SQL["zone_map_segments"] = f"""WITH {P}, s AS (SELECT CAST(1 + (ts >= {A})::INT + (ts >= {MID})::INT + (ts >= {B})::INT AS BIGINT) AS segment_id,
 min(ts) AS lo, max(ts) AS hi FROM p WHERE series = 'view' GROUP BY 1) SELECT segment_id FROM s WHERE hi >= {A} AND lo < {MID}"""


@query
def series_cardinality(spark, d):
    points = _events(spark, d)
    return q.cardinality(points, scope("tags", "user"))


SQL["series_cardinality"] = f"WITH {P} SELECT u AS scope, count(DISTINCT (series, u, k)) AS series_keys FROM p GROUP BY u"


@query
def series_keys_distinct(spark, d):
    key = series_key().alias("key")
    return _events(spark, d).select(key).distinct().select("key.series", F.to_json("key.tags").alias("key_tags"))


SQL["series_keys_distinct"] = f"""WITH {P} SELECT DISTINCT series, '[{{"key":"k","value":"' || k || '"}},{{"key":"user","value":"' || u || '"}}]' AS key_tags FROM p"""

ADMITTED = f"""{P}, f AS (SELECT series, u, k, min(seq) AS first FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY first) AS n FROM f)"""


def _by_series(spark: SparkSession, d: str) -> DataFrame:
    """Events with their type as a tag, so that it can be the scope."""
    return _events(spark, d).withColumn("tags", F.map_concat("tags", F.create_map(F.lit("type"), F.col("series"))))


@query
def cardinality_admit(spark, d):
    return admit(_by_series(spark, d), 10, "type")[0].select("series", "ts", "seq", "value")


SQL["cardinality_admit"] = f"WITH {ADMITTED} SELECT series, ts, seq, value FROM p JOIN r USING (series, u, k) WHERE n <= 10"


@query
def cardinality_reject(spark, d):
    return admit(_by_series(spark, d), 10, "type")[1].select("series", "ts", "seq", "value")


SQL["cardinality_reject"] = f"WITH {ADMITTED} SELECT series, ts, seq, value FROM p JOIN r USING (series, u, k) WHERE n > 10"


@query
def tag_postings(spark, d):
    return tag_terms(_events(spark, d), "series")


SQL["tag_postings"] = f"WITH {P} SELECT DISTINCT series, 'user' AS k, u AS v FROM p UNION SELECT DISTINCT series, 'k', k FROM p"


@query
def postings_pruned_query(spark, d):
    return _day_engine(spark, d).query("view", tags={"k": "39", "user": "7"})


SQL["postings_pruned_query"] = SQL["tag_filter_and"]


@query
def replay_tail(spark, d):
    e, points = Engine(spark, storage.new_path(spark, "engine")), _events(spark, d)
    e._store(points.where(F.col("seq") <= 500))
    e.wal.append(points.where(F.col("seq") > 250), 251)  # as if the process had ended before it could empty the log
    e = Engine(spark, e.path)
    e.recover()
    return e.points().select("series", "ts", "seq", "value")


SQL["replay_tail"] = f"WITH {P} SELECT series, ts, seq, value FROM p"


@query
def snapshot_roundtrip(spark, d):
    e = _engine(spark)
    e._store(_events(spark, d))
    e.snapshot()
    e.restore()
    return e.points().select("series", "ts", "seq", "value", F.col("tags")["k"].alias("k"))


SQL["snapshot_roundtrip"] = f"WITH {P} SELECT series, ts, seq, value, k FROM p"


@query
def delete_range(spark, d):
    e = _day_engine(spark, d)
    e.delete("view", A, MID, {"k": "39"})
    return e.points().select("series", "ts", "seq", "value")


SQL["delete_range"] = f"WITH {P} SELECT series, ts, seq, value FROM p WHERE NOT (series = 'view' AND ts >= {A} AND ts < {MID} AND k = '39')"


@query
def stream_ingest(spark, d):
    from tidemark.streaming.sink import write_stream

    e = _engine(spark)
    source = storage.new_path(spark, "stream")
    _events(spark, d).drop("seq").repartition(3).write.parquet(source)
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_stream(rows, e, "events", storage.new_path(spark, "offsets")).awaitTermination()
    return e.points().select("series", "ts", "value")


SQL["stream_ingest"] = f"WITH {P} SELECT series, ts, value FROM p"


@query
def list_series(spark, d):
    return q.list_series(_events(spark, d), {"k": "39"})


SQL["list_series"] = f"WITH {P} SELECT DISTINCT series FROM p WHERE k = '39'"


@query
def downsample_hourly(spark, d):
    return q.downsample(_events(spark, d), 3_600_000_000_000).drop("total")


SQL["downsample_hourly"] = f"""WITH {P} SELECT series, ts // 3600000000000 * 3600000000000 AS slot_start, count(*) AS n_points, min(value) AS low,
 max(value) AS high, arg_min(value, (ts, seq)) AS first_value, arg_max(value, (ts, seq)) AS last_value FROM p GROUP BY 1, 2"""


@query
def lineitem_series(spark, d):
    return q.select_points(adapters.from_lineitem(table(spark, d, "lineitem")), "R", tags={"supplier": "1"})


SQL["lineitem_series"] = "SELECT epoch_us(l_shipdate) * 1000 AS ts, l_extendedprice AS value FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 1"


@query
def orders_series(spark, d):
    return q.series_stats(adapters.from_orders(table(spark, d, "orders")))


SQL["orders_series"] = """SELECT o_orderpriority AS series, min(epoch_us(o_orderdate) * 1000) AS min_ts, max(epoch_us(o_orderdate) * 1000) AS max_ts,
 count(*) AS n_points, max(o_orderkey) AS max_seq FROM orders GROUP BY 1"""
