"""The engine: ingest, query, flush, compaction, retention, snapshots and recovery over one folder.

There is one writer at a time. Readers need no lock: a query fixes the manifest version when it is built.

What is in segments and what is only in the log is told apart by one number of the manifest, ``log_floor``, which is committed
together with the segment: a crash between that commit and the removal of the log repeats nothing and loses nothing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.tags import tag_match
from tidemark.model import NEW_POINTS, POINTS, CardinalityLimitExceeded, ConfigError, EngineConfig, SeriesNotFound
from tidemark.operators import query as q
from tidemark.operators.cardinality import CardinalityTracker, admit
from tidemark.operators.sequence import with_sequence
from tidemark.plans.catalog import Catalog, Manifest, Segment
from tidemark.plans.pruning import choose
from tidemark.sources import segments as seg
from tidemark.sources.damage import reported
from tidemark.sources.snapshot import Snapshots
from tidemark.sources.wal import Wal
from tidemark.telemetry import Metrics

MOST_PARTS = 16  #: tables of known keys, or of points in memory mode, beyond which they are put into one


class Engine:
    """A store of points in ``path``. Usable as a context manager; leaving it flushes.

    Opening numbers on above all that the manifest and the log have used; what an earlier process left in the log goes into
    a segment with the next flush, once.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.config, self.clock = spark, path.rstrip("/"), config or EngineConfig(), clock
        if self.config.max_series_cardinality is not None and self.config.max_series_cardinality < 0:
            raise ConfigError("max_series_cardinality must not be negative")
        self.metrics = Metrics()
        self.lock = threading.RLock()
        self.catalog = Catalog(spark, f"{self.path}/manifest")
        self.wal = Wal(spark, f"{self.path}/wal")
        self.snapshots = Snapshots(spark, f"{self.path}/snapshots")
        self.root = f"{self.path}/segments"
        self.manifest = self.catalog.load()
        seg.check(spark, list(self.manifest.segments))
        self.pending: list[tuple[DataFrame, int]] = []  # taken in without a log, with their numbers of rows
        self.memory: list[DataFrame] = []  # all flushed points, if segments are off
        self._memory_floor = 0  # logged points below it are in ``memory``
        self._rejected: DataFrame | None = None
        self._waiting_since: float | None = None
        self.next_seq = max(self.manifest.next_seq, self.manifest.max_persisted_seq + 1, self.wal.next_seq)
        self._last_retention = None
        self.background: Background | None = None
        self.rules: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.tracker: CardinalityTracker | None = None
        if self.config.max_series_cardinality is not None:
            self._open_tracker()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self, timeout_s: float | None = None) -> None:
        """Stop what runs in the background and flush. With a time limit, work that does not end in it is left to the log."""
        if self.stop(timeout_s):
            self.flush()

    def start(self) -> None:
        """Flush, maintain and snapshot at the intervals of the settings, in a thread of the driver."""
        if self.background is None:
            self.background = Background(self)
            self.background.start()

    def stop(self, timeout_s: float | None = None) -> bool:
        """Whether the background work, if any, has ended."""
        ended = self.background is None or self.background.stop(timeout_s)
        self.background = None
        return ended

    # ---- cardinality

    def _keys_path(self) -> str:
        return f"{self.path}/series_keys"

    def _open_tracker(self) -> None:
        """Known keys of earlier runs; without any, those of the live segments, so that a limit set later holds for them too."""
        parts = [p for p, _, folder in storage.listing(self.spark, self._keys_path()) if folder and not p.rsplit("/", 1)[1].startswith(".")]
        self.tracker = CardinalityTracker(self.spark, self.config.cardinality_scope_tag_key, parts)
        if not parts and self.manifest.segments:
            self._save_keys(self.tracker.new_keys(seg.points_of(self.spark, list(self.manifest.segments))))
        for r in self.tracker.counts().toLocalIterator():
            self.metrics.gauge("series_cardinality", r["series_keys"], scope=r["scope"])

    def _save_keys(self, new: DataFrame) -> None:
        """Add a table of keys that no other has."""
        name = f"part-{self.clock():019d}-{len(self.tracker.paths):06d}"
        new.write.parquet(f"{self._keys_path()}/.open-{name}")
        storage.rename(self.spark, f"{self._keys_path()}/.open-{name}", f"{self._keys_path()}/{name}")
        self.tracker.paths.append(f"{self._keys_path()}/{name}")

    def checkpoint_keys(self) -> None:
        """Put all known keys into one table and drop the others."""
        with self.lock:
            old = [p for p, _, folder in storage.listing(self.spark, self._keys_path()) if folder]
            if not self.tracker.paths:
                return
            target = f"{self._keys_path()}/part-{self.clock():019d}-all"
            self.tracker.keys.distinct().write.mode("overwrite").parquet(f"{self._keys_path()}/.open-all")
            storage.rename(self.spark, f"{self._keys_path()}/.open-all", target)
            # until the others are gone a reader sees keys twice, which changes nothing: they are a set
            for p in old:
                storage.delete(self.spark, p)
            self.tracker.paths = [target]

    # ---- ingest

    def _event(self, name: str, **fields) -> None:
        self.config.event_listener(name, fields)

    def insert(self, series: str, ts: int, value: float, tags: dict[str, str] | None = None) -> None:
        """Take in one point. For more than a few, ``ingest`` is the way."""
        self.ingest(self.spark.createDataFrame([(series, ts, float(value), tags or {})], NEW_POINTS))

    def ingest(self, points: DataFrame, order: list[str] | None = None, on_limit: str = "raise") -> DataFrame | None:
        """Number the points (in ``order``, or as they come), apply the limit of series, and log them.

        Points become visible with the next flush. If points exceed the limit, ``on_limit="raise"`` takes none of the batch and
        raises; ``"split"`` takes those that pass and returns the others, which can be read until the next call. Their numbers
        are used up either way.
        """
        with self.lock, storage.scope():
            good, rejected, n, first = self._prepare(points, order, on_limit)
            if self.config.enable_wal:
                began = time.perf_counter()
                path = self.wal.append(good, first, self.next_seq)
                self.metrics.time("wal_fsync_duration_seconds", time.perf_counter() - began)
                self.metrics.count("wal_bytes_written", seg.size(self.spark, path))
            else:
                self.pending.append((storage.keep(storage.staged(good, "pending")), n))
            self._waiting_since = self._waiting_since or time.perf_counter()
            self.metrics.count("ingest_points", n)
            return rejected

    insert_batch = ingest

    def _prepare(self, points: DataFrame, order: list[str] | None, on_limit: str) -> tuple[DataFrame, DataFrame | None, int, int]:
        """(points to take, rejected ones if there is a limit, number of those to take, first number of the batch)"""
        bad = F.col("ts").isNull() | (F.col("ts") < 0) | F.col("series").isNull() | F.col("value").isNull() | F.col("tags").isNull()
        if self._rejected is not None:
            storage.drop(self._rejected)
            self._rejected = None
        first = self.next_seq
        numbered, after, n_bad = with_sequence(points.select(*NEW_POINTS.names), first, order, bad)
        if n_bad:
            raise ConfigError("points must have series, value, tags and a ts of 0 or more")
        self.next_seq, n = after, after - first
        if self.tracker is None:
            return numbered, None, n, first
        limit, key = self.config.max_series_cardinality, self.config.cardinality_scope_tag_key
        good, rejected, new = admit(numbered, limit, key, self.tracker.keys if self.tracker.paths else None)
        rejected = storage.staged(rejected, "rejected")
        n_rejected = rejected.count()
        if n_rejected:
            self.metrics.count("cardinality_limit_rejections", n_rejected)
            if on_limit == "raise":
                tags = rejected.agg(F.min_by("tags", "seq")).first()[0] or {}
                scope = tags.get(key or "") or "default"
                raise CardinalityLimitExceeded(self.tracker.current_count(scope), limit, scope)
        # the new keys are saved before the points are taken: the set never shrinks, and a key without points only uses up room
        changed = {r["scope"]: r["count"] for r in new.groupBy("scope").count().toLocalIterator()}
        if changed:
            self._save_keys(new)
            for scope, k in changed.items():
                self.metrics.add_gauge("series_cardinality", k, scope=scope)
            if len(self.tracker.paths) > MOST_PARTS:
                self.checkpoint_keys()
        self._rejected = storage.keep(rejected)
        return good, rejected, n - n_rejected, first

    # ---- flush

    def flush(self) -> int:
        """Put all points that are taken in but not stored into a segment (or into memory); returns their number. All or nothing."""
        began = time.perf_counter()
        with self.lock, storage.scope():
            self.advance_retention()
            floor = self.manifest.replay_from if self.config.enable_segments else self._memory_floor
            batches = self.wal.open_batches(floor) if self.config.enable_wal else []
            parts = [self.wal.read(floor)] if batches else []
            parts += [p for p, _ in self.pending]
            if not parts:
                if self.config.enable_wal and self.config.enable_segments:
                    self.wal.truncate()  # what a crash has left behind is stored
                return 0
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            bound = sum(b - a for a, b in map(self.wal.numbers, batches)) + sum(k for _, k in self.pending)
            with reported(self.spark, "log", batches):
                n = self._store(rows, rows=bound, log_floor=self.next_seq)
            self._run_rules(rows)
            if self.config.enable_wal and self.config.enable_segments:
                self.wal.log_flush(self.clock())
                self.wal.truncate()
            for p, _ in self.pending:
                storage.drop(p)
            self.pending = []
            self.metrics.count("flush_points", n)
            self.metrics.time("flush_duration_seconds", time.perf_counter() - began)
            if self._waiting_since is not None:
                self.metrics.time("flush_end_to_end_seconds", time.perf_counter() - self._waiting_since)
                self._waiting_since = None
            return n

    def _store(self, points: DataFrame, rows: int | None = None, **commit) -> int:
        """Write points to one segment and commit it with further changes of the manifest; ``rows`` is a bound of their number."""
        if not self.config.enable_segments:
            self._remember(points, commit.get("log_floor"))
            return self.memory[-1].count()
        m = self.manifest
        try:
            new = seg.write(points, self.root, m.next_segment_id, 0, self.clock(), self.config.segment_store, m.delete_before, rows)
        except Exception as e:
            self._event("SegmentIngestFailed", error=str(e))
            raise
        live = commit.pop("segments", m.segments)
        self._commit(
            segments=live + ((new,) if new else ()), next_segment_id=m.next_segment_id + 1,
            **{"next_seq": max(self.next_seq, m.next_seq), **commit},
        )
        return new.rows if new else 0

    def _remember(self, rows: DataFrame, floor: int | None) -> None:
        """Memory mode: add points to those that queries see."""
        self.memory.append(storage.keep(storage.staged(rows.select(*POINTS.names), "memory")))
        if floor is not None:
            self._memory_floor = floor
        if len(self.memory) > MOST_PARTS:
            old, newest = self.memory[:-1], self.memory[-1]
            merged = storage.keep(storage.staged(self._union(old), "memory"))
            self.memory = [merged, newest]
            for p in old:
                storage.drop(p)

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return self.spark.read.schema(POINTS).parquet(*[p._staged_at for p in parts]) if parts else seg.read(self.spark, [])

    def _commit(self, **changes) -> None:
        self.manifest = self.catalog.commit(replace(self.manifest, **changes))

    def ingest_stream_batch(self, points: DataFrame, stream: str, batch_id: int, order: list[str] | None = None) -> bool:
        """A micro-batch straight into a segment, in one commit with its number; False if it was committed before."""
        with self.lock, storage.scope():
            if batch_id <= self.manifest.batches.get(stream, -1):
                return False
            floor = self.manifest.replay_from  # points that wait in the log have lower numbers and still do
            good, _, n, _ = self._prepare(points, order, "split")
            n = self._store(good, rows=n, log_floor=floor, batches={**self.manifest.batches, stream: batch_id})
            self.metrics.count("ingest_points", n)
            self.metrics.count("flush_points", n)
            self._run_rules(good)
            return True

    # ---- rules

    def add_rule(self, target: str, rule: Callable[[DataFrame], DataFrame]) -> None:
        """A continuous query: ``rule`` gets the points of each flush or micro-batch, its result is appended to the Parquet table ``target``.

        It runs after the commit of the points, at most once for each; a rule that fails is reported as an event and does not undo them.
        """
        self.rules.append((target, rule))

    def _run_rules(self, rows: DataFrame) -> None:
        for target, rule in self.rules:
            try:
                rule(rows).write.mode("append").parquet(target)
            except Exception as e:
                self._event("RuleFailed", target=target, error=str(e))

    # ---- query

    def query(self, series: str, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
        """``ts, value`` of the flushed points of a series in [start, end) whose tags hold all given pairs.

        A range without extent is an error first; then a series that no segment has. What is there but has no point in
        the range gives an empty result. Equal points are all kept; there is no order.
        """
        points, mark = self._reach(series, start, end, tags)
        return q.select_points(points, series, start, end, tags, mark)

    def _reach(self, series: str, start: int, end: int | None, tags: dict[str, str] | None) -> tuple[DataFrame, int | None]:
        """The points that a query must look at, and the watermark."""
        q.check_range(start, end)
        if not self.config.enable_segments:
            points = self._union(self.memory)
            if points.where(F.col("series") == series).isEmpty():
                raise SeriesNotFound(series)
            return points, None
        m = self.manifest
        lowest = max(start, m.delete_before or 0)
        found = choose(self.spark, m.segments, series, lowest, end, tags, self.config.segment_store.enable_tag_index)
        if not found.known:
            raise SeriesNotFound(series)
        if found.skipped:
            self.metrics.count("tag_postings_segment_skips", found.skipped)
        pairs = tags if self.config.segment_store.enable_tag_index else None
        return seg.matching(self.spark, found.read, pairs), m.delete_before

    def fetch(self, series: str, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> list[tuple[int, float]]:
        """The points of ``query`` as a list in order of time, for results that fit the driver. Damaged files raise ``Corruption``."""
        rows = self.query(series, start, end, tags)
        with reported(self.spark, "segments", [f"{s.path}/points" for s in self.manifest.segments]):
            table = rows.toArrow()
        return sorted(zip(table.column("ts").to_pylist(), table.column("value").to_pylist()), key=lambda r: r[0])

    def verify(self) -> None:
        """Read all pages of all live segments, the log and the newest snapshot; the first damaged file raises ``Corruption``."""
        snap = self.snapshots.latest_path()
        for what, paths in (("segments", [f"{s.path}/points" for s in self.manifest.segments]), ("log", self.wal.batches()), ("snapshot", [snap] if snap else [])):
            if paths:
                with reported(self.spark, what, paths):
                    seg.read(self.spark, paths).write.format("noop").mode("overwrite").save()

    def points(self) -> DataFrame:
        """All visible points with all fields."""
        if not self.config.enable_segments:
            return self._union(self.memory)
        rows = seg.points_of(self.spark, list(self.manifest.segments))
        return rows if self.manifest.delete_before is None else rows.where(F.col("ts") >= self.manifest.delete_before)

    def list_series(self, tags: dict[str, str] | None = None) -> DataFrame:
        return q.list_series(self.points(), tags)

    def downsample(self, step_ns: int, series: str | None = None, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
        """Per series and slot the aggregates of ``query.downsample``: of all points, or of those that ``query`` would give."""
        if series is None:
            return q.downsample(q.restricted(self.points(), None, start, end, tags), step_ns)
        points, mark = self._reach(series, start, end, tags)
        return q.downsample(q.restricted(points, series, max(start, mark or 0), end, tags), step_ns)

    def sql_view(self, name: str = "points") -> None:
        """The visible points as a view for SQL of the session."""
        self.points().createOrReplaceTempView(name)

    def get_metrics(self) -> dict:
        return self.metrics.snapshot()

    # ---- retention

    def set_delete_before(self, ts: int) -> None:
        """Hide points before ``ts`` at once; a value not above the present one changes nothing."""
        if not self.config.enable_segments:
            raise ConfigError("retention needs segments")
        with self.lock:
            if self.manifest.delete_before is None or ts > self.manifest.delete_before:
                try:
                    self._commit(delete_before=ts)
                except Exception as e:
                    self._event("RetentionAdvanceFailed", delete_before=ts, error=str(e))
                    raise
                self._event("RetentionAdvanced", delete_before=ts)

    @property
    def delete_before(self) -> int | None:
        return self.manifest.delete_before

    def advance_retention(self) -> None:
        """With a time to live set, move the watermark to now less that, at most once per check interval."""
        ttl = self.config.retention_ttl_s
        now = self.clock()
        if ttl is None or not self.config.enable_segments:
            return
        if self._last_retention is None or now - self._last_retention >= self.config.retention_check_interval_s * 1e9:
            self._last_retention = now
            self.set_delete_before(max(0, now - int(ttl * 1e9)))

    # ---- maintenance

    def _replace(self, old: list[Segment], new: list[Segment], next_id: int) -> None:
        now = self.clock()
        kept = tuple(s for s in self.manifest.segments if s not in old)
        gone = self.manifest.obsolete + tuple((s.path, now) for s in old)
        self._commit(segments=kept + tuple(new), next_segment_id=next_id, obsolete=gone)

    def compact(self) -> tuple[int, int]:
        """Merge all level 0 segments, if there are two or more, into one of level 1; returns (input, output) counts.

        The merge is a union: equal points are all kept. Points before the watermark are dropped.
        """
        if not self.config.enable_segments:
            return 0, 0
        with self.lock:
            m = self.manifest
            old = [s for s in m.segments if s.level == 0]
            if len(old) < 2:
                return 0, 0
            try:
                new = seg.write(
                    seg.points_of(self.spark, old), self.root, m.next_segment_id, 1, self.clock(), self.config.segment_store, m.delete_before, sum(s.rows for s in old)
                )
            except Exception as e:
                self._event("SegmentCompactionFailed", error=str(e))
                raise
            self._replace(old, [new] if new else [], m.next_segment_id + 1)
            return len(old), 1 if new else 0

    def reclaim(self) -> int:
        """Drop segments that lie before the watermark and rewrite, at their level, those that reach below it."""
        with self.lock:
            mark = self.manifest.delete_before
            below = [] if mark is None else [s for s in self.manifest.segments if s.min_ts < mark]
            for s in below:
                m = self.manifest
                new = None
                if s.max_ts >= mark:
                    new = seg.write(seg.points_of(self.spark, [s]), self.root, m.next_segment_id, s.level, s.created_ns, self.config.segment_store, mark, s.rows)
                self._replace([s], [new] if new else [], m.next_segment_id + 1)
            return len(below)

    def compaction_due(self) -> bool:
        """At least two level 0 segments, and their count, total bytes or greatest age at its trigger."""
        c, l0 = self.config.segment_store, [s for s in self.manifest.segments if s.level == 0]
        if len(l0) < 2:
            return False
        age = (self.clock() - min(s.created_ns for s in l0)) / 1e9
        return (
            len(l0) >= c.l0_compaction_trigger_segment_count
            or (c.l0_compaction_trigger_total_bytes is not None and sum(s.bytes for s in l0) >= c.l0_compaction_trigger_total_bytes)
            or (c.l0_compaction_trigger_max_age_s is not None and age >= c.l0_compaction_trigger_max_age_s)
        )

    def reap(self, now_ns: int | None = None) -> int:
        """Delete the files of segments that left the manifest longer ago than the grace period."""
        with self.lock:
            limit = (self.clock() if now_ns is None else now_ns) - int(self.config.segment_store.reap_grace_s * 1e9)
            due = [(p, t) for p, t in self.manifest.obsolete if t <= limit]
            if due:
                for p, _ in due:
                    storage.delete(self.spark, p)
                self._commit(obsolete=tuple(x for x in self.manifest.obsolete if x not in due))
            return len(due)

    def maintain(self) -> tuple[int, int]:
        """One round: retention, reclaim, compaction if due, deletion of old files."""
        with self.lock:
            self.advance_retention()
            self.reclaim()
            done = self.compact() if self.compaction_due() else (0, 0)
            self.reap()
            if self.tracker is not None and len(self.tracker.paths) > 1:
                self.checkpoint_keys()
            return done

    def delete(self, series: str, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> int:
        """Remove visible points; returns their number. Segments that hold some are rewritten in one commit, others are not touched."""
        q.check_range(start, end)
        hit = q.condition(series, start, end, tags)
        with self.lock, storage.scope():
            if not self.config.enable_segments:
                return self._delete_from_memory(hit)
            m = self.manifest
            found = choose(self.spark, m.segments, series, max(start, m.delete_before or 0), end, tags, self.config.segment_store.enable_tag_index)
            if not found.read:
                return 0
            visible = hit if m.delete_before is None else hit & (F.col("ts") >= m.delete_before)
            folder = F.regexp_extract(F.input_file_name(), r"(seg-\d+-l\d+)", 1)
            hits = seg.points_of(self.spark, found.read).where(visible).groupBy(folder.alias("name")).count()
            hits = {r["name"]: r["count"] for r in hits.collect()}
            old = [s for s in found.read if s.path.rsplit("/", 1)[1] in hits]
            new, number = [], m.next_segment_id
            for s in old:
                rest = seg.points_of(self.spark, [s]).where(~hit)
                new.append(seg.write(rest, self.root, number, s.level, s.created_ns, self.config.segment_store, m.delete_before, s.rows))
                number += 1
            if old:
                self._replace(old, [s for s in new if s], number)
            return sum(hits.values())

    def _delete_from_memory(self, hit: Column) -> int:
        """Memory mode has no manifest to say that logged points are gone, so what is left goes into a snapshot before the log is emptied."""
        points = self._union(self.memory)
        n = points.where(hit).count()
        if n:
            if self.config.enable_wal and not self.config.enable_snapshots:
                raise ConfigError("deletion in memory mode with a log needs snapshots")
            rest = storage.keep(storage.staged(points.where(~hit), "memory"))
            self._swap_memory(rest)
        return n

    def _swap_memory(self, points: DataFrame) -> None:
        """Memory mode: put staged points in place of all flushed ones; with a log, also for a later process."""
        if self.config.enable_wal and self.config.enable_snapshots:
            waiting = self.wal.read(self._memory_floor)
            if not waiting.isEmpty():
                self._remember(waiting, self.next_seq)
                points = self._merge_staged([points, self.memory.pop()])
            self.snapshots.create(points, self.clock())
            self.wal.truncate()
        old, self.memory = self.memory, [points]
        for p in old:
            storage.drop(p)

    def _merge_staged(self, parts: list[DataFrame]) -> DataFrame:
        merged = storage.keep(storage.staged(self._union(parts), "memory"))
        for p in parts:
            storage.drop(p)
        return merged

    def rollup(self, before: int, step_ns: int) -> int:
        """Replace the points before ``before`` by one for each series, tags and slot of ``step_ns``: the mean at the start of the slot.

        ``before`` must be a border of slots. In one commit; returns the number of points replaced. Points that came in as means are
        means of means if they are rolled up again to a longer step.
        """
        if not self.config.enable_segments:
            raise ConfigError("a rollup needs segments")
        if before % step_ns:
            raise ConfigError("a rollup ends at the border of a slot")
        with self.lock, storage.scope():
            m = self.manifest
            old = [s for s in m.segments if s.min_ts < before]
            points = seg.points_of(self.spark, old)
            if m.delete_before is not None:
                points = points.where(F.col("ts") >= m.delete_before)
            n = points.where(F.col("ts") < before).count() if old else 0
            if not n:
                return 0
            new = seg.write(q.rolled(points, before, step_ns), self.root, m.next_segment_id, 1, self.clock(), self.config.segment_store, m.delete_before, sum(s.rows for s in old))
            self._replace(old, [new] if new else [], m.next_segment_id + 1)
            return n

    # ---- snapshots and recovery

    def snapshot(self) -> str:
        """Flush, then write all visible points to a snapshot."""
        if not self.config.enable_snapshots:
            raise ConfigError("snapshots are off")
        with self.lock:
            self.flush()
            began, now = time.perf_counter(), self.clock()
            try:
                path = self.snapshots.create(self.points(), now)
            except Exception as e:
                self._event("SnapshotFailed", error=str(e))
                raise
            self.metrics.time("snapshot_duration_seconds", time.perf_counter() - began)
            self.metrics.gauge("snapshot_size_bytes", seg.size(self.spark, path))
            self._event("SnapshotCreated", path=path, timestamp=now)
            return path

    def restore(self, path: str | None = None) -> int:
        """Put the points of a snapshot (the newest if None) in place of all present ones; returns their number.

        One commit: a failure leaves the present points. Points that wait in the log are given up with the others.
        """
        with self.lock, storage.scope():
            path = path or self.snapshots.latest_path()
            if path is None:
                raise ConfigError("there is no snapshot")
            points = seg.read(self.spark, [path])
            with reported(self.spark, "snapshot", [path]):
                top = points.agg(F.max("seq"), F.count(F.lit(1))).first()
                self.next_seq = max(self.next_seq, (-1 if top[0] is None else top[0]) + 1)
                if self.config.enable_segments:
                    old, now = self.manifest.segments, self.clock()
                    gone = self.manifest.obsolete + tuple((s.path, now) for s in old)
                    n = self._store(points, rows=top[1], segments=(), obsolete=gone, log_floor=self.next_seq)
                else:
                    kept = storage.keep(storage.staged(points, "memory"))
                    if self.config.enable_wal and self.config.enable_snapshots and path != self.snapshots.latest_path():
                        self.snapshots.create(kept, self.clock())  # so that a later process recovers this state
                    old, self.memory, self._memory_floor, n = self.memory, [kept], self.next_seq, top[1]
                    for p in old:
                        storage.drop(p)
            self.wal.truncate()
            for p, _ in self.pending:
                storage.drop(p)
            self.pending = []
            return n

    def recover(self) -> int:
        """Bring a folder back to its last committed state plus the log; returns the number of points replayed.

        With segments: folders that the manifest does not name are deleted, logged points that no segment has go into one
        new segment, and the log is emptied. Without: newest snapshot, then logged points it lacks.
        """
        with self.lock, storage.scope():
            self.manifest = self.catalog.load()
            live = list(self.manifest.segments)
            seg.check(self.spark, live)
            named = {s.path.rsplit("/", 1)[1] for s in live} | {p.rsplit("/", 1)[1] for p, _ in self.manifest.obsolete}
            for p, _, _ in storage.listing(self.spark, self.root):
                if p.rsplit("/", 1)[1] not in named:
                    storage.delete(self.spark, p)
            self.next_seq = max(self.next_seq, self.manifest.next_seq, self.manifest.max_persisted_seq + 1, self.wal.next_seq)
            if self.config.enable_segments:
                return self._replay(self.manifest.replay_from)
            snap = self.snapshots.latest_path()
            base = seg.read(self.spark, [snap] if snap else [])
            with reported(self.spark, "snapshot", [snap] if snap else []):
                top = base.agg(F.max("seq")).first()[0]
            floor = 0 if top is None else top + 1
            self.next_seq = max(self.next_seq, floor)
            tail = self.wal.read(floor) if self.config.enable_wal else seg.read(self.spark, [])
            old, self.memory = self.memory, []
            with reported(self.spark, "log", self.wal.batches()):
                self._remember(base.unionByName(tail), self.next_seq)
                n = tail.count()
            for p in old:
                storage.drop(p)
            return n

    def _replay(self, floor: int) -> int:
        batches = self.wal.open_batches(floor) if self.config.enable_wal else []
        n = 0
        if batches:
            with reported(self.spark, "log", batches):
                tail = self.wal.read(floor)
                n = tail.count()
                if n:
                    self._store(tail, rows=n, log_floor=self.next_seq)
        self.wal.truncate()
        return n

    def get_config(self) -> EngineConfig:
        return self.config

    def get_manifest(self) -> Manifest:
        return self.manifest


class Background(threading.Thread):
    """The loop of an engine: at most one piece of work at a time, each as often as its interval says."""

    def __init__(self, engine: Engine):
        super().__init__(daemon=True, name="tidemark-background")
        self.engine, self._end = engine, threading.Event()
        c = engine.config
        self._work = [(c.flush_interval_s, engine.flush)]
        if c.enable_segments:
            self._work.append((c.segment_store.compaction_check_interval_s, engine.maintain))
        if c.enable_snapshots:
            self._work.append((c.snapshot_interval_s, engine.snapshot))

    def run(self) -> None:
        self.engine._event("FlushThreadStarted")
        due = [time.monotonic() + every for every, _ in self._work]
        while not self._end.wait(max(0.0, min(due) - time.monotonic())):
            for k, (every, work) in enumerate(self._work):
                if time.monotonic() >= due[k]:
                    try:
                        work()
                    except Exception as e:  # the next round tries again; nothing was committed
                        self.engine._event("BackgroundWorkFailed", work=work.__name__, error=str(e))
                    due[k] = time.monotonic() + every
        self.engine._event("FlushThreadStopping")

    def stop(self, timeout_s: float | None = None) -> bool:
        """Ask the loop to end and wait for the work under way, at most so long; whether it has ended."""
        self._end.set()
        self.join(timeout_s)
        return not self.is_alive()
