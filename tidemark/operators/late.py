"""Aggregates per hour of event time over records that arrive late, with a cut-off for lateness.

Two views of the same log make up the result. The fast view adds the records of each small step to provisional
hours as they arrive. The batch view is recomputed on a schedule from the full log for the hours that are still
open, replaces what the fast view held, and freezes the hours past their cut-off. What is served is the batch view
plus the fast view of the records after the last batch.

The cut-off of a record is judged by the log alone: it is late if, before it arrived, the greatest time of its series
had reached the end of its hour plus the allowed lateness. That greatest time is a running maximum in order of
arrival. It is computed by blocks of ``seq``: a maximum per series and block, a prefix scan over these few rows, then
within each block on its own. A block holds at most ``BLOCK`` different records, however hot its series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.clean import NS_PER_HOUR, clean_points, floor_div, is_finite, ts_to_ns

BLOCK = 1 << 16  #: numbers of arrival in a block of the running maximum
SUPER = 1 << 12  #: blocks in a block of the scan over block maxima
COARSE = 10**17  #: a raw ts below this may be in a coarser unit than ns


def lateness(catalog: DataFrame) -> DataFrame:
    """``series, late_ns``: the greatest lateness listed for a series, 0 if null."""
    return catalog.where(F.col("series").isNotNull()).groupBy("series").agg(
        (F.coalesce(F.max("lateness_s"), F.lit(0)) * F.lit(10**9)).alias("late_ns")
    )


def _scan(maxima: DataFrame) -> DataFrame:
    """Per series and block the greatest time of all blocks before, by a prefix scan in two levels."""
    m = maxima.withColumn("super", floor_div(F.col("block"), SUPER))
    inside = Window.partitionBy("series", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("in_super", F.max("block_max").over(inside))
    supers = m.groupBy("series", "super").agg(F.max("block_max").alias("super_max"))
    over = Window.partitionBy("series").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("series", "super", F.max("super_max").over(over).alias("before_super"))
    return m.join(supers, ["series", "super"]).select(
        "series", "block", F.greatest("in_super", "before_super").alias("before")
    )


def with_cutoff(points: DataFrame, catalog: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """Cleaned points with ``hour`` (its number since 1970) and ``late`` (arrived after the cut-off of that hour).

    ``floor`` (``series, seen``) gives the greatest time of each series before these points, for a run over the
    tail of a log. Rows of equal ``seq`` do not see each other, so repeated rows change nothing. A series
    that the catalog lacks, or whose lateness is null, has lateness 0. Rows without series, ts or ``seq`` are left
    out: they have no place in time or in the order of arrival.
    """
    rows = clean_points(points).where(F.col("seq").isNotNull()).withColumn("block", floor_div(F.col("seq"), BLOCK))
    maxima = rows.groupBy("series", "block").agg(F.max("ts").alias("block_max"))
    carried = _scan(maxima).join(lateness(catalog), "series", "left")
    if floor is not None:
        carried = carried.join(floor.select("series", "seen"), "series", "left").withColumn(
            "before", F.greatest("before", "seen")
        )
    arrival = Window.partitionBy("series", "block").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("ts").over(arrival), F.col("before"))
    hour = floor_div(F.col("ts"), NS_PER_HOUR)
    return rows.join(carried, ["series", "block"]).select(
        "series", "ts", "seq", "value", hour.alias("hour"),
        F.coalesce(seen >= (hour + 1) * NS_PER_HOUR + F.coalesce("late_ns", F.lit(0)), F.lit(False)).alias("late"),
    )


def late_points(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """``seq`` of the points that arrive after the cut-off of their hour, each once."""
    return with_cutoff(points, catalog).where("late").select("seq").distinct()


def hourly(marked: DataFrame) -> DataFrame:
    """``series, hour, points, total, low, high, left_out`` of rows marked by ``with_cutoff``.

    ``points`` and the three measures are of the finite values that are not late, ``left_out`` counts the late
    points, finite or not. A row repeated as a whole counts once.
    """
    once = marked.select("series", "hour", "seq", "ts", "value", "late").distinct()
    used = ~F.col("late") & is_finite(F.col("value"))
    return once.groupBy("series", "hour").agg(
        F.count(F.when(used, 1)).alias("points"),
        F.sum(F.when(used, F.col("value"))).alias("total"),
        F.min(F.when(used, F.col("value"))).alias("low"),
        F.max(F.when(used, F.col("value"))).alias("high"),
        F.count(F.when(F.col("late"), 1)).alias("left_out"),
    )


def _open_rows(log: DataFrame, frozen_to: DataFrame, since: int) -> DataFrame:
    """Rows of the log whose hour is not frozen, with ts as it is in the log; ``frozen_to`` has a row per series seen before ``since``.

    The least bound reaches the scan as a filter on the raw ts; a ts in a coarser unit is a smaller number and passes it, and so
    does all that has arrived since, as it can be of a series that was not seen before.
    """
    low = frozen_to.agg(F.min("frozen_to")).first()[0]
    if low is None:
        return log
    near = log.where((F.col("seq") >= since) | (F.col("ts") > low - NS_PER_HOUR) | (F.col("ts") < COARSE))
    ends = (floor_div(ts_to_ns(F.col("ts")), NS_PER_HOUR) + 1) * NS_PER_HOUR
    known = near.join(frozen_to, "series", "left").where(F.col("frozen_to").isNull() | (ends > F.col("frozen_to")))
    return known.select(*log.columns)


class LambdaHours:
    """The two views over an append-only log of points, kept as tables in the shared folder.

    ``fast(to_seq)`` adds the records that arrived since the last step to the fast view; all it needs of the past is
    one row per series, the greatest time seen. ``batch(to_seq)`` recomputes the open hours from the full log before
    ``to_seq``, keeps the frozen ones, and drops what the fast view holds up to there. ``serve()`` is the merged view.
    Every table is written under a new name and becomes visible by one assignment after its write has ended, so
    a run that fails leaves the views as they were and can be repeated; what a view no longer needs is deleted when the one that
    replaces it is there. Within a step a row repeated as a whole counts once; repeats across steps are put right by the
    next ``batch``. With ``keep_late`` both views also hold the ``seq`` of the records they leave out, which ``serve_late()`` merges.

    A batch after the first does not judge the history again. An hour is frozen when its series has reached the end of
    it plus the lateness, so all that comes for it later is late and is only counted. Of the log it reads records in open
    hours, whose lateness no record of a frozen hour can decide, and records that arrived since the last batch.
    """

    def __init__(self, log: DataFrame, catalog: DataFrame, keep_late: bool = False):
        self.log, self.catalog, self.spark = log, catalog, log.sparkSession
        self.keep_late = keep_late
        self.batch_view: DataFrame | None = None
        self.batch_late: DataFrame | None = None
        self.frozen_to: DataFrame | None = None  #: per series, the time up to which hours are frozen, and the greatest seen
        self.batch_to: int | None = None
        self.fast_steps: list[tuple[int | None, int, DataFrame, DataFrame | None]] = []  #: (from, to, increments, late)
        self.seen: DataFrame | None = None
        self.next_seq: int | None = None

    @staticmethod
    def _greatest_times(rows: DataFrame) -> DataFrame:
        return clean_points(rows).where(F.col("seq").isNotNull()).groupBy("series").agg(F.max("ts").alias("seen"))

    @staticmethod
    def _greatest(*parts: DataFrame | None) -> DataFrame:
        out = None
        for p in parts:
            if p is not None:
                out = p.select("series", "seen") if out is None else out.unionByName(p.select("series", "seen"))
        return out.groupBy("series").agg(F.max("seen").alias("seen"))

    def _part(self, from_seq: int | None, to_seq: int | None) -> DataFrame:
        part = self.log if to_seq is None else self.log.where(F.col("seq") < to_seq)
        return part if from_seq is None else part.where(F.col("seq") >= from_seq)

    def _views(self, rows: DataFrame, floor: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """Hourly aggregates of rows, the late ones (``series, hour, seq``) if they are kept, and the greatest time of each series.

        The cut-off is computed once; if late rows are kept, all three come from its staged result.
        """
        marked = with_cutoff(rows, self.catalog, floor)
        if not self.keep_late:
            return storage.staged(hourly(marked), name), None, self._greatest_times(rows)
        marked = storage.staged(marked, "marked")
        late = storage.staged(marked.where("late").select("series", "hour", "seq").distinct(), "late")
        return storage.staged(hourly(marked), name), late, marked.groupBy("series").agg(F.max("ts").alias("seen"))

    def _step(self, from_seq: int | None, to_seq: int, floor: DataFrame | None) -> tuple[tuple[int | None, int, DataFrame, DataFrame | None], DataFrame]:
        """A fast step, and the greatest times of its records."""
        view, late, seen = self._views(self._part(from_seq, to_seq), floor, "fast")
        return (from_seq, to_seq, storage.keep(view), None if late is None else storage.keep(late)), seen

    def _drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                storage.drop(t)

    def fast(self, to_seq: int) -> None:
        """Provisional increments of the records that arrived since the last step and before ``to_seq``."""
        with storage.scope():
            step, seen = self._step(self.next_seq, to_seq, self.seen)
            seen = storage.keep(storage.staged(self._greatest(self.seen, seen), "seen"))
        old = self.seen
        self.seen, self.fast_steps, self.next_seq = seen, [*self.fast_steps, step], to_seq
        self._drop(old)

    def batch(self, to_seq: int | None = None) -> None:
        """Recompute the open hours from the log before ``to_seq`` (all of it if None); freeze those past cut-off."""
        with storage.scope():
            view, late, bounds = self._batch(to_seq)
            later = [] if to_seq is None else [s for s in self.fast_steps if s[1] > to_seq]
            # of a step that the batch reaches into, only the rest is kept
            cut = [s for s in later if s[0] is None or s[0] < to_seq]
            later = [self._step(to_seq, s[1], bounds)[0] if s in cut else s for s in later]
        gone = [self.batch_view, self.batch_late, self.frozen_to]
        gone += [t for s in self.fast_steps if s not in later for t in s[2:]]
        self.batch_view, self.batch_late, self.frozen_to, self.batch_to, self.fast_steps = view, late, bounds, to_seq, later
        if to_seq is not None and (self.next_seq is None or to_seq > self.next_seq):
            gone.append(self.seen)
            self.seen, self.next_seq = storage.keep(storage.staged(bounds.select("series", "seen"), "seen")), to_seq
        self._drop(*gone)

    def _batch(self, to_seq: int | None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        log = self._part(None, to_seq)
        again = self.frozen_to is not None and self.batch_to is not None and (to_seq is None or to_seq >= self.batch_to)
        # a record of a frozen hour is not the latest of its series, so open rows and the bounds of the last batch tell the greatest times
        rows = _open_rows(log, self.frozen_to.select("series", "frozen_to"), self.batch_to) if again else log
        view, late, seen = self._views(rows, None, "hours")
        seen = self._greatest(self.frozen_to if again else None, seen)
        bounds = seen.join(lateness(self.catalog), "series", "left").select(
            "series", "seen", (F.col("seen") - F.coalesce("late_ns", F.lit(0))).alias("frozen_to")
        )
        bounds = storage.keep(storage.staged(bounds, "bounds"))
        ends = (F.col("hour") + 1) * NS_PER_HOUR
        if again:
            was = self.frozen_to.select("series", F.col("frozen_to").alias("was"))
            arrived = self._part(self.batch_to, to_seq)
            # what has arrived since for an hour that was frozen is late, whatever else it is
            missed = clean_points(arrived).where(F.col("seq").isNotNull()).withColumn("hour", floor_div(F.col("ts"), NS_PER_HOUR))
            missed = storage.staged(missed.join(was, "series").where(ends <= F.col("was")).select("series", "hour", "seq", "ts", "value").distinct(), "missed")
            counts = missed.groupBy("series", "hour").agg(F.count(F.lit(1)).alias("more"))
            frozen = self.batch_view.where("frozen").drop("frozen").join(counts, ["series", "hour"], "full")
            frozen = frozen.withColumns({"points": F.coalesce("points", F.lit(0)), "left_out": F.coalesce("left_out", F.lit(0)) + F.coalesce("more", F.lit(0))}).drop("more")
            view = frozen.unionByName(view)
            if late is not None:
                kept = self.batch_late.join(was, "series").where(ends <= F.col("was")).drop("was")
                late = storage.staged(late.unionByName(kept).unionByName(missed.select("series", "hour", "seq")).distinct(), "late")
        view = view.join(bounds.select("series", "frozen_to"), "series", "left").withColumn("frozen", ends <= F.col("frozen_to")).drop("frozen_to")
        return storage.keep(storage.staged(view, "batch")), None if late is None else storage.keep(late), bounds

    def serve(self) -> DataFrame:
        """``series, hour, points, total, low, high, left_out`` of the batch view plus the steps after it; to be read before the next step."""
        names = ["series", "hour", "points", "total", "low", "high", "left_out"]
        parts = [step.select(*names) for _, _, step, _ in self.fast_steps]
        if self.batch_view is not None:
            parts.insert(0, self.batch_view.select(*names))
        if not parts:
            return hourly(with_cutoff(self.log.limit(0), self.catalog))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("series", "hour").agg(
            F.sum("points").alias("points"), F.sum("total").alias("total"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.sum("left_out").alias("left_out"),
        )

    def serve_late(self) -> DataFrame:
        """``seq`` of the records left out by the batch view and by the steps after it, each once; needs ``keep_late``."""
        parts = [late.select("seq") for late in (self.batch_late, *(s[3] for s in self.fast_steps)) if late is not None]
        out = parts[0] if parts else late_points(self.log.limit(0), self.catalog)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()
