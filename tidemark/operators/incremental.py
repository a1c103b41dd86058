"""Runs that process only records added or changed since the last run that succeeded.

What has been processed is kept as disjoint intervals of sequence numbers, not as one highest number: records that
were committed late lie in gaps below it and are still found. A run subtracts the processed intervals from
the available ones, processes the gaps, and commits its output together with the merged intervals in one rename.
With each number the content it was processed with is kept, so a record that is amended opens a gap again. The entries of the
log that a run has seen are intervals too: a run reads only entries that no run has seen, however late they were written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.files import live_rows
from tidemark.operators import intervals


def latest_inserts(wal: DataFrame) -> DataFrame:
    """``seq, entry_no, series, ts, value, tags`` of the latest entry of each insert.

    ``tags`` is the array of pairs in canonical order, null where the entry has none. Entries without ``seq`` name
    no record and are left out; an entry without ``entry_no`` counts as older than any other.
    """
    entry = F.struct(
        F.coalesce("entry_no", F.lit(-(2**63))).alias("entry_no"), "series", "ts", "value",
        F.array_sort(F.map_entries("tags")).alias("tags"),
    )
    inserts = wal.where((F.col("kind") == "Insert") & F.col("seq").isNotNull())
    return inserts.groupBy("seq").agg(F.max(entry).alias("e")).select("seq", "e.*")


def held_values(segment_rows: DataFrame, segments: DataFrame, within: DataFrame) -> DataFrame:
    """Distinct ``seq, value`` that the files of live segments hold, of the numbers that ``within`` spans.

    The span is one row, and its two bounds reach the scan as pushed filters.
    """
    lo, hi = within.agg(F.min("seq"), F.max("seq")).first()
    rows = segment_rows.where(F.col("seq").between(lo, hi)) if lo is not None else segment_rows.where("false")
    return live_rows(rows, segments, "seq", "value").select("seq", "value").distinct()


def pending(latest: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of ``latest`` that ``held`` lacks in their present content, and the intervals after their commit.

    For a store that has no ledger: what is processed is judged by all that it holds.
    Values are compared with NaN equal to NaN and null equal to null. Empty tables give empty results.
    """
    k = held.select(F.col("seq").alias("held_seq"), F.col("value").alias("held_value"))
    same = (F.col("seq") == F.col("held_seq")) & F.col("value").eqNullSafe(F.col("held_value"))
    processed = intervals.of_numbers(latest.join(k, same, "left_semi"), "seq")
    gaps = intervals.subtract(intervals.of_numbers(latest, "seq"), processed)
    return intervals.rows_in(latest, "seq", gaps), intervals.union(processed, gaps)


SKIPS = 64  #: stretches of seen entries that a scan of the log is told to skip; the exact subtraction comes after it
MERGE_RUNS = 16  #: runs after which the contents kept with the numbers are put into one table


class Ledger:
    """Outputs of the runs in ``path``, each in a folder of its own with the state up to and with it.

    ``data`` is the output of a run, ``intervals`` the numbers processed, ``entries`` the entries of the log seen, ``held`` the
    content (columns ``content``) that each number of the run was processed with. A run writes into a temporary folder and
    becomes valid by the rename of that folder; what a failed run leaves is never read and is cleared by the next one. There
    must be one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, content: tuple[str, ...] = ("value",)):
        self.spark, self.path, self.content = spark, path.rstrip("/"), content

    def runs(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, folder in storage.listing(self.spark, self.path) if folder]
        return sorted(int(n[4:]) for n in names if n.startswith("run-"))

    def _set(self, name: str) -> DataFrame:
        done = self.runs()
        if not done:
            return self.spark.createDataFrame([], "block long, lo long, hi long")
        return self.spark.read.parquet(f"{self.path}/run-{done[-1]}/{name}")

    def processed(self) -> DataFrame:
        """Intervals of the numbers processed by the runs that succeeded."""
        return self._set("intervals")

    def held(self) -> DataFrame | None:
        """``seq, entry_no, run`` and the content columns of each number in each run since the last merge, None before the first run."""
        paths = []
        for r in reversed(self.runs()):
            merged = f"{self.path}/run-{r}/held-all"
            if storage.exists(self.spark, merged):
                paths.append(merged)
                break
            paths.append(f"{self.path}/run-{r}/held")
        return self.spark.read.parquet(*paths) if paths else None

    def adopt(self, held: DataFrame) -> None:
        """Commit, as the first run, what has been persisted before there was a ledger: ``seq`` and the content columns.

        A number may have several contents; a record with any of them is processed.
        """
        if self.runs():
            raise ValueError(f"{self.path} has runs already")
        rows = held.where(F.col("seq").isNotNull()).select("seq", F.lit(None).cast("long").alias("entry_no"), F.lit(0).alias("run"), *self.content)
        empty = self._set("entries")
        self._commit(0, rows.select("seq", *self.content).limit(0), rows, lambda kept: intervals.of_numbers(kept, "seq"), empty)

    def _commit(self, number: int, data: DataFrame, held: DataFrame, processed: Callable[[DataFrame], DataFrame], entries: DataFrame) -> DataFrame:
        """Write a run and publish it; ``processed`` gives the intervals from the written ``held``."""
        temporary = f"{self.path}/.open-{number}"
        storage.delete(self.spark, temporary)
        data.write.parquet(f"{temporary}/data")
        before, name = self.held(), "held"
        if number % MERGE_RUNS == MERGE_RUNS - 1 and before is not None:
            both = before.unionByName(held)
            last = both.groupBy("seq").agg(F.max("run").alias("run"))
            both.join(last, ["seq", "run"], "left_semi").select(*held.columns).write.parquet(f"{temporary}/held-all")
            name = "held-all"
        else:
            held.write.parquet(f"{temporary}/held")
        mine = self.spark.read.parquet(f"{temporary}/{name}").where(F.col("run") == number)
        processed(mine).write.parquet(f"{temporary}/intervals")
        entries.write.parquet(f"{temporary}/entries")
        storage.rename(self.spark, temporary, f"{self.path}/run-{number}")
        return self.spark.read.parquet(f"{self.path}/run-{number}/data")

    def unseen(self, wal: DataFrame) -> DataFrame:
        """Rows of the log whose entry no run has seen; entries without a number are always among them.

        The longest stretches of seen entries reach the scan as pushed filters, the rest is subtracted exactly.
        """
        if not self.runs():
            return wal
        seen = self._set("entries")
        stretches = intervals.longest(seen, SKIPS)
        if not stretches:
            return wal
        for lo, hi in stretches:
            wal = wal.where(F.col("entry_no").isNull() | (F.col("entry_no") < lo) | (F.col("entry_no") > hi))
        return intervals.rows_in(wal, "entry_no", seen, inside=False)

    def _changed(self, latest: DataFrame, before: DataFrame) -> DataFrame:
        """``seq`` of the records whose number is processed (and so is held), but not with their present content.

        An entry older than the one that was processed changes nothing. Only the contents in the span of these numbers are read.
        """
        lo, hi = latest.agg(F.min("seq"), F.max("seq")).first()
        if lo is None:
            return latest.select("seq")
        was = before.where(F.col("seq").between(lo, hi)).select("seq", "run", F.col("entry_no").alias("was_no"), *[F.col(c).alias(f"was_{c}") for c in self.content])
        same = F.lit(True)
        for c in self.content:
            same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
        stale = F.coalesce(F.col("was_no") > F.col("entry_no"), F.lit(False))
        # of the contents that a number was processed with, those of the last run that had it count
        judged = latest.select("seq", "entry_no", *self.content).join(was, "seq")
        judged = judged.groupBy("seq").agg(F.max(F.struct("run", (same | stale).alias("same"))).alias("last"))
        return judged.where(~F.col("last.same")).select("seq")

    def run(self, wal: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Process what is new or changed in ``wal`` and commit; returns the output of this run.

        ``process`` gets the latest unprocessed entry of each record and may filter or change it at will; by default the records
        come out as they are. Values are compared with NaN equal to NaN and null equal to null. An entry that repeats
        the content a number was processed with is seen and not processed again. An empty log gives an empty run.
        """
        with storage.scope():
            for p, _, _ in storage.listing(self.spark, self.path):
                if p.rsplit("/", 1)[1].startswith(".open-"):
                    storage.delete(self.spark, p)
            number = max(self.runs(), default=-1) + 1
            processed, before, rows = self.processed(), self.held(), self.unseen(wal)
            latest = storage.staged(latest_inserts(rows), "latest")
            available, still = intervals.of_numbers(latest, "seq", unique=True), processed
            if before is not None:
                still = intervals.subtract(processed, intervals.of_numbers(self._changed(latest, before), "seq", unique=True))
            gaps = intervals.subtract(available, still)
            todo = storage.staged(intervals.rows_in(latest, "seq", gaps), "todo")
            held = todo.select("seq", "entry_no", F.lit(number).alias("run"), *self.content)
            merged = lambda mine: intervals.union(processed, intervals.of_numbers(mine, "seq", unique=True))
            entries = intervals.union(self._set("entries"), intervals.of_numbers(rows.select("entry_no"), "entry_no"))
            return self._commit(number, process(todo) if process else todo, held, merged, entries)
