"""Numbers of arrival for new rows, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import storage

WITHIN = 33  #: low bits of ``monotonically_increasing_id`` that count the rows of a task


def with_sequence(rows: DataFrame, base: int, order: list[str] | None = None, bad: Column | None = None) -> tuple[DataFrame, int, int]:
    """Rows with a dense ``seq`` from ``base`` on, in ``order`` (or as they come), the next free number, and how many are ``bad``.

    Rows are sorted by range into partitions and staged, so their places are fixed; the sizes of the partitions (one number
    each) give every partition its first number.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    placed = storage.staged(placed.select("*", F.monotonically_increasing_id().alias("__at")), "sequence")
    part = F.shiftright("__at", WITHIN)
    sizes = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count(F.lit(1)), F.count(F.when(bad, 1)) if bad is not None else F.lit(0)).collect())
    first, starts = base, []
    for p, n, _ in sizes:
        starts.append((p, first - (p << WITHIN)))
        first += n
    if not starts:
        return placed.drop("__at").withColumn("seq", F.lit(0).cast("long")), base, 0
    if len(starts) == 1:
        numbered = placed.withColumn("seq", F.col("__at") + starts[0][1])
    else:
        offsets = spark.createDataFrame(starts, "__part long, __first long")
        numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("seq", F.col("__at") + F.col("__first"))
    return numbered.drop("__part", "__at", "__first"), first, sum(s[2] for s in sizes)
