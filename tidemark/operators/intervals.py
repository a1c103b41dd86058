"""Sets of whole numbers kept as disjoint intervals, with set operations that run block by block.

An interval is a row ``block, lo, hi`` (both ends belong to it) and never crosses the border of a block of ``BLOCK``
numbers. Equal sets thus have equal rows, every operation is a window over one block, and a block holds at most
``BLOCK`` / 2 intervals whatever the size or skew of the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import floor_div

BLOCK = 1 << 16
SUPER = 1 << 12  #: blocks over which ``longest`` joins neighbouring intervals


def of_numbers(numbers: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """The set of the numbers in a column; nulls are no numbers, repeats count once. ``unique`` says that there are no repeats."""
    n = numbers.where(F.col(column).isNotNull()).select(F.col(column).alias("n"))
    n = n if unique else n.distinct()
    n = n.withColumn("block", floor_div(F.col("n"), BLOCK))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("n"))
    n = n.withColumn("island", F.col("n") - rank)
    return n.groupBy("block", "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("island")


def _combine(a: DataFrame, b: DataFrame, rule: Column) -> DataFrame:
    """Pieces where ``rule`` over ``in_a`` and ``in_b`` holds, by a sweep over the ends of the intervals."""

    def ends(df: DataFrame, d: tuple[int, int]) -> DataFrame:
        steps = F.array(
            F.struct(F.col("lo").alias("at"), F.lit(d[0]).alias("da"), F.lit(d[1]).alias("db")),
            F.struct((F.col("hi") + 1).alias("at"), F.lit(-d[0]).alias("da"), F.lit(-d[1]).alias("db")),
        )
        return df.select("block", F.inline(steps))

    sweep = Window.partitionBy("block").orderBy("at")
    points = ends(a, (1, 0)).unionByName(ends(b, (0, 1))).groupBy("block", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    points = points.select(
        "block",
        "at",
        (F.sum("da").over(sweep) > 0).alias("in_a"),
        (F.sum("db").over(sweep) > 0).alias("in_b"),
        F.lead("at").over(sweep).alias("next_at"),
    )
    points = points.withColumn("inside", rule & F.col("next_at").isNotNull())
    # neighbouring pieces are joined, so that the intervals of the result are as long as can be
    points = points.withColumn("was", F.coalesce(F.lag("inside").over(sweep), F.lit(False)))
    pieces = points.where("inside").withColumn("run", F.sum(F.when(F.col("was"), 0).otherwise(1)).over(sweep))
    return pieces.groupBy("block", "run").agg(F.min("at").alias("lo"), (F.max("next_at") - 1).alias("hi")).drop("run")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, F.col("in_a") | F.col("in_b"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, F.col("in_a") & ~F.col("in_b"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, F.col("in_a") & F.col("in_b"))


def rows_in(rows: DataFrame, column: str, intervals: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose number lies in an interval, or those whose number does not (a null does not).

    One pass in order of the numbers of each block, no join by range.
    """
    keys = [F.col(c) for c in rows.columns]
    tagged = rows.where(F.col(column).isNotNull()).select(
        floor_div(F.col(column), BLOCK).alias("__block"), F.col(column).alias("__at"), F.lit(None).cast("long").alias("__hi"),
        F.struct(*keys).alias("__row"),
    )
    marks = intervals.select(
        F.col("block").alias("__block"), F.col("lo").alias("__at"), F.col("hi").alias("__hi"),
        F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"),
    )
    order = Window.partitionBy("__block").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lies = F.coalesce(F.col("__reach") >= F.col("__at"), F.lit(False))
    out = (
        tagged.unionByName(marks)
        .withColumn("__reach", F.max("__hi").over(order))
        .where(F.col("__row").isNotNull() & (lies if inside else ~lies))
        .select("__row.*")
    )
    return out if inside else out.unionByName(rows.where(F.col(column).isNull()))


def longest(intervals: DataFrame, k: int, gather: int = 10_000) -> list[tuple[int, int]]:
    """At most ``k`` long stretches of a set, each without a hole, in order; meant for conditions that a scan can skip by.

    At most ``gather`` rows come to the driver. Of a set with more pieces the result is no less true, only shorter.
    """
    over = Window.partitionBy("sup").orderBy("lo")
    pieces = intervals.select(floor_div(F.col("block"), SUPER).alias("sup"), "lo", "hi")
    joins = F.coalesce(F.lag("hi").over(over) + 1 == F.col("lo"), F.lit(False))
    pieces = pieces.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("new").over(over))
    pieces = pieces.groupBy("sup", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out: list[list[int]] = []
    for lo, hi in sorted(tuple(r) for r in pieces.orderBy((F.col("hi") - F.col("lo")).desc()).limit(gather).select("lo", "hi").collect()):
        if out and out[-1][1] + 1 == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return sorted(tuple(x) for x in sorted(out, key=lambda x: x[0] - x[1])[:k])
