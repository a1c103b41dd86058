"""An exact limit on the number of distinct series keys per scope, first come first served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.tags import canonical_tags, scope

KEYS = "scope string, series string, key_tags array<struct<key:string,value:string>>"
KEY = ["scope", "series", "key_tags"]


def keyed(points: DataFrame, scope_key: str | None) -> DataFrame:
    return points.withColumns({"scope": scope("tags", scope_key), "key_tags": canonical_tags("tags")})


def first_in_scope(keys: DataFrame, room: DataFrame | None, limit: int) -> DataFrame:
    """The first of the ``keys`` (``scope, series, key_tags, first_seq``) of each scope, as many as it has room for.

    ``room`` (``scope, used``) is what a scope has used of the ``limit`` before; scopes that it lacks have used nothing. Keys are
    sorted by range over all tasks, so a hot scope is spread over many; its pieces are counted, one row for each task and scope,
    and a key's rank is its place in its piece after the sizes of the pieces before. No task sees a scope as a whole.
    """
    order = ["scope", "first_seq", "series", "key_tags"]
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = storage.staged(placed.select(*KEY, F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", 33)
    pieces = placed.groupBy("scope", part.alias("part")).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if room is not None:
        pieces = pieces.join(room, "scope", "left").withColumn("before", F.col("before") + F.coalesce("used", F.lit(0)))
    # of a piece, the first so many pass; pieces without any are not joined at all
    pieces = pieces.where(F.col("before") < limit).select("scope", "part", (F.col("begin") + limit - F.col("before")).alias("end"))
    return placed.withColumn("part", part).join(pieces, ["scope", "part"]).where(F.col("at") < F.col("end")).select(*KEY)


def admit(points: DataFrame, limit: int, scope_key: str | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted points, rejected points, newly admitted keys) under at most ``limit`` keys per scope.

    Keys come in the order of their least ``seq``; those already ``known`` always pass. A key once admitted stays, so this is the
    result of taking the points one by one. Only distinct keys are ranked, and no task ranks more than its share of a scope. Ties of
    ``seq`` go by series and tags; empty points give empty results.
    """
    rows = keyed(points, scope_key)
    fresh = rows.groupBy(*KEY).agg(F.min("seq").alias("first_seq"))
    room = None
    if known is not None:
        fresh = fresh.join(known.select(*KEY), KEY, "left_anti")
        room = known.groupBy("scope").agg(F.count(F.lit(1)).alias("used"))
    new = storage.staged(first_in_scope(fresh, room, limit), "admitted")
    allowed = new if known is None else new.unionByName(known.select(*KEY))
    names = points.columns
    return (
        rows.join(allowed, KEY, "left_semi").select(*names),
        rows.join(allowed, KEY, "left_anti").select(*names),
        new,
    )


class CardinalityTracker:
    """The set of known keys, usable alone.

    Keys are kept in tables, each with keys that the others lack, and are read as one relation whatever their number.
    """

    def __init__(self, spark: SparkSession, scope_key: str | None = None, paths: list[str] | None = None):
        self.spark, self.scope_key, self.paths = spark, scope_key, list(paths or [])

    @property
    def keys(self) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], KEYS)

    def current_count(self, scope_name: str = "default") -> int:
        return self.keys.where(F.col("scope") == scope_name).count()

    def counts(self) -> DataFrame:
        return self.keys.groupBy("scope").agg(F.count(F.lit(1)).alias("series_keys"))

    def new_keys(self, points: DataFrame) -> DataFrame:
        """The distinct keys of points that are not known."""
        keys = keyed(points, self.scope_key).select(*KEY).distinct()
        return keys.join(self.keys, KEY, "left_anti") if self.paths else keys

    def seed(self, points: DataFrame) -> None:
        """Take the keys of points as known, without a limit."""
        self.paths.append(storage.keep(storage.staged(self.new_keys(points), "known"))._staged_at)

    def register(self, points: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """(admitted, rejected); the new keys become known."""
        good, bad, new = admit(points, limit, self.scope_key, self.keys if self.paths else None)
        self.paths.append(storage.keep(new)._staged_at)
        return good, bad
