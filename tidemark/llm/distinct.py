"""Distinct counts over sets of identifiers that are too large to hold in one place.

Identifiers are hashed to 128 bits and the hash range is cut into disjoint buckets. The partial result of any part of
the data is the set of its (identifier, day, scope, region) by bucket; partial results are merged by a union within each
bucket. No identifier lies in two buckets, so the counts of the buckets add up, for every combination of groups and every
period made of days.

Error. Counts are exact but for collisions of the hash: with n distinct identifiers the chance that any two share
a hash, and a count is too low by one, is below n * n / 2**129 (for 10**12 identifiers, 2 in 10**15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import day_of

BUCKET_BITS = 16  #: the hash range is cut into 2 ** BUCKET_BITS ranges
GROUPS = ("day", "scope", "region")


def canonical_tags(tags: Column) -> Column:
    """Tag pairs as a set: each pair once, in order."""
    return F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<struct<k:string,v:string>>"))))


def scope_of(scope: Column) -> Column:
    """The scope without surrounding blanks; null and empty mean ``default``."""
    return F.coalesce(F.nullif(F.trim(scope), F.lit("")), F.lit("default"))


def partial(keys: DataFrame) -> DataFrame:
    """``bucket, a, b, day, scope, region`` of the identifiers seen, each combination once.

    ``a, b`` is the hash of series and tag set. A key without a ``region`` tag has region ``''``; of several the first in
    order holds. Rows without ``ts`` have a null day. A null series is a series of its own, null tags are no tags.
    """
    tags = canonical_tags(F.col("tags_sorted"))
    region = F.coalesce(F.get(F.filter(tags, lambda t: t["k"] == "region"), F.lit(0))["v"], F.lit(""))
    name = F.to_json(F.struct(F.col("series"), tags.alias("tags")))
    rows = keys.select(
        F.xxhash64(name).alias("a"), F.xxhash64(F.lit(11), name).alias("b"), day_of(F.col("ts")).alias("day"),
        scope_of(F.col("tenant_scope")).alias("scope"), region.alias("region"),
    )
    rows = rows.withColumn("bucket", F.shiftrightunsigned("a", 64 - BUCKET_BITS).cast("int"))
    return rows.groupBy("bucket", "a", "b", *GROUPS).agg(F.lit(1).alias("seen")).drop("seen")


def merge(*partials: DataFrame) -> DataFrame:
    """The partial result of the parts together."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.distinct()


def counts(partials: DataFrame, sets: tuple[tuple[str, ...], ...] | None = None, period: Column | None = None) -> DataFrame:
    """``day, scope, region, grouping, keys``: the number of distinct identifiers of every group of every set.

    ``sets`` are combinations of ``day``, ``scope`` and ``region``, by default all eight. ``grouping`` tells which columns a row is
    grouped by (4 for day, 2 for scope, 1 for region, added); the others are null. ``period`` replaces the day by
    a coarser one, such as the week. Identifiers are brought together by bucket once; all sets are
    then counted without moving them again, and only counts are added across buckets.
    """
    if sets is None:
        sets = tuple(tuple(g for i, g in enumerate(GROUPS) if m >> (2 - i) & 1) for m in range(8))
    p = partials if period is None else partials.withColumn("day", period)
    kinds = dict(p.dtypes)
    per_set = F.array(
        *[
            F.struct(
                F.lit(sum(1 << (2 - i) for i, g in enumerate(GROUPS) if g in s)).alias("grouping"),
                *[(F.col(g) if g in s else F.lit(None).cast(kinds[g])).alias(g) for g in GROUPS],
            )
            for s in sets
        ]
    )
    p = p.repartition("bucket").select("bucket", "a", "b", F.inline(per_set))
    p = p.groupBy("bucket", "a", "b", "grouping", *GROUPS).agg(F.lit(1).alias("one"))
    p = p.groupBy("bucket", "grouping", *GROUPS).agg(F.count(F.lit(1)).alias("keys"))
    return p.groupBy("grouping", *GROUPS).agg(F.sum("keys").alias("keys")).select(*GROUPS, "grouping", "keys")
