"""Functions on series names and tag maps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import DEFAULT_SCOPE


def tag_match(tags: str | Column, pairs: dict[str, str] | None) -> Column | None:
    """True where the map holds every pair; more tags do not matter. None, no condition, if there are no pairs."""
    if not pairs:
        return None
    m = F.col(tags) if isinstance(tags, str) else tags
    return reduce(and_, [F.coalesce(F.try_element_at(m, F.lit(k)) == F.lit(v), F.lit(False)) for k, v in sorted(pairs.items())])


def canonical_tags(tags: str | Column) -> Column:
    """Pairs of a map as an array in order of key and value. Maps can be neither grouped by order nor compared; this can."""
    return F.array_sort(F.map_entries(tags))


def series_key(series: str | Column = "series", tags: str | Column = "tags") -> Column:
    """Identity of a series for its cardinality: name and canonical tags."""
    s = F.col(series) if isinstance(series, str) else series
    return F.struct(s.alias("series"), canonical_tags(tags).alias("tags"))


def scope(tags: str | Column, key: str | None) -> Column:
    """Value of the scope tag; ``default`` if it is missing or empty or no key is set."""
    if key is None:
        return F.lit(DEFAULT_SCOPE)
    m = F.col(tags) if isinstance(tags, str) else tags
    return F.coalesce(F.nullif(F.try_element_at(m, F.lit(key)), F.lit("")), F.lit(DEFAULT_SCOPE))


def tag_terms(points, *keys: str):
    """``keys, k, v``: the distinct tag pairs per group of ``keys``; pre-aggregated before the shuffle."""
    return points.select(*keys, F.explode(F.map_entries("tags")).alias("e")).select(*keys, F.col("e.key").alias("k"), F.col("e.value").alias("v")).distinct()
