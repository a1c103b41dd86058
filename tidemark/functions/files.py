"""File names of segments, and the rows that live segments hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The name of a file without its folders, however the path is spelled.

    Surrounding blanks are cut, percent-encoding is undone (a ``+`` stays one), and ``/`` and ``\\`` both separate folders.
    Only names that hold a ``%`` or ``\\`` take the long way.
    """
    short = F.substring_index(F.trim(path), "/", -1)
    plain = F.regexp_replace(F.trim(path), r"\+", "%2B")
    plain = F.coalesce(F.try_url_decode(plain), path)
    long = F.regexp_extract(F.trim(plain), r"([^/\\]*)$", 1)
    return F.when(path.contains("%") | path.contains("\\"), long).otherwise(short)


def live_records(segments: DataFrame) -> DataFrame:
    """``segment_id, file`` of the manifest records that are not retired, each once."""
    return (
        segments.where(F.col("retired_at").isNull() & F.col("file_name").isNotNull())
        .select("segment_id", base_name(F.col("file_name")).alias("file"))
        .distinct()
    )


def live_rows(segment_rows: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """``file`` and ``columns`` of the rows whose file a live record names. Repeated rows stay."""
    named = segment_rows.where(F.col("file_name").isNotNull()).select(base_name(F.col("file_name")).alias("file"), *columns)
    return named.join(live_records(segments).select("file").distinct(), "file", "left_semi")
