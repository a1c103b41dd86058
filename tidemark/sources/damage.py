"""Damage of files as an error of the engine that tells where it is."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.model import Corruption

# What the messages of Spark, Hadoop and Parquet hold when bytes of a file are not as they were written.
_SIGNS = ("checksum", "crc", "not a parquet file", "corrupt", "decoding", "could not read page", "can not read", "cannot_read_file_footer", "failed_read_file", "malformed", "unexpected end")


def is_damage(error: BaseException) -> bool:
    text = str(error).lower()
    return any(s in text for s in _SIGNS) and "does not exist" not in text and "file_not_exist" not in text


def _readable(spark: SparkSession, path: str, *columns: str) -> bool:
    rows = spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    try:
        (rows.select(*columns) if columns else rows).write.format("noop").mode("overwrite").save()
        return True
    except Exception as e:
        if is_damage(e):
            return False
        raise


def locate(spark: SparkSession, what: str, paths: list[str], error: BaseException | None = None) -> Corruption:
    """The error for the first damaged file among folders of points, with the first series and time it holds, if they can be read."""
    for folder in paths:
        for path, _, is_folder in storage.listing(spark, folder):
            if is_folder or not path.endswith(".parquet"):
                continue
            try:
                if _readable(spark, path):
                    continue
                first = None
                if _readable(spark, path, "series", "ts"):
                    first = spark.read.parquet(path).agg(F.min(F.struct("series", "ts"))).first()[0]
            except Exception:  # not even the footer can be read
                first = None
            return Corruption(f"{what}: {path} is damaged", first["series"] if first else None, first["ts"] if first else None)
    return Corruption(f"{what}: {str(error).splitlines()[0] if error else 'damaged'}")


@contextmanager
def reported(spark: SparkSession, what: str, paths: list[str]) -> Iterator[None]:
    """Inside the block, failures that come from damaged files among ``paths`` are raised as ``Corruption``."""
    try:
        yield
    except Corruption:
        raise
    except Exception as e:
        if not is_damage(e):
            raise
        raise locate(spark, what, paths, e) from e
