"""Doubles and their 64 bits, exactly. Parquet files written by Spark keep one bit pattern of NaN; a column of bits keeps all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _viewed(rows: DataFrame, column: str, out: str, kind: pa.DataType, sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(column)
            bits = pa.Array.from_buffers(kind, len(a), a.buffers(), a.null_count, a.offset)
            yield pa.RecordBatch.from_arrays([*b.columns, bits], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` {sql}")


def with_bits(rows: DataFrame, column: str = "value", out: str = "value_bits") -> DataFrame:
    """Rows with the bits of a double column as a long; null stays null."""
    return _viewed(rows, column, out, pa.int64(), "long")


def from_bits(rows: DataFrame, column: str = "value_bits", out: str = "value") -> DataFrame:
    """Rows with a double made of the bits in a long column."""
    return _viewed(rows, column, out, pa.float64(), "double")
