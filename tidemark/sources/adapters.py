"""Other tables as points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros_ns(ts: str) -> Column:
    """A timestamp of microseconds, with or without zone, as ns since 1970, whatever the zone of the session."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) * 1000")


def from_events(events: DataFrame) -> DataFrame:
    """Events as points: the type is the series, user and ``props.k`` are tags, ``event_id`` the order of arrival."""
    k = F.get_json_object("props", "$.k")
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.coalesce(k, F.lit("")))
    return events.select(F.col("event_type").alias("series"), micros_ns("ts").alias("ts"), F.col("event_id").alias("seq"), "value", tags.alias("tags"))


def from_orders(orders: DataFrame) -> DataFrame:
    tags = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string"))
    return orders.select(
        F.col("o_orderpriority").alias("series"), micros_ns("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("value"), tags.alias("tags"),
    )


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order lines as points. They have no unique number, so ``seq`` is made of the order and the rank of the line in it."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in lineitem.columns if c != "l_orderkey"]))
    tags = F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("supplier"), F.col("l_suppkey").cast("string"))
    return lineitem.select(
        F.col("l_returnflag").alias("series"), micros_ns("l_shipdate").alias("ts"), (F.col("l_orderkey") * 1000 + rank).alias("seq"),
        F.col("l_extendedprice").alias("value"), tags.alias("tags"),
    )
