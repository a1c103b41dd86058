"""Streams into an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.engine import Engine


def write_stream(stream: DataFrame, engine: Engine, name: str, checkpoint: str, interval: str | None = None, order: list[str] | None = None, maintain: bool = True) -> StreamingQuery:
    """Start a query that puts each micro-batch of new points into a segment, exactly once.

    The number of the micro-batch is committed with its segment, so a batch that Spark repeats after a failure is skipped.
    Records of any age are taken; only those before the retention watermark are dropped. Without ``interval`` all that is
    available is processed and the query ends.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        engine.ingest_stream_batch(batch, name, batch_id, order)
        if maintain:
            engine.maintain()

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
