"""An extension beyond the language: predictions kept fresh while child rows arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine, Request


def rescore(engine: Engine, stream: DataFrame, time: str, request: Request, sink: Callable[[DataFrame, int], None], checkpoint: str, scorer: str = "history") -> StreamingQuery:
    """After each micro-batch of ``stream`` the statement runs again, anchored at the batch's latest ``time``; ``sink`` gets
    the predictions. The engine's catalog has to read the table that the stream feeds."""

    def each(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max(time)).first()[0]
        if at is not None:
            sink(engine.execute(replace(request, anchor_time=at), scorer), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Tumbling counts of arriving rows, closed once they are ``late`` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
