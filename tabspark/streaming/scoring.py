"""Scoring a stream with a fitted model: a stateless query on the same plan as batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabspark.plans.train import Fitted


def score_stream(fitted: Fitted, stream: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for a streaming DataFrame; the same alignment and checks as in batch."""
    if not stream.isStreaming:
        raise ValueError("use score() for a table")
    return fitted.predict(stream, keep)


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the scores to a Parquet folder, exactly once, restarting from the checkpoint."""
    writer = scored.writeStream.format("parquet").outputMode("append").option(
        "path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
