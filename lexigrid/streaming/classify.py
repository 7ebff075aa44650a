"""Classifying text as it arrives.

Scoring keeps no state between batches: a text is complete when it arrives.
Every micro batch runs the batch plan, so a stream gives what a batch gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def classify_stream(
    arriving: DataFrame,
    classify: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Write ``classify(batch)`` of each micro batch under ``sink``.

    A batch has its own folder, written in overwrite mode: after a failure the
    batch is run again and replaces what was there.  ``once`` works off what
    has arrived and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
