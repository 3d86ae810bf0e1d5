"""Resumable append as a stream: answers are stored as they arrive, each key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from answerscope.sources.tables import append_new


def append_stream(incoming: DataFrame, path: str, keys: Sequence[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """S08 on a streaming source.

    A batch that is run again after a failure adds nothing, because stored keys are left out.
    """
    def store(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys)

    writer = incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
