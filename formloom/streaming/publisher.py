"""Publishing as a stream: submissions arrive in micro-batches, each of which becomes a run of a published dataset.

What a batch writes does not grow with the dataset, and a batch that is replayed
is known by its number, so sums and concatenations count every submission once.
Two streams may publish into one dataset under names of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.publish import Link
from ..plans.published import PublishedDataset


def publish_stream(submissions: DataFrame, link: Link, dataset: PublishedDataset, order: list[str], checkpoint: str, trigger: dict | None = None, writer: str = "stream") -> StreamingQuery:
    """Starts the stream; ``trigger`` as for DataStreamWriter (default: all there is, then stop)."""

    def each(batch: DataFrame, number: int) -> None:
        dataset.publish(batch, link, order, writer, number)

    return submissions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
