"""Incremental arrival: the batch operators behind ``foreachBatch``.

The engine is a batch engine; a stream of new partitions is handled by running
the keyed upsert on every micro-batch.  There is no watermark: late data are
handled by the visibility rule on announce dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.driver import stable_hash
from ..operators.merge import fingerprint


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, by: str | None = None):
    """Start a query that upserts each micro-batch into the Parquet table at ``target``.

    New files are written beside the old ones and the pointer file moves last,
    so a restarted micro-batch finds either state whole.  A version is named by
    checkpoint, batch and contents: a batch that is run again changes nothing,
    and another query's batch of the same number is another version.  ``by``: a
    key column whose values have files of their own, so that a micro-batch
    writes no more than the values that it holds.
    """
    from ..plans.publish import PointerTable

    table = PointerTable(stream.sparkSession, target, by)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, keys, order, stable_hash([checkpoint, batch_id, *fingerprint(batch)])[:32])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
