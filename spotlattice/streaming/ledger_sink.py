"""The append-only run ledger as a streaming sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spotlattice.sources.io import append_new


def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch adds the rows that the ledger at ``path`` does not hold yet.

    A batch that runs again after a failure adds nothing twice, for its rows are
    in the ledger by then.
    """
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
