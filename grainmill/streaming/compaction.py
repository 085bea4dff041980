"""Folding a stream of change-log entries into a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.changelog import fold
from ..sources.versions import Versions


def fold_batch(states: Versions, entries: DataFrame, batch: int, keep: int = 2) -> bool:
    """The state after a batch, from that before it; False where the batch was folded already, and nothing is done.

    State 0 is the table before the stream; batch ``b`` makes state ``b + 1``, from the
    highest state below, as a stream's empty batches make none.
    """
    if (states.latest() or 0) >= batch + 1:
        return False
    states.write(fold(states.read(states.latest(batch)), entries), batch + 1)
    for old in states.numbers()[:-keep]:
        states.drop(old)
    return True


def fold_stream(entries: DataFrame, states: Versions, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Start a stream of ``LOG`` entries into ``states``; all that is present, then it ends.

    A batch that is run again, as after a lost driver, finds its state and leaves it.
    """
    return entries.writeStream.foreachBatch(lambda df, batch: fold_batch(states, df, batch, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
