"""Streams into stores: each micro-batch is one SET."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecmill.plans.engine import Engine


def stream_into(engine: Engine, given: DataFrame, store: str, checkpoint: str, schema: str | None = None, available_now: bool = True,
    snapshot: str | None = None) -> StreamingQuery:
    """A stream (key, value[, pos]) into a store.

    SET replaces by key, so a micro-batch that is run again after a failure
    changes nothing. Without ``pos``, which row of a key repeated within one
    micro-batch stays is decided by the largest value as text.

    The checkpoint tells which batches are done, the engine holds what they
    brought. With ``snapshot`` the engine is written there after each batch, so
    that after a restart ``engine.read_snapshot(snapshot)`` and the same
    checkpoint go on together: a batch whose snapshot was written but which
    was not marked as done is set again, which changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch
        if "pos" not in batch.columns:
            rows = batch.withColumn("pos", F.xxhash64(F.to_json("value")))
        engine.set(store, rows.select("pos", "key", "value"), schema)
        if snapshot is not None:
            engine.write_snapshot(snapshot)

    writer = given.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
