"""Incremental ingestion: of all rows that ever come in, the first of each key is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomstone.sources.stores import append_unseen


def ingest(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append new keys to a JSON store that this stream alone writes, once over what is there.

    Seen keys are kept in the stream's state, dealt by key, so no micro-batch reads the store again; the file sink and
    the checkpoint make a batch that is repeated after a failure count once."""
    return stream.dropDuplicates(keys).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """As ingest, into a store that others write too: each micro-batch is matched with the keys that are there."""
    return stream.writeStream.foreachBatch(lambda df, _: append_unseen(df, path, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
