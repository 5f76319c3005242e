"""Documents as a stream: a document is whole in its batch, so the operators
run unchanged on each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply operator to every batch of a stream; a batch's rows are the folder
    batch=<number> of path, written anew if the batch is run again, so no row comes
    twice. Gives a writer: choose its trigger and start() it."""
    return stream.writeStream.foreachBatch(lambda df, n: operator(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")).option("checkpointLocation", checkpoint)
