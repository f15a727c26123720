"""Versions that arrive as a stream.

Every micro-batch is reduced to its own best version per key and written under
its epoch, so that a batch that is repeated after a failure replaces itself.
Reading merges the epochs with the batch operator; a compaction does the same
and writes one. State is therefore files in a shared folder, not memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from quernstone.operators import versions


def stream_parquet(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_latest(stream: DataFrame, folder: str, key: Sequence[str], order: Sequence[Column], keep: Sequence[str], carry: Sequence[str]) -> None:
    """Drain a stream into folder/epochs. `carry` names the columns that `order` needs besides those kept."""
    columns = list(dict.fromkeys([*keep, *carry]))

    def one(batch: DataFrame, epoch: int) -> None:
        versions.latest(batch, key, order, columns).write.mode("overwrite").parquet(f"{folder}/epochs/epoch={epoch}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def read_latest(spark: SparkSession, folder: str, key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The best version per key over all epochs."""
    return versions.latest(spark.read.parquet(f"{folder}/epochs"), key, order, keep)


def compact(spark: SparkSession, folder: str, target: str, key: Sequence[str], order: Sequence[Column], keep: Sequence[str], carry: Sequence[str]) -> None:
    """Write the merged state as epoch 0 of a new folder."""
    read_latest(spark, folder, key, order, list(dict.fromkeys([*keep, *carry]))).write.mode("overwrite").parquet(f"{target}/epochs/epoch=0")
