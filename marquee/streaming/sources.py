"""Reading tables as streams and running streams to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder next to the job's checkpoints, where every executor can reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return what it has written, as a table.

    Append output goes straight to files. Update output is written per batch with its number, and
    the caller keeps the last row per key.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")  # a retried batch replaces itself

    query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{folder}/out")
