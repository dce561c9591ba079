"""Files as they arrive: a stream over a folder, each micro-batch through the same operators as a batch."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
BATCH_ID = "ingest_batch"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.pdf", files_a_batch: int = 1000) -> DataFrame:
    """doc_id, path, payload of the files of a folder and those that come."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("payload"))


def ingest(files: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], target: str, once: bool = False) -> StreamingQuery:
    """Writes what each operator makes of the new files to target/<name>, partitioned by micro-batch.

    A micro-batch that is run again after a failure overwrites its own partition, so each file counts once. The progress is
    kept in target/_progress, so target has to be a folder that outlives the cluster. once: ends when no file is left.
    """

    def step(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, operator in tables.items():
                path = str(PurePosixPath(target) / name) if "://" not in target else f"{target}/{name}"
                operator(kept).write.mode("overwrite").parquet(f"{path}/{BATCH_ID}={number}")
        finally:
            kept.unpersist()

    writer = files.writeStream.foreachBatch(step).option("checkpointLocation", f"{target}/_progress")
    return (writer.trigger(availableNow=True) if once else writer).start()
