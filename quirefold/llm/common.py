"""What the corpus operators share: reading tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, gone when it ends; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """One struct column that holds the row, so that no column of the caller can clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


#: Arrow batches are taken in parts of so many bytes, so that neither a worker nor the executor holds a second batch as large as the one that comes.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes each, without a copy; no part is empty."""
    if batch.num_rows:
        rows = max(1, min(batch.num_rows, most * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Frees what Arrow and the C library keep of freed memory: a Python worker lives on, with the next stage's arrays beside."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """fn on parts of every Arrow batch; None is left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if (out := fn(part)) is not None:
                    yield out
        give_back()

    return df.mapInArrow(each, schema)


def spread_sample(df: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """The ids of at most `most` rows for each value of `by`: those of the smallest hash of `key`, ties by key.

    Only the two columns are read; the partial limit of the window's rank runs before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("__by").orderBy("__h", "__key")
    rows = df.where(F.col(key).isNotNull() & F.col(by).isNotNull()).select(F.col(key).alias("__key"), F.col(by).alias("__by")).distinct()
    return rows.withColumn("__h", F.xxhash64("__key")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select("__key", "__by")


#: So many ids at most are broadcast (some 40 bytes each with the hash table, on every executor); beyond, rows are shuffled to meet them.
MAX_BROADCAST_IDS = 1_000_000


def split_by_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id_col is among the distinct ids (column __id), and the others, without moving a row.

    With more than MAX_BROADCAST_IDS ids it gives all rows, and None: then the join itself has to find them.
    """
    if ids.count() > MAX_BROADCAST_IDS:
        return rows, None
    small = F.broadcast(ids)
    on = F.col(id_col).cast("long") == F.col("__id")
    return rows.join(small, on, "left_semi"), rows.join(small, on, "left_anti")
