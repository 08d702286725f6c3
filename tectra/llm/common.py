"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most distinct strings that a worker's table keeps; at the bound the table starts anew.
TABLE_ENTRIES = 700_000
#: Longer strings are worked out each time instead of kept.
TABLE_CHARS = 64
#: Rows that a task works on at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """A file of the public tokenizers, or `name` itself if it is a path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names. Only a session within one machine may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = os.path.join(tempfile.gettempdir(), "tectra-shared")
        os.makedirs(base, exist_ok=True)
    return f"{base}/tectra-{uuid.uuid4().hex}"


def cut(df: DataFrame, partition_by: Iterable[str] = (), spent: bool = False) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs no rerun.
    `spent`: what was shuffled for it is removed as soon as it is written, instead of when the driver collects its garbage."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true" if spent else before)
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables made by `cut` that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {os.path.dirname(x) for df in tables for x in df.inputFiles() if "/tectra-" in x}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`make` runs once in each task and returns the function from batch to batch; a batch has at most BATCH_ROWS rows. The session
    is set to send no larger ones, as texts may be long and a batch stands in memory on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                yield f(b.slice(k, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts are empty ones."""
    return [x or "" for x in batch.column(column).to_pylist()]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, so that no other column's name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Ids that a join may broadcast (8 bytes each, some 64 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def few(ids: DataFrame, limit: int | None = None) -> DataFrame:
    """A written table of ids, marked for broadcast if its rows are at most `limit`."""
    return hinted(cut(ids), limit)


def hinted(table: DataFrame, limit: int | None = None) -> DataFrame:
    """A table of a few whole numbers a row, marked for broadcast if its rows are at most `limit`."""
    return F.broadcast(table) if table.count() <= (BROADCAST_IDS if limit is None else limit) else table
