"""Tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tectra.schemas import CatalogError


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the place that the cluster names. Only a session within one machine may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise CatalogError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = os.path.join(tempfile.gettempdir(), "tectra-shared")
    return f"{base}/tectra-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a written table: what reads it several times computes it once, and a lost executor costs no rerun."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Removes the files of written tables that nothing will read again."""
    for df in frames:
        for path in {os.path.dirname(x) for x in df.inputFiles() if "/tectra-" in x}:
            fs, p = file_system(df.sparkSession, path)
            fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: it is written under another name, which then changes. A file of that name goes first."""
    fs, p = file_system(spark, path)
    _, fresh = file_system(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(fresh, p):
        raise CatalogError(f"{path} couldn't be put in place")
