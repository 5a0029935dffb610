"""Cut points that survive the loss of an executor.

A cut point is a Parquet table in the folder that the cluster shares, named by ``spark.checkpoint.dir``.
It replaces ``localCheckpoint`` (whose only copy dies with its executor) and is columnar and compressed,
unlike ``checkpoint()``. Only a session on one machine (``local[...]``) may fall back to a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_WRITTEN: list[tuple[str, str | None]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; raises where a cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _ROOTS[app] = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(_forget, _ROOTS[app])
    return _ROOTS[app]


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, name: str = "cut") -> DataFrame:
    """Like ``cut``, but bucketed by ``key``: later joins on ``key`` read it without another shuffle.

    There are as many buckets as ``spark.sql.shuffle.partitions``; rows are placed before ``df`` is evaluated by
    the caller's own ``repartition(buckets(spark), key)``, so each task writes one file."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/quillmill/{table}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets(spark), key).saveAsTable(table)
    _WRITTEN.append((path, table))
    return spark.table(table)


def cut_parts(df: DataFrame, key: str, name: str = "parts") -> str:
    """Write ``df`` once, one folder for each value of ``key``; the path is for ``read_part``."""
    path = f"{shared_folder(df.sparkSession)}/quillmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(key).parquet(path)
    _WRITTEN.append((path, None))
    return path


def read_part(path: str, key: str, value: int, columns: list[str]) -> pd.DataFrame:
    """Rows of one value of ``key``, read by a task itself: what tasks share by reference passes no driver."""
    files, root = (fs.FileSystem.from_uri(path)) if ":" in path else (fs.LocalFileSystem(), path)
    folder = f"{root}/{key}={value}"
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return pd.DataFrame({c: [] for c in columns})
    return pq.read_table(folder, columns=columns, filesystem=files, partitioning=None).to_pandas()


def buckets(spark: SparkSession) -> int:
    """Buckets of a table written by ``cut_by``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean(spark: SparkSession) -> None:
    """Drop every table that this process has cut; DataFrames that still read them can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path, table = _WRITTEN.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
