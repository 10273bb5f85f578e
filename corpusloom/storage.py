"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process (tests), a folder under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def fixed_path(spark: SparkSession, name: str) -> str:
    """The same path for the same name, for tables that are built once and opened again."""
    return f"{_root(spark)}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read more than once; its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt anew where an input has fewer parts than the cluster has cores (a few small files); else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


@dataclass
class scratch_table:  # noqa: N801
    """A table stored while a ``with`` block runs; what is made of it must be stored elsewhere before the end."""

    df: DataFrame
    name: str

    def __enter__(self) -> DataFrame:
        spark = self.df.sparkSession
        self._path = shared_path(spark, self.name)
        self.df.write.parquet(self._path)
        return spark.read.schema(self.df.schema).parquet(self._path)

    def __exit__(self, *_: object) -> None:
        remove_path(self.df.sparkSession, self._path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def remove(df: DataFrame) -> None:
    """Delete the table made by :func:`stored` that ``df`` reads and nothing else needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, folder)
