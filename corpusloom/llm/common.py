"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shipping import ready

#: Documents, and bytes of their texts, that a Python worker holds as Python objects at one time (one text at least).
SLICE, SLICE_BYTES = 256, 2 << 20

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: int, rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of the column ``text``; a longer text is one part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def map_documents(docs: DataFrame, rows: Callable[[list, list], dict], schema: str, text: str = "text") -> DataFrame:
    """One narrow stage: ``rows(doc_ids, texts)`` gives the columns of ``schema`` for a bounded slice of documents.

    Only doc_id and the text leave the scan, so other columns of ``docs`` (and clashing names among them) never matter.
    A null text reaches ``rows`` as an empty one.
    """
    fields = ready(docs.sparkSession).createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                columns = rows(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, keep: Callable[[list], list], text: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts (one truth value a text of a bounded slice), all columns as they came.

    Rows pass as Arrow slices, so nothing is joined back and only a slice's texts become Python objects.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([bool(x) for x in keep([t or "" for t in part.column(at).to_pylist()])]))

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    root = checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one under the warehouse if all runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder and read it back; lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if (made := _scratch.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stored` makes inside are deleted at the end; what is kept must be written elsewhere before."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in made:
            _delete(spark, folder)
