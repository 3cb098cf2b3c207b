"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir.

    Only in local mode may that setting be missing; the session's warehouse then stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and Python, about, where the session sets no other bound.
BATCH_BYTES, BATCHES = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded: by Spark's own default, few long rows make batches of many megabytes."""
    conf = df.sparkSession.conf
    if BATCHES not in conf.getAll:
        conf.set(BATCHES, str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: work is done once and lost executors can't undo it."""
    bounded(df)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, function: Callable[..., Iterator[dict[str, Any]]], schema: str, *args: Any) -> DataFrame:
    """Apply function(batches, *args) to the Arrow batches of each partition.

    It yields dicts of columns (lists or arrays), one dict for each batch that goes out.
    """
    kinds = T.StructType.fromDDL(schema)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches, *args):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return bounded(df).mapInArrow(run, kinds)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}[kind.simpleString()]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about size bytes each; a longer text stands alone."""
    start = held = 0
    for row, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if held and held + (n or 0) > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [s or "" for s in batch.column(text).to_pylist()]


def partitions_for(df: DataFrame, column: Column, each: int, least: int = 1) -> int:
    """How many parts of about `each` units hold the sum of column: one aggregated row comes back."""
    total = df.agg(F.sum(column).alias("n")).first()["n"] or 0
    return int(max(least, -(-int(total) // each)))
