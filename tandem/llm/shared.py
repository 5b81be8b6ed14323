"""Helpers of the training-data operators: shared folders, cut lineage, vocabularies."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    all runs in this process, as in local tests, a folder of this machine is chosen
    and set. What lies there stays until the folder's owner clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tandem-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written once to the shared folder: it survives lost executors and cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str | Column) -> Column:
    """The column as text; null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def local_text(path: str) -> str:
    """A vocabulary file's content, read where the query is built; it travels in a broadcast of its fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this holds, jobs hand Arrow at most `rows` rows at once: wide rows fill a batch's memory soon, in Spark and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def by_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes or one row, so that long texts don't add up in a worker."""
    rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all of the cluster's slots, where it is a plain scan in fewer than half as many parts, such as a file of one row group.

    Rows are dealt in turn, so that equal ones don't meet. A plan that shuffles already has the parts that Spark gave it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or 2 * df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)


def arrow_columns(df: DataFrame, value: str | Column, keep: tuple[str, ...], extra: list[T.StructField], start: Callable, fixed: str | bytes) -> DataFrame:
    """The columns `keep` of `df` and columns made from `value` in one Arrow pass.

    In a task, ``start(fixed)`` gives the function that makes the new columns of
    a list of values. `fixed` is text whose size doesn't depend on the data, such
    as a vocabulary. Only `keep` and `value` reach the workers. A null text is
    the empty text.
    """
    value = text_of(value) if isinstance(value, str) else value
    shared = df.sparkSession.sparkContext.broadcast(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start(shared.value)
        for batch in batches:
            for part in by_bytes(batch):
                columns = part.columns[:-1] + make(part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType(kept.schema.fields + extra)
    names = schema.names
    return spread(df.select(*[F.col(f"`{c}`") for c in keep], value.alias("__value"))).mapInArrow(run, schema)
