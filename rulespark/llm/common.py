"""What the operators of this subpackage share: shared storage, batch mapping, text access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on one machine (tests) a temporary folder is made, and removed
    at exit; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = getattr(spark, "_rulespark_shared", None)
        if local is None:
            local = spark._rulespark_shared = tempfile.mkdtemp(prefix="rulespark-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its lineage ends there, and a lost executor costs a file read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`stored` that no later result reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()  # Spark deletes the shuffle files of plans that the driver's collector has found unused


def shipped(spark: SparkSession, path: str | None, default: Callable[[], str]) -> Callable[[], str]:
    """A function that gives, in any task, the path of a copy of the driver's file; without one, of the file that ``default`` finds there."""
    if path is None:
        return default
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def copy() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return copy


def map_batches(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterable[list[list]]], schema: T.StructType) -> DataFrame:
    """``fn`` gets an iterator of batches, each a list of columns of Python values, and yields batches of output columns."""
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """One output row, a tuple, for each input row; ``fn`` gets the row's values."""
    width = len(schema)

    def run(batches):
        for cols in batches:
            made = [fn(*row) for row in zip(*cols)]
            yield list(zip(*made)) if made else [[] for _ in range(width)]

    return map_batches(df, run, schema)


def filter_rows(df: DataFrame, keep: Callable[[object], bool], column: str) -> DataFrame:
    """The rows, as they are, whose value in the column ``keep`` accepts."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([keep(v) for v in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` alone, so that no further column of ``df`` can clash; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
