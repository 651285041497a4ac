"""Helpers of the text operators: words, Arrow row maps, tables cut into the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netloom.operators.common import materialize

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder all executors share and read back: lineage ends here."""
    return materialize(df, name)


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch: whole texts are large, and a worker holds a batch and what is made of it.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` whose workers can import this package.

    They find it if it is installed or on PYTHONPATH, or if they start in its folder; else it is sent along once.
    """
    spark = df.sparkSession
    root = Path(__file__).resolve().parents[2]
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and not any(p and (Path(p) / "netloom").exists() for p in found):
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-netloom-"), "netloom"), "zip", root, "netloom")
        spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)
    if spark.conf.get(BATCH_BYTES) != str(BATCH):
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, inputs: dict[str, str], outputs: str,
             make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """``df`` plus the columns of ``outputs`` (a DDL list), computed row by row in Arrow batches.

    ``inputs`` maps argument names to columns.  ``make`` runs once per task and returns the row
    function, which takes the arguments and gives one tuple.  Columns of ``df`` that carry an output's
    name are replaced, all others pass through.  No shuffle; memory is one Arrow batch.
    """
    kinds = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(outputs)]

    def make_columns():
        fn = make()

        def columns(*args):
            rows = [fn(*r) for r in zip(*(a.to_pylist() for a in args))]
            return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

        return columns

    return map_columns(df, inputs, outputs, make_columns)


def map_columns(df: DataFrame, inputs: dict[str, str], outputs: str,
                make: Callable[[], Callable[..., list]]) -> DataFrame:
    """As ``map_rows``, but the function takes and gives Arrow arrays, for a few rows of a batch at a time."""
    added = T._parse_datatype_string(outputs)
    names, args = added.fieldNames(), list(inputs)
    rest = without(df, names)
    source = df.select(*[F.col(f"`{c}`") for c in rest.columns],
                       *[F.col(f"`{inputs[a]}`").alias(f"__arg_{i}") for i, a in enumerate(args)])
    passed = len(rest.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at, n in slices(batch, passed, len(args)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], *fn(*part.columns[passed:])],
                                                 names=[*part.schema.names[:passed], *names])

    return arrow_map(source, run, T.StructType([*rest.schema.fields, *added.fields]))


def slices(batch: pa.RecordBatch, first: int, n_args: int, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding some ``most`` bytes of arguments each (at least one row)."""
    size = sum(batch.column(first + i).nbytes for i in range(n_args))
    step = max(1, batch.num_rows * most // max(size, 1))
    return ((at, min(step, batch.num_rows - at)) for at in range(0, batch.num_rows, step))
