"""Small helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of a text: maximal runs of anything but blank and the control characters tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The rows in the shared folder of `spark.checkpoint.dir`, cut from their lineage.

    A local session without that setting (tests) gets a temporary folder of its own; on a cluster it is an error, since
    other machines could not read such a folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint(eager=True)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def small_batches(df: DataFrame) -> DataFrame:
    """Let Python workers get at most 1000 rows at a time, as texts are long; sets the session's Arrow option."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(option)) > 1000:
        conf.set(option, "1000")
    return df


def map_rows(
    df: DataFrame, columns: list[str], schema: str, rows_of: Callable[[Iterator[tuple]], Iterator[tuple]], batch: int = 2048
) -> DataFrame:
    """Hand the columns of each partition to `rows_of` as tuples; it yields tuples of the schema.

    Rows stream through in batches, and nulls stay null in every type.
    """
    fields = [part.split() for part in schema.split(", ")]
    out = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for one in batches:
            for at in range(0, one.num_rows, 1024):
                yield from zip(*[column.to_pylist() for column in one.slice(at, 1024).columns])

    def record(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*held), out.types)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows_of(source(batches)):
            held.append(row)
            if len(held) >= batch:
                yield record(held)
                held = []
        if held:
            yield record(held)

    return small_batches(df).select(*columns).mapInArrow(run, schema)


def crc_mod(column: str, divisor: int):
    """crc32 of the column as text, modulo the divisor, as a Column."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def mix64(values: np.ndarray) -> np.ndarray:
    """A fixed mixing of unsigned 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
