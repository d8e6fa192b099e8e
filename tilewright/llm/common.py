"""Helpers the corpus operators share: table access, bounded Python batches and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str | T.StructType) -> DataFrame:
    """Runs ``work`` over lists of column values, a few hundred rows at a time.

    ``work`` gets a dict of Python lists and returns one; the number of rows may
    change.  Memory is bounded by the rows at once, not by the Arrow batch.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                found = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                arrays = [pa.array(found[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a private one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder now and reads it from there on; it outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, but as a compressed table whose size the planner knows: it broadcasts one below its own threshold only."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
