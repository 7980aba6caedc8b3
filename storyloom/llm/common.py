"""Shared plumbing of the corpus operators: reading tables, cutting lineage, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one below the warehouse where that is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that a lost executor costs no recomputation of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill_table(df: DataFrame) -> DataFrame:
    """Like `cut`, as compressed Parquet: for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[list]], Iterable[dict]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over blocks of at most `rows` rows.

    `fn` takes an iterator of blocks, each a list with one Python list per column, and yields dicts of columns.
    Blocks are small so that a worker holds few texts at a time whatever Spark's batch size is.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    yield [c.to_pylist() for c in part.columns]

        for cols in fn(blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
