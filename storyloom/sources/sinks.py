"""Where results go: Parquet tables, partitions replaced as wholes, JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: list[tuple[DataFrame, str, list[str]]], folder: str) -> None:
    """Tables (rows, name, partition columns) in the order given, parents first; partitions that the rows touch are
    replaced, the others stay, so a repeated write changes nothing."""
    for df, name, by in tables:
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*by) if by else out).parquet(f"{folder}/{name}")


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, in column `value`, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_artifact(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def shared_folder(spark) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the session's checkpoint folder, else (in
    tests) one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder and read from there: for what several steps of a plan read."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
