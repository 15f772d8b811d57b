"""Small facts kept beside a store as numbered Parquet folders; the last complete one counts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = folder_of(spark, path)
    return system.exists(folder)


def complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` below ``path`` whose writing was finished, ascending."""
    system, folder = folder_of(spark, path)
    if not system.exists(folder):
        return []
    found = (re.fullmatch(rf"{name}=(\d+)", status.getPath().getName()) for status in system.listStatus(folder))
    return sorted(int(m[1]) for m in found if m and exists(spark, f"{path}/{m[0]}/_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    system, folder = folder_of(spark, path)
    system.delete(folder, True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that a stream keeps over restarts and that another checkpoint does not share."""
    path = f"{checkpoint}/stream-name"
    if not exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).selectExpr(f"'s-{uuid.uuid4().hex}' AS name").write.mode("overwrite").parquet(path)
    return spark.read.schema("name string").parquet(path).first()["name"]


def write_version(rows: DataFrame, path: str, number: int) -> None:
    """Readers see it only when it is complete; a half-written one is written over."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")


def read_version(spark: SparkSession, path: str, schema: str) -> tuple[int, list]:
    """The last number, 0 if there is none, and its rows, which have to be few."""
    numbers = complete(spark, path, "version")
    if not numbers:
        return 0, []
    return numbers[-1], spark.read.schema(schema).parquet(f"{path}/version={numbers[-1]}").collect()
