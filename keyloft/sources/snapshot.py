"""Snapshots of relations as Parquet.

A save writes a new version beside the old ones and then one empty pointer file whose name has a number and the
version, which no reader sees in part and no writer replaces. A load reads the version of the highest number. So a
save that fails or dies at any point leaves the old snapshot whole, also where a store cannot rename. A
missing snapshot is an empty one, a damaged one an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER, DIGITS = "_CURRENT", 18
#: Versions that stay, the current one included: a reader of the one before is not cut off.
KEPT = 2


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and version of each pointer, the newest first."""
    fs, folder = _path(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName().split(".") for f in fs.listStatus(folder)]
    return sorted(((int(n[1]), n[2]) for n in names if n[0] == POINTER and len(n) == 3), reverse=True)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the newest; of two that point at once, the later takes the next number."""
    while True:
        number = max((n for n, _ in _pointers(spark, path)), default=0) + 1
        fs, pointer = _path(spark, f"{path}/{POINTER}.{number:0{DIGITS}d}.{version}")
        fs.create(pointer, False).close()
        if [n for n, _ in _pointers(spark, path)].count(number) == 1:
            return
        fs.delete(pointer, False)


def save(df: DataFrame, path: str, partitions: list[str] | None = None) -> str:
    """Writes a version and points to it; gives the version's name. Versions older than the one before go."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{path}/{version}")
    _point(spark, path, version)
    for number, old in _pointers(spark, path)[KEPT:]:
        for name in (f"{POINTER}.{number:0{DIGITS}d}.{old}", old):
            fs, gone = _path(spark, f"{path}/{name}")
            fs.delete(gone, True)
    return version


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version, or no rows of the schema where nothing was saved."""
    found = _pointers(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    version = f"{path}/{found[0][1]}"
    fs, folder = _path(spark, version)
    if not fs.exists(folder):
        raise OSError(f"the snapshot of {path} points to {found[0][1]}, which is not there")
    return spark.read.schema(schema).parquet(version)
