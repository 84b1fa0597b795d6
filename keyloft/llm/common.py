"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: White space as the contracts name it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path already has it."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_keyloft_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="keyloft-")) / "keyloft.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "keyloft").rglob("*.py")):
            out.write(file, file.relative_to(root))
    sc.addPyFile(str(archive))  # served by the driver; executors keep their own copy
    sc._keyloft_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, or an own one where it is unset.

    An own folder is only right where driver and executors share one machine, so a
    session on a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keyloft-')}"
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    """The application's folder for saved tables, which goes when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/keyloft/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)

        def leave() -> None:
            with suppress(Exception):  # the session may be gone, and what is left is only disk
                if spark.sparkContext._jsc is not None:
                    _delete(spark, path)

        atexit.register(leave)
    return path


_folders: set[str] = set()
_scopes: list[list] = []


class Saved:
    """A table written to the shared folder, which cuts the lineage of what reads it.

    It goes at the end of the innermost `tidied` scope, or of the one around that with `outer`; without one, with the application.
    """

    def __init__(self, df: DataFrame, name: str, outer: bool = False):
        self.spark = df.sparkSession
        self.path = f"{_own_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        if len(_scopes) > outer:
            _scopes[-1 - outer].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read the table afterwards."""
        _delete(self.spark, self.path)


def save(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    return Saved(df, name, outer).df


@contextmanager
def tidied() -> Iterator[None]:
    """Tables saved within go at the end; a result that is read later must be saved as `outer`."""
    own: list[Saved] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.pop()
        for table in own:
            table.drop()


def crc_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(column: pa.Array, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold about `budget` bytes each.

    A longer row makes a range of its own.
    """
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield start, stop
        start = stop


def worker_limits() -> None:
    """One thread for each Python worker: Spark already runs one worker for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def free_names(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns, in any case of letters, whose names an operator gives to its results."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def widened(schema: StructType, **more: DataType) -> StructType:
    """A copy of the schema with further columns, named with their types."""
    return StructType([*schema.fields, *(StructField(k, v) for k, v in more.items())])
