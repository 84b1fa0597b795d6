"""A log from one snapshot to the next: what SAVE keeps, and what a start reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.plans import replay
from keyloft.sources import snapshot

STATE = "key string, type string, field string, value string"
#: Every row of a restored state comes before the log.
BEFORE = -1


def restored(state: DataFrame) -> DataFrame:
    """A state (see replay.state) as commands that make it, ahead of a log."""
    op = F.when(F.col("type") == "string", "SET").otherwise("HSET")
    return state.select(F.lit(BEFORE).cast("bigint").alias("seq"), F.lit(0).alias("pos"), op.alias("op"), "key", "field", "value", F.lit(None).cast("string").alias("error"))


def run(commands: DataFrame, path: str) -> DataFrame:
    """The replies to a log (as replay.all_replies) that starts from the snapshot under `path`, where there is one.

    The snapshot then holds the state before the last SAVE that can run. If it cannot be written, the old one stays, and every SAVE
    answers with an error.
    """
    if "error" not in commands.columns:
        commands = commands.withColumn("error", F.lit(None).cast("string"))
    old = restored(snapshot.load(commands.sparkSession, path, STATE))
    log = old.unionByName(commands.select(*old.columns))
    asked = (F.col("op") == "SAVE") & F.col("error").isNull()
    last, failed = commands.where(asked).agg(F.max("seq")).first()[0], False
    if last is not None:
        try:
            snapshot.save(replay.state(log.where(F.col("seq") < last)), path)
        except (Py4JJavaError, PySparkException, OSError):
            failed = True
    out = replay.all_replies(log).where(F.col("seq") > BEFORE)
    if not failed:
        return out
    saves = commands.where(asked).select(F.col("seq").alias("save"))
    wrong = F.col("save").isNotNull()
    marked = out.join(saves, F.col("seq") == F.col("save"), "left")
    return marked.select("seq", F.when(wrong, "error").otherwise(F.col("kind")).alias("kind"), F.when(wrong, "ERR Failed to save RDB").otherwise(F.col("str")).alias("str"), "int", "items")
