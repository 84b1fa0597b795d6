"""Runs the events table as a command stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloft.plans import tables
from keyloft.streaming.replay import REPLIES, replies, whole_replies

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_log(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Replies of the command log, replayed from a file stream into Parquet under a shared folder."""
    return whole_replies(run_parts(spark, sf_dir, folder, "events.parquet", tables.commands_of))


def run_parts(spark: SparkSession, source: str, folder: str, files: str, commands) -> DataFrame:
    """Reply parts of all event files of a folder by now; a further call with the same `folder` goes on where the last one stopped, with the state it had."""
    batch = spark.read.option("pathGlobFilter", files).parquet(source)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = replies(commands(stream)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(REPLIES).parquet(f"{folder}/out")
