"""The driver's tables as typed relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_strings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


def command_log(spark, sf_dir) -> DataFrame:
    return commands_of(table(spark, sf_dir, "events"))


def commands_of(events: DataFrame) -> DataFrame:
    """events as commands on 40 keys with 3 fields; values do not grow with time."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "SET").when(kind == "error", "DEL").when(kind == "view", "HSET").when(kind == "click", "HGET").otherwise("GET")
    key, field = F.concat(F.lit("u"), F.col("user_id") % 40), F.concat(F.lit("f"), F.col("user_id") % 3)
    value = ((F.col("event_id") * 7919) % 1009).cast("string")
    rows = events.select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), op.alias("op"), key.alias("key"), field.alias("field"), value.alias("value"))
    return rows.select("seq", "pos", "op", "key", F.when(F.col("op").isin("HSET", "HGET"), F.col("field")).alias("field"), F.when(F.col("op").isin("SET", "HSET"), F.col("value")).alias("value"))


def multi_key_log(spark, sf_dir) -> DataFrame:
    """events as SET and HSET, and DEL and EXISTS of three keys of which the first and third are equal."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "SET").when(kind == "error", "DEL").when(kind == "view", "HSET").otherwise("EXISTS")
    k1, k2 = F.concat(F.lit("u"), F.col("user_id") % 40), F.concat(F.lit("u"), (F.col("user_id") * 7 + 1) % 40)
    keys = F.when(op.isin("DEL", "EXISTS"), F.array(k1, k2, k1)).otherwise(F.array(k1))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.posexplode(keys).alias("pos", "key"), F.col("user_id"), F.col("event_id"))
    return rows.select("seq", "pos", "op", "key", F.when(F.col("op") == "HSET", F.concat(F.lit("f"), F.col("user_id") % 3)).alias("field"), F.when(F.col("op").isin("SET", "HSET"), ((F.col("event_id") * 7919) % 1009).cast("string")).alias("value"))


def order_lists(spark, sf_dir) -> DataFrame:
    """Pushes of order priorities to a list for each customer, in the order of date and key."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("value"))


def set_log(spark, sf_dir) -> DataFrame:
    """events as adds, removals and tests of members that are mostly integers in several spellings."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "view", "purchase"), "ADD").when(kind == "error", "REM").otherwise("HAS")
    n = (F.col("event_id") * 31) % 17
    member = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("x"), n)).when(F.col("event_id") % 5 == 0, F.concat(F.lit("0"), n)).when(F.col("event_id") % 7 == 0, F.concat(F.lit("+"), n)).otherwise(n.cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("s"), F.col("user_id") % 50).alias("key"), op.alias("op"), member.alias("member"))


def part_scores(spark, sf_dir) -> DataFrame:
    """Prices of parts as writes to a scored set for each brand."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("seq"))


def mixed_log(events: DataFrame) -> DataFrame:
    """events as in commands_of, but some purchases are PING, SAVE, KEYS with one of two patterns, or a command that cannot run (column error)."""
    n, spare = F.col("seq") % 7, F.col("op") == "GET"
    op = F.when(spare & (n == 0), "KEYS").when(spare & (n == 1), "PING").when(spare & (n == 2), "SAVE").when(spare & (n == 3), "HSET").otherwise(F.col("op"))
    key = F.when(spare & (n == 0), F.when(F.col("seq") % 2 == 0, "*").otherwise("u*")).when(spare & (n < 3), None).otherwise(F.col("key"))
    error = F.when(spare & (n == 3), "wrong number of arguments for 'HSET'")
    return commands_of(events).select("seq", "pos", op.alias("op"), key.alias("key"), "field", "value", error.alias("error"))


def wide_set_log(spark, sf_dir) -> DataFrame:
    """events as operations on three sets, mostly adds of 700 integers in three spellings: they pass 512 members."""
    e, n = table(spark, sf_dir, "events"), (F.col("event_id") * 31) % 700
    op = F.when(F.col("event_id") % 10 == 3, "REM").when(F.col("event_id") % 10 == 6, "HAS").otherwise("ADD")
    member = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("0"), n)).when(F.col("event_id") % 7 == 0, F.concat(F.lit("+"), n)).otherwise(n.cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("key"), op.alias("op"), member.alias("member"))


def list_log(spark, sf_dir) -> DataFrame:
    """events as mixed operations on a list for each user."""
    k = F.col("event_id") % 11
    op = F.when(k < 4, "RPUSH").when(k < 5, "LPUSH").when(k == 5, "LTRIM").when(k == 6, "LPOP").when(k == 7, "RPOP").when(k == 8, "LREM").when(k == 9, "LINSERT_BEFORE").otherwise("LINSERT_AFTER")
    bounds = [F.when(k == 5, 1 - F.col("event_id") % 2).otherwise(F.col("event_id") % 5 - 2).alias("a"), F.when(k == 5, -1 - F.col("event_id") % 3).otherwise(0).cast("bigint").alias("b")]
    return table(spark, sf_dir, "events").select(F.concat(F.lit("l"), F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("v"), F.col("event_id") % 7).alias("value"), F.concat(F.lit("n"), F.col("event_id") % 5).alias("arg"), *bounds)
