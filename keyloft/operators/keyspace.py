"""Keys and strings: lookup, upsert, existence, deletion, enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_last(writes: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The last value written to each key; combined before the shuffle, so hot keys cost one row a task."""
    return writes.groupBy(F.col(key).alias("key")).agg(F.max_by(value, seq).alias("value"))


def get(strings: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key, ...) with the value of each key, null where it is missing."""
    return wanted.join(strings.select("key", "value"), "key", "left")


def lookup(relation: DataFrame, keys: list) -> DataFrame:
    """Rows of given keys; an equality filter that reaches the scan."""
    return relation.where(F.col("key").isin(*keys))


def exists(keyspace: DataFrame, requests: DataFrame) -> DataFrame:
    """req, found: how many of the keys that a request names exist; a repeated key counts each time."""
    live = keyspace.select(F.col("key").alias("live")).distinct()
    return requests.join(live, F.col("key") == F.col("live"), "left").groupBy("req").agg(F.count("live").alias("found"))


def check_type(keyspace: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key, type) rows whose key exists with that type."""
    return wanted.join(keyspace.select("key", "type"), ["key", "type"], "left_semi")


def delete(keyspace: DataFrame, requests: DataFrame) -> DataFrame:
    """The keyspace without the keys that any request names."""
    return keyspace.join(requests.select("key"), "key", "left_anti")


def delete_counts(keyspace: DataFrame, requests: DataFrame) -> DataFrame:
    """req, removed: requests run in the order of req, so a key counts for the first that names it, once."""
    first = requests.groupBy("key").agg(F.min("req").alias("first"))
    hit = first.join(keyspace.select("key").distinct(), "key", "left_semi").groupBy("first").agg(F.count("*").alias("n"))
    all_ = requests.select("req").distinct()
    return all_.join(hit, all_["req"] == hit["first"], "left").select("req", F.coalesce("n", F.lit(0)).alias("removed"))


def keys(keyspace: DataFrame, pattern: str) -> DataFrame:
    """All keys for the pattern `*`; no other pattern matches anything."""
    found = keyspace.select("key")
    return found if pattern == "*" else found.where(F.lit(False))


def size_of(*columns: str | Column) -> Column:
    """Bytes of the strings in the columns; nulls count nothing."""
    total = F.lit(0).cast("bigint")
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def memory_usage(relation: DataFrame, *columns: str) -> DataFrame:
    """keys, bytes: a portable estimate, the bytes of keys and contents."""
    return relation.agg(F.count_distinct("key").alias("keys"), F.sum(size_of(*columns)).alias("bytes"))
