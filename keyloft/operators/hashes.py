"""Field maps: key -> field -> value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.operators.keyspace import size_of

#: A map is large from this many fields on, or with a field or value over this many bytes.
MANY, WIDE = 512, 64


def from_rows(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """hash_fields: each row of a table as a map from column names to values, as strings; nulls are no fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.col(key).cast("string").alias("key"), F.inline(pairs)).where(F.col("value").isNotNull())


def hset(fields: DataFrame, writes: DataFrame) -> DataFrame:
    """The fields after writes(key, field, value, seq): the last write of a field wins over what was there."""
    both = fields.select("key", "field", "value", F.lit(None).cast("bigint").alias("seq")).unionByName(writes.select("key", "field", "value", F.col("seq").cast("bigint")))
    order = F.struct(F.col("seq").isNotNull().alias("new"), F.col("seq"))
    return both.groupBy("key", "field").agg(F.max_by("value", order).alias("value"))


def hget(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key, field, ...) with the value, null where the key or the field is missing."""
    return wanted.join(fields.select("key", "field", "value"), ["key", "field"], "left")


def hgetall(fields: DataFrame, keys: list) -> DataFrame:
    return fields.where(F.col("key").isin(*keys)).select("key", "field", "value")


def hlen(fields: DataFrame) -> DataFrame:
    return fields.groupBy("key").agg(F.count("*").alias("fields"))


def hexists(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key, field) with found, a boolean."""
    mark = fields.select("key", "field", F.lit(True).alias("m"))
    return wanted.join(mark, ["key", "field"], "left").select("key", "field", F.coalesce("m", F.lit(False)).alias("found"))


def hdel(fields: DataFrame, gone: DataFrame) -> DataFrame:
    return fields.join(gone.select("key", "field"), ["key", "field"], "left_anti")


def encoding(fields: DataFrame) -> DataFrame:
    """key, encoding: what a map that was filled once would use, small or table."""
    wide = F.greatest(F.octet_length("field"), F.octet_length("value"))
    return fields.groupBy("key").agg(F.count("*").alias("n"), F.max(wide).alias("w")).select("key", F.when((F.col("n") >= MANY) | (F.col("w") > WIDE), "table").otherwise("small").alias("encoding"))


def memory_usage(fields: DataFrame) -> DataFrame:
    return fields.groupBy("key").agg(F.sum(size_of("field", "value")).alias("bytes"))


def as_maps(fields: DataFrame) -> DataFrame:
    """Nested view: key, fields (map). Fields are unique by contract."""
    return fields.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
