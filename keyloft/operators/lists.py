"""Ordered lists as rows (key, pos, value), positions from 0 without gaps; and a fold for logs.

Row operators rank within a key, so one key's list is one window partition. A list that lost all its
values has no rows, but its key stays: what asks about lists themselves takes their keys too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloft.functions import list_index, trim_bounds

MANY, WIDE = 512, 64


def _renumber(rows: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("key").orderBy(*order)
    return rows.select("key", (F.row_number().over(w).cast("bigint") - 1).alias("pos"), "value")


def push_back(writes: DataFrame, *order: str) -> DataFrame:
    """Lists made by appending values in an order."""
    return _renumber(writes, *[F.col(c) for c in order])


def push_front(writes: DataFrame, *order: str) -> DataFrame:
    """Lists made by putting values in front one after another: the last stands first."""
    return _renumber(writes, *[F.col(c).desc() for c in order])


def append(items: DataFrame, writes: DataFrame, *order: str) -> DataFrame:
    """Existing lists with further values at their ends."""
    old = items.select("key", "value", F.struct(F.lit(0).alias("part"), F.col("pos").alias("at")).alias("o"))
    w = Window.partitionBy("key").orderBy(*order)
    new = writes.select("key", "value", F.struct(F.lit(1).alias("part"), F.row_number().over(w).cast("bigint").alias("at")).alias("o"))
    return _renumber(old.unionByName(new), F.col("o"))


def prepend(items: DataFrame, writes: DataFrame, *order: str) -> DataFrame:
    """Existing lists with further values put in front one after another: the last stands first."""
    w = Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in order])
    new = writes.select("key", "value", F.struct(F.lit(0).alias("part"), F.row_number().over(w).cast("bigint").alias("at")).alias("o"))
    old = items.select("key", "value", F.struct(F.lit(1).alias("part"), F.col("pos").alias("at")).alias("o"))
    return _renumber(new.unionByName(old), F.col("o"))


def length(items: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """key, length; with the keys(key) of all lists, also 0 for those that were emptied."""
    found = items.groupBy("key").agg(F.count("*").alias("length"))
    if keys is None:
        return found
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("length", F.lit(0)).alias("length"))


def _sized(items: DataFrame) -> DataFrame:
    """Rows with n, the length of their list; lists made by a window over key are not shuffled again."""
    return items.withColumn("n", F.count("*").over(Window.partitionBy("key")))


def index(items: DataFrame, at: int) -> DataFrame:
    """key, value at a position, from the end if negative; lists too short for it have no row."""
    if at >= 0:
        return items.where(F.col("pos") == at).select("key", "value")
    return _sized(items).where(F.col("pos") == list_index(F.col("n"), F.lit(at))).select("key", "value")


def trim(items: DataFrame, start: int, stop: int) -> DataFrame:
    """The positions from start to stop, both included, counted from the end if negative; a list may become empty and then has no rows."""
    lo, hi = trim_bounds(F.col("n"), F.lit(start), F.lit(stop))
    return _sized(items).where((F.col("pos") >= lo) & (F.col("pos") <= hi)).select("key", (F.col("pos") - lo).cast("bigint").alias("pos"), "value")


def remove(items: DataFrame, count: int, value) -> DataFrame:
    """Without the first `count` rows of a value (the last if negative, all if 0)."""
    hit = F.coalesce(F.col("value") == F.lit(value), F.lit(False))
    if count == 0:
        kept = items.where(~hit)
    else:
        side = F.col("pos").asc() if count > 0 else F.col("pos").desc()
        rank = F.sum(hit.cast("int")).over(Window.partitionBy("key").orderBy(side).rowsBetween(Window.unboundedPreceding, 0))
        kept = items.withColumn("r", rank).where(~(hit & (F.col("r") <= abs(count)))).drop("r")
    return _renumber(kept, F.col("pos"))


def removed(items: DataFrame, count: int, value) -> DataFrame:
    """key, removed: how many rows `remove` takes from each list."""
    n = F.sum((F.col("value") == F.lit(value)).cast("int"))
    return items.groupBy("key").agg((F.least(n, F.lit(abs(count))) if count else n).cast("bigint").alias("removed"))


def insert(items: DataFrame, pivot, value, before: bool) -> DataFrame:
    """With a value beside the first pivot; lists without the pivot stay."""
    first = items.where(F.col("value") == F.lit(pivot)).groupBy("key").agg(F.min("pos").alias("p"))
    new = first.select("key", (F.col("p") * 2 + (-1 if before else 1)).alias("pos"), F.lit(value).alias("value"))
    return _renumber(items.select("key", (F.col("pos") * 2).alias("pos"), "value").unionByName(new), F.col("pos"))


def pop(items: DataFrame, front: bool) -> tuple[DataFrame, DataFrame]:
    """What is left, and the popped (key, value) of each list."""
    if front:
        return items.where("pos > 0").select("key", (F.col("pos") - 1).alias("pos"), "value"), items.where("pos = 0").select("key", "value")
    sized = _sized(items)
    return sized.where("pos < n - 1").select("key", "pos", "value"), sized.where("pos = n - 1").select("key", "value")


def encoding(items: DataFrame) -> DataFrame:
    """key, encoding: what a list that was pushed once would use, small or linked."""
    return items.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("value")).alias("w")).select("key", F.when((F.col("n") > MANY) | (F.col("w") > WIDE), "linked").otherwise("small").alias("encoding"))


class _List:
    """One list under a log of operations."""

    def __init__(self):
        self.values: deque = deque()

    def run(self, op: str, value, arg, a, b) -> None:
        x, n = self.values, len(self.values)
        if op == "RPUSH":
            x.append(value)
        elif op == "LPUSH":
            x.appendleft(value)
        elif op in ("LPOP", "RPOP"):
            if n:
                x.popleft() if op == "LPOP" else x.pop()
        elif op == "LTRIM":
            lo, hi = max(a + n if a < 0 else a, 0), min(b + n if b < 0 else b, n - 1)
            self.values = deque(islice(x, lo, hi + 1)) if lo <= hi else deque()
        elif op == "LREM":
            hits = [k for k, v in enumerate(x) if v == value]
            gone = set(hits[a:] if a < 0 else hits[:a] if a else hits)
            self.values = deque(v for k, v in enumerate(x) if k not in gone)
        elif op in ("LINSERT_BEFORE", "LINSERT_AFTER") and value in x:
            x.insert(x.index(value) + (op == "LINSERT_AFTER"), arg)


OPERATIONS = ["key", "op", "value", "arg", "a", "b"]


def _folded(log: DataFrame, ends, schema: str) -> DataFrame:
    """What `ends` gives, as columns, for a key and its list after the log. The log is dealt and sorted by key and gone through once: a task holds one list, not its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for key, *operation in zip(*(batch.column(c).to_pylist() for c in OPERATIONS)):
                if own is None or key != last:
                    if own is not None:
                        yield from ends(last, own.values)
                    last, own = key, _List()
                own.run(*operation)
        if own is not None:
            yield from ends(last, own.values)

    dealt = log.select(F.col("key").cast("string"), "seq", "op", F.col("value").cast("string"), F.col("arg").cast("string"), F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    return dealt.repartition(F.col("key")).sortWithinPartitions("key", "seq").mapInArrow(run, schema)


def fold(log: DataFrame) -> DataFrame:
    """list_items after a log (key, seq, op, value, arg, a, b) of one operation after another.

    ops: LPUSH and RPUSH value, LPOP, RPOP, LTRIM a b, LREM a value, and LINSERT_BEFORE
    and LINSERT_AFTER pivot value with the pivot in `value` and the new value in `arg`. Each result depends on
    the one before, which no window expresses, and arrays in an aggregate would be copied at each step: so it is one pass in Python over Arrow batches.
    """

    def ends(key, values) -> Iterator[pa.RecordBatch]:
        yield from (pa.record_batch([pa.array([key] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["key", "pos", "value"]) for at, part in _slices(values))

    return _folded(log, ends, "key string, pos bigint, value string")


def fold_lengths(log: DataFrame) -> DataFrame:
    """key, length of every list of a log (see fold): 0 for those that were emptied."""

    def ends(key, values) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([key], pa.string()), pa.array([len(values)], pa.int64())], names=["key", "length"])

    return _folded(log, ends, "key string, length bigint")


def _slices(values: deque, size: int = 10_000) -> Iterator[tuple[int, list]]:
    rest = iter(values)
    at = 0
    while part := list(islice(rest, size)):
        yield at, part
        at += len(part)
