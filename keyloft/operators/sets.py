"""Sets of members, and the replay of a log of set operations.

A set holds integers until it is promoted: by a member that is no integer, or by any
integer added while it has `limit` members. Until then members are known by value ("7",
"+7" and "007" are one), from then on by their text. Promotion is permanent, so each key
has one promotion time, and the whole replay is windows over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloft.functions import parse_int

LIMIT = 512


def canonical(members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """set_members of one-time adds (key, member): integer sets in canonical form, others raw.

    A set stays an integer set if all its members are integers and there are at most `limit`
    distinct ones.
    """
    number = parse_int(F.col("member"))
    kinds = members.groupBy("key").agg(F.bool_and(number.isNotNull()).alias("ints"), F.count_distinct(number).alias("n"))
    of = members.join(kinds.where((F.col("ints")) & (F.col("n") <= limit)).select("key", F.lit(True).alias("int_set")), "key", "left")
    return of.select("key", F.when(F.col("int_set"), number.cast("string")).otherwise(F.col("member")).alias("member")).distinct()


def phases(members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, ints: whether a set holds integers, as its members tell: all of them in canonical form, and at most `limit`."""
    number = parse_int(F.col("member"))
    same = F.coalesce(number.cast("string") == F.col("member"), F.lit(False))
    return members.groupBy("key").agg((F.bool_and(same) & (F.count_distinct("member") <= limit)).alias("ints"))


def _known(rows: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """rows(key, member, ...) with ints and id, the member as its set knows it; null where an integer set cannot hold it. A set without members holds integers."""
    p = phases(members, limit).withColumnRenamed("key", "p_key")
    ints = F.coalesce("ints", F.lit(True))
    id_ = F.when(ints, parse_int(F.col("member")).cast("string")).otherwise(F.col("member"))
    return rows.join(p, F.col("key") == F.col("p_key"), "left").withColumn("ints", ints).withColumn("id", id_).drop("p_key")


def add(members: DataFrame, new: DataFrame, limit: int = LIMIT) -> DataFrame:
    """set_members after one add for each row of new(key, member), in the order of its seq if it has one, else integers first.

    Integer sets know members by value, and are promoted as in `replay`: by a member that is no integer, or any integer added at
    `limit` members. Others take members as they are.
    """
    order = [F.col("seq")] if "seq" in new.columns else [parse_int(F.col("member")).isNull(), F.col("member")]
    at = F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint")
    known = _known(new.withColumn("at", at).select("key", "member", "at"), members, limit)
    texts = known.where(~F.col("ints")).select("key", "member")
    fresh = known.where("ints").select("key", "member", "at")
    touched = members.select("key", "member").distinct().join(fresh.select("key").distinct(), "key", "left_semi")
    log = touched.select("key", "member", F.lit(None).cast("bigint").alias("at")).unionByName(fresh)
    order = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first(), "member")
    log = log.select("key", "member", F.lit("ADD").alias("op"), F.row_number().over(order).cast("bigint").alias("seq"))
    rest = members.select("key", "member").join(fresh.select("key").distinct(), "key", "left_anti")
    return rest.union(texts).distinct().union(final_members(log, limit))


def remove(members: DataFrame, gone: DataFrame, limit: int = LIMIT) -> DataFrame:
    """set_members without gone(key, member): by value in integer sets, where what is no integer does nothing, by text in others."""
    ids = _known(gone.select("key", "member"), members, limit).where(F.col("id").isNotNull()).select("key", F.col("id").alias("member"))
    return members.join(ids, ["key", "member"], "left_anti")


def contains(members: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """wanted(key, member) with found, a boolean: by value in integer sets, by text in others."""
    mark = members.select(F.col("key").alias("m_key"), F.col("member").alias("m_id")).distinct()
    known = _known(wanted, members, limit)
    found = F.col("m_id").isNotNull()
    return known.join(mark, (F.col("key") == F.col("m_key")) & (F.col("id") == F.col("m_id")), "left").select(*[F.col(f"`{c}`") for c in wanted.columns], found.alias("found"))


def size(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count_distinct("member").alias("size"))


def memory_usage(members: DataFrame) -> DataFrame:
    """key, bytes: eight for each integer of an integer set, else the bytes of the members."""
    number = parse_int(F.col("member"))
    same = number.cast("string") == F.col("member")
    return members.groupBy("key").agg(F.when(F.bool_and(F.coalesce(same, F.lit(False))), 8 * F.count("*")).otherwise(F.sum(F.octet_length("member"))).cast("bigint").alias("bytes"))


#: Bits of a seq within its block: a key's log is dealt by blocks, and a block has at most 2 ** BLOCK seqs.
BLOCK = 14


def _block() -> Column:
    return F.shiftright(F.col("seq").cast("bigint"), BLOCK)


def _there(identity: str) -> Column:
    """Whether the member was in the set before the operation: whether the last add or remove of the same identity was an add.

    Rows without identity are told apart by blocks, so that they are not one window.
    """
    w = Window.partitionBy("key", identity, F.when(F.col(identity).isNull(), _block())).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(F.col("op") != "HAS", F.col("op")), ignorenulls=True).over(w) == "ADD", F.lit(False))


def _blocks(rows: DataFrame, found: Column) -> DataFrame:
    """b_key, b_block, found: an aggregate for each block of a key's log."""
    return rows.groupBy(F.col("key").alias("b_key"), F.col("block").alias("b_block")).agg(found.alias("found"))


def _with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with `found` of their block; null keys are one key, rows without a seq one block."""
    return rows.join(blocks, F.col("key").eqNullSafe(F.col("b_key")) & F.col("block").eqNullSafe(F.col("b_block"))).drop("b_key", "b_block")


def _promoted(log: DataFrame, limit: int) -> DataFrame:
    """The log with number and promoted, the seq of the operation that promotes its set (null if none does).

    The log is dealt by key once; every window here and in `replay` is over a key or a part of one, so none shuffles again.
    """
    op, number = F.col("op"), F.col("number")
    by_key = Window.partitionBy("key")
    rows = log.repartition(F.col("key")).withColumn("number", parse_int(F.col("member"))).withColumn("held", F.when(F.col("number").isNotNull(), _there("number")))
    change = F.when((op == "ADD") & ~F.col("held"), 1).when((op == "REM") & F.col("held"), -1).otherwise(0)
    rows = rows.withColumn("n", F.coalesce(F.sum(change).over(by_key.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    promotes = (op == "ADD") & (number.isNull() | (F.col("n") >= limit))
    return rows.withColumn("promoted", F.min(F.when(promotes, F.col("seq"))).over(by_key)).drop("held", "n")


def _promoted_by_blocks(log: DataFrame, limit: int) -> DataFrame:
    """As _promoted, for keys that hold much of the log.

    Windows over rows are over a key's identity or a block of its log, so the log of one key is dealt over all tasks;
    those over a key see one row for each block.
    """
    op, number = F.col("op"), F.col("number")
    of_key = Window.partitionBy("b_key")
    rows = log.withColumn("number", parse_int(F.col("member"))).withColumn("held", number.isNotNull() & _there("number"))
    change = F.when(number.isNull(), 0).when((op == "ADD") & ~F.col("held"), 1).when((op == "REM") & F.col("held"), -1).otherwise(0)
    rows = rows.select(*log.columns, "number", change.alias("change"), _block().alias("block"))
    sums = _blocks(rows, F.sum("change")).withColumn("found", F.coalesce(F.sum("found").over(of_key.orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("found") + F.coalesce(F.sum("change").over(within), F.lit(0))
    rows = _with_blocks(rows, sums).withColumn("n", n).drop("found")
    promotes = (op == "ADD") & (number.isNull() | (F.col("n") >= limit))
    firsts = _blocks(rows, F.min(F.when(promotes, F.col("seq")))).withColumn("found", F.min("found").over(of_key))
    return _with_blocks(rows, firsts).withColumnRenamed("found", "promoted").drop("block", "change", "n")


def promotions(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, promoted: the seq of the operation that promotes the set, for sets that any does."""
    return _promoted_by_blocks(log, limit).where(F.col("promoted").isNotNull()).select("key", "promoted").distinct()


def replay(log: DataFrame, limit: int = LIMIT, by_blocks: bool = False) -> DataFrame:
    """Replies of a log (key, seq, op in ADD, REM, HAS, member): seq, key, op, member, reply 0 or 1, and id, the member as the set knows it.

    At its promotion an integer set keeps its members in canonical text, so what was known
    by value before goes on under that text. Before it an operation on what is no integer does nothing.
    A log of many keys is dealt by key once. With `by_blocks` the log of each key is dealt over all tasks, in more shuffles: for keys that hold much of the log.
    """
    late = F.coalesce(F.col("seq") >= F.col("promoted"), F.lit(False))
    known = (_promoted_by_blocks if by_blocks else _promoted)(log, limit).withColumn("id", F.when(late, F.col("member")).otherwise(F.col("number").cast("string")))
    live = known.withColumn("there", _there("id") & F.col("id").isNotNull())
    reply = F.when(F.col("id").isNull(), 0).when(F.col("op") == "ADD", (~F.col("there")).cast("int")).otherwise(F.col("there").cast("int"))
    return live.select("seq", "key", "op", "member", "id", reply.cast("bigint").alias("reply"))


def final_members(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """set_members after the log."""
    last = replay(log, limit, by_blocks=True).where(F.col("id").isNotNull() & (F.col("op") != "HAS")).groupBy("key", "id").agg(F.max_by("op", "seq").alias("op"))
    return last.where(F.col("op") == "ADD").select("key", F.col("id").alias("member"))
