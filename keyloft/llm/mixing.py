"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets are water-filled over the table of sources. Each source is dealt into
about the square root of its rows as shards; equal-token blocks are apportioned to
sources, and each source's blocks to its shards, by highest quotients. A shard puts its
documents in a seeded order and takes its quota from a seeded block on, going round.
No window covers more than the shards of a source, the rows of a shard, or a range of the sources, and none carries
a text: texts meet what is taken of them in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloft.llm.common import WORD, save

#: Words in a block.
BLOCK = 64
#: A document, and so a source, is repeated at most so often.
REPEATS = 3


def words(text: str = "text") -> Column:
    """The number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with __kl_no, the place of each row (from 0) in a total order, and for each name in `sums` the sum of a column over the rows before it.

    Rows are dealt by ranges of the order and numbered within them; only the ranges' totals, as many as there are partitions, meet in one task.
    """
    parted = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__kl_range", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("__kl_range").agg(F.count("*").alias("__kl_rows"), *[F.sum(c).alias(f"__kl_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__kl_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__kl_range", F.coalesce(F.sum("__kl_rows").over(before), F.lit(0)).alias("__kl_first"), *[F.coalesce(F.sum(f"__kl_t_{n}").over(before), F.lit(0)).alias(f"__kl_o_{n}") for n in sums])
    within = Window.partitionBy("__kl_range").orderBy(*order)
    own = within.rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(offsets), "__kl_range")  # a row for each partition
    added = {n: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__kl_o_{n}") for n, c in sums.items()}
    return out.withColumns({"__kl_no": F.row_number().over(within) - 1 + F.col("__kl_first"), **added}).select(*df.columns, "__kl_no", *sums)


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds __kl_seats: each group's `seats` (one number for its rows), dealt by highest quotients votes / (2 s + 1).

    Ties go to the smaller `party`. Rounding votes / divisor for a divisor that deals too few
    by up to half the parties, and one that deals too many, brackets the seats of every party,
    so only the quotients between are ranked: about as many as the parties. A group
    without votes deals nothing. Without `group` all rows are one, and are ranked by ranges.
    """
    w = Window.partitionBy(*group)
    if group:
        sized = parties.withColumns({"__kl_all": F.sum(votes).over(w), "__kl_m": F.count("*").over(w)})
    else:
        all_, m = parties.agg(F.sum(votes), F.count("*")).first()
        sized = parties.withColumns({"__kl_all": F.lit(all_), "__kl_m": F.lit(m)})

    def at(change: Column) -> Column:
        share = F.col(votes) / F.col("__kl_all") * F.greatest(F.col(seats) + change, F.lit(0))
        return F.when(F.col("__kl_all") > 0, F.floor(share + 0.5)).otherwise(0).cast("long")

    half = F.col("__kl_m") / 2
    # one seat to either side for what doubles may round away
    sized = sized.withColumns({"__kl_low": F.greatest(at(-half) - 1, F.lit(0)), "__kl_high": at(half) + 1})
    low = F.sum("__kl_low").over(w) if group else F.lit(sized.agg(F.sum("__kl_low")).first()[0])
    sized = sized.withColumn("__kl_open", F.col(seats) - low)
    quotient = F.col(votes) / (2 * F.col("__kl_s") - 1)
    tried = sized.where(F.col(votes) > 0).select(*group, *party, votes, "__kl_open", F.explode(F.sequence(F.col("__kl_low") + 1, F.col("__kl_high"))).alias("__kl_s")).withColumn("__kl_q", quotient)
    order = [F.col("__kl_q").desc(), *[F.col(p) for p in party]]
    ranked = tried.withColumn("__kl_no", F.row_number().over(w.orderBy(*order)) - 1) if group else running(tried, [*order, F.col("__kl_s")], {})
    won = ranked.where(F.col("__kl_no") < F.col("__kl_open")).groupBy(*group, *party).agg(F.count("*").alias("__kl_won"))
    out = sized.join(won, group + party, "left")
    return out.select(*parties.columns, (F.col("__kl_low") + F.coalesce("__kl_won", F.lit(0))).alias("__kl_seats"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = REPEATS) -> DataFrame:
    """Adds source_no (from 0, by code point, null last) and target to rows (source, source_size).

    The weights repeat along that order and share all sizes; a target stops at `most`
    times its source's size, and the excess is shared by weight among the rest, until
    none is above: the sources in order of cap over weight are capped as long as the level
    reached by sharing what is left exceeds their ratio.
    """
    key = F.array(*[F.lit(x) for x in weights])
    t = running(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], {}).withColumnRenamed("__kl_no", "source_no")
    t = t.withColumn("__kl_w", F.get(key, (F.col("source_no") % len(weights)).cast("int")).cast("double")).withColumn("__kl_cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("__kl_ratio", F.col("__kl_cap") / F.col("__kl_w"))
    total, weight = t.agg(F.sum("source_size").cast("double"), F.sum("__kl_w")).first()
    t = running(t, [F.col("__kl_ratio"), F.col("source_no")], {"__kl_before": "__kl_cap", "__kl_passed": "__kl_w"})
    level = (F.lit(total) - F.col("__kl_before")) / (F.lit(weight) - F.col("__kl_passed"))
    t = t.withColumn("__kl_level", level).withColumn("__kl_capped", F.col("__kl_ratio") <= F.col("__kl_level"))
    last = t.where(~F.col("__kl_capped")).agg(F.min(F.struct("__kl_ratio", "source_no", "__kl_level")).alias("last")).first()["last"]
    final = F.lit(last["__kl_level"] if last else None).cast("double")
    return t.select("source", "source_size", "source_no", F.when(F.col("__kl_capped"), F.col("__kl_cap")).otherwise(F.col("__kl_w") * final).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), *more), "sizes")


def _sources(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """The table of sources: source, source_size, source_no, target, __kl_shards."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__kl_rows"))
    sources = save(sources.select("source", "source_size", F.ceil(F.sqrt("__kl_rows")).alias("__kl_shards")), "sources")
    plan = targets(sources.select("source", "source_size"), weights, most)
    plan = plan.join(sources.select(F.col("source").alias("__kl_s2"), "__kl_shards"), F.col("source").eqNullSafe(F.col("__kl_s2"))).drop("__kl_s2")
    return save(plan, "targets")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 7, most: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, first, extra, again for each row of docs.

    taken = passes * size + extra + again: `extra` words from word `first` (from 0) on, and
    where the quota goes round the end of the shard, `again` words from word 0 on. A source's taken words differ from its target by about half a block. taken never exceeds
    `most` * size. Documents without words are never taken; a null text has none; a
    null source is a source of its own. Repeated rows are rows of their own, in any
    order among themselves. Sizes of zero throughout give targets of zero; an empty table gives none; other columns are not read.
    """
    return _placed(_sized(docs), weights, block, seed, most).select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "first", "extra", "again")


def _placed(rows: DataFrame, weights: tuple[int, ...], block: int, seed: int, most: int) -> DataFrame:
    """The columns of `mix` for rows (doc_id, source, size, ...), with __kl_shard and all further columns."""
    sources = _sources(rows, weights, most)
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    seats = sources.select("source_no", "target").withColumn("__kl_n", F.lit(int(total / block + 0.5)))
    quota = apportion(seats, [], ["source_no"], "target", "__kl_n").select("source_no", F.col("__kl_seats").alias("__kl_blocks"))
    plan = sources.join(quota, "source_no")

    s = plan.select(F.col("source").alias("__kl_source"), "source_no", "source_size", "target", "__kl_shards")
    dealt = rows.join(s, F.col("source").eqNullSafe(F.col("__kl_source"))).drop("__kl_source")
    draw = F.xxhash64("doc_id", "size", F.lit(seed))
    dealt = dealt.withColumn("__kl_draw", draw).withColumn("__kl_shard", F.pmod(F.xxhash64("__kl_draw", F.lit(1)), F.col("__kl_shards")).cast("long"))
    shards = dealt.select("source_no", "__kl_shard", "size").groupBy("source_no", "__kl_shard").agg(F.sum("size").alias("__kl_tokens"))
    shards = shards.join(plan.select("source_no", "__kl_blocks"), "source_no")
    got = apportion(shards, ["source_no"], ["__kl_shard"], "__kl_tokens", "__kl_blocks").select("source_no", "__kl_shard", "__kl_tokens", (F.col("__kl_seats") * block).alias("__kl_quota"))

    order = Window.partitionBy("source_no", "__kl_shard").orderBy("__kl_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__kl_at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(got, ["source_no", "__kl_shard"])
    tokens = F.col("__kl_tokens")
    full = F.least(F.col("__kl_quota"), tokens * most)
    passes = F.when(tokens > 0, F.floor(full / F.greatest(tokens, F.lit(1)))).otherwise(0).cast("long")
    placed = placed.withColumns({"__kl_full": full, "passes": F.when(F.col("size") > 0, passes).otherwise(0)})
    rest = F.when(tokens > 0, F.col("__kl_full") - passes * tokens).otherwise(0)
    blocks = F.ceil(tokens / block)
    begin = F.when(tokens > 0, F.pmod(F.xxhash64("source_no", "__kl_shard", F.lit(seed)), F.greatest(blocks, F.lit(1))) * block).otherwise(0)
    placed = placed.withColumns({"__kl_rest": rest, "__kl_begin": begin})

    def common(lo: Column, hi: Column) -> tuple[Column, Column]:
        a = F.greatest(F.col("__kl_at"), lo)
        return a - F.col("__kl_at"), F.greatest(F.least(F.col("__kl_at") + F.col("size"), hi) - a, F.lit(0))

    stop = F.col("__kl_begin") + F.col("__kl_rest")
    first, n = common(F.col("__kl_begin"), F.least(stop, tokens))
    _, again = common(F.lit(0), stop - tokens)
    placed = placed.withColumns({"extra": n.cast("long"), "again": again.cast("long"), "first": F.when(n > 0, first).otherwise(0).cast("long")})
    taken = (F.col("passes") * F.col("size") + F.col("extra") + F.col("again")).cast("long")
    return placed.withColumn("taken", taken)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 7, most: int = REPEATS) -> DataFrame:
    """The rows of the mix, with the columns of docs: each row as often as `mix` takes it.

    What is taken of a document only in part is a row with those words, joined by single spaces,
    as its text, and their number of characters as its n_chars, if docs has that column. Rows equal in all columns are
    counted by shard, so that each text is shuffled once, however often it stands in docs. Other cases are those of `mix`.
    """
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text" and not kind.startswith("map")]
    row = F.concat(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(":"), F.hex(F.xxhash64(*others)), F.lit(":"), F.hex(F.xxhash64(F.lit(seed), *others))).alias("__kl_row")
    taken = _placed(_sized(docs, row), weights, block, seed, most).where("taken > 0")
    takes = taken.groupBy("__kl_row", "__kl_shard", "size", "passes", "first", "extra", "again").agg(F.count("*").alias("__kl_n")).withColumnRenamed("__kl_row", "__kl_key")
    texts = docs.select(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__kl_all")).dropDuplicates(["__kl_row"])
    met = texts.join(takes, F.col("__kl_row") == F.col("__kl_key"))
    whole, parts = F.col("__kl_n") * F.col("passes"), [F.when(F.col(c) > 0, F.col("__kl_n")).otherwise(0) for c in ("extra", "again")]
    each = met.withColumn("__kl_copy", F.explode(F.sequence(F.lit(1).cast("long"), whole + parts[0] + parts[1])))
    text = F.col("__kl_all")["text"]
    of = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def part(first: Column, n: Column) -> Column:
        return F.when(n == F.col("size"), text).otherwise(F.array_join(F.slice(of, (first + 1).cast("int"), n.cast("int")), " "))

    own = F.when(F.col("__kl_copy") <= whole, text).when(F.col("__kl_copy") <= whole + parts[0], part(F.col("first"), F.col("extra"))).otherwise(part(F.lit(0), F.col("again")))
    rows = each.withColumn("__kl_text", own)
    changed = {"text": F.col("__kl_text"), "n_chars": F.when(F.col("__kl_text") == text, F.col("__kl_all")["n_chars"]).otherwise(F.length("__kl_text")) if "n_chars" in docs.columns else None}
    return rows.select(*[(changed[c] if c in changed else F.col("__kl_all")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
