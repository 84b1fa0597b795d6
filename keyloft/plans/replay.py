"""Replay of an ordered command log, without a sequential interpreter.

commands: seq, pos, op, key, field, value, error (null for a command that can run); a command with several keys has one row for each, pos counting them.
Strings are bytes: they may hold any, and are compared and measured as bytes.
Every key's history is cut into epochs by SET and DEL, and each reply is a window over
the key's rows: the shuffle is by key, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloft.functions import array_reply, command_name, encode_reply
from keyloft.sources.wire import ERROR, INCOMPLETE

WRONG_TYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
KNOWN = ("PING", "SET", "GET", "HSET", "HGET", "DEL", "EXISTS", "KEYS", "SAVE")
BY_KEY = ("SET", "GET", "HSET", "HGET", "DEL", "EXISTS")


#: Bits of a command's place in its frame, in a seq made of both: a frame of 2 GiB has fewer commands.
PLACE = 30


def frame_of(seq: Column) -> Column:
    """The frame of a seq that from_words made of a frame and a place in it."""
    return F.shiftright(seq, PLACE)


def place_of(seq: Column) -> Column:
    return (seq.bitwiseAND((1 << PLACE) - 1)).cast("int")


def from_words(frames: DataFrame) -> DataFrame:
    """Commands of frames (seq, words array<string> or array<binary>), with `error` set where a command cannot run.

    Names match in ASCII upper case. SET, HSET take their first key, field and value and
    ignore what follows; DEL and EXISTS give a row for each key. With columns cmd and status (wire.parse_frames),
    seq becomes that of frame and place (see frame_of), malformed bytes are protocol errors, and unfinished commands are left out.
    """
    if "status" in frames.columns:
        frames = frames.where(F.col("status") != INCOMPLETE).withColumn("broken", F.col("status") == ERROR)
    else:
        frames = frames.withColumn("broken", F.lit(False))
    if "cmd" in frames.columns:
        fits = F.col("seq").between(0, (1 << 63 - PLACE) - 1)
        seq = F.when(fits, F.shiftleft("seq", PLACE) + F.col("cmd")).otherwise(F.raise_error(F.concat(F.lit("no place for frame "), F.col("seq").cast("string"))).cast("bigint"))
        frames = frames.withColumn("seq", seq)
    frames = frames.select("seq", "broken", F.col("words").cast("array<string>").alias("words"))
    n, words = F.size("words"), F.col("words")
    name = command_name(F.get(words, F.lit(0)))
    arity = (
        F.when(name == "SET", n >= 3).when(name == "GET", n == 2).when(name == "HSET", (n >= 4) & (n % 2 == 0)).when(name == "HGET", n == 3)
        .when(name.isin("DEL", "EXISTS"), n >= 2).when(name == "KEYS", n == 2).when(name == "SAVE", n == 1).otherwise(True)
    )
    wrong = F.when(name == "SAVE", F.lit("SAVE command takes no arguments")).otherwise(F.concat(F.lit("wrong number of arguments for '"), name, F.lit("'")))
    error = F.when(F.col("broken"), F.lit("protocol error")).when(n <= 0, F.lit("empty command")).when(~name.isin(*KNOWN), F.concat(F.lit("unknown command `"), F.get(words, F.lit(0)), F.lit("`"))).when(~arity, wrong)
    many = F.when(name.isin("DEL", "EXISTS"), F.slice(words, 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.array(F.get(words, F.lit(1))))
    rows = frames.select("seq", name.alias("op"), error.alias("error"), F.posexplode_outer(many).alias("pos", "key"), F.get(words, F.lit(2)).alias("w2"), F.get(words, F.lit(3)).alias("w3"))
    value = F.when(F.col("op") == "SET", F.col("w2")).when(F.col("op") == "HSET", F.col("w3"))
    return rows.select("seq", F.coalesce("pos", F.lit(0)).alias("pos"), "op", "key", F.when(F.col("op").isin("HSET", "HGET"), F.col("w2")).alias("field"), value.alias("value"), "error")


def _history(commands: DataFrame) -> DataFrame:
    """Commands on keys with the state that each meets: epoch, reset (SET or DEL that began it), text, mapped, existed."""
    w = Window.partitionBy("key").orderBy("seq", "pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    op = F.col("op")
    resets = op.isin("SET", "DEL")
    rows = commands.where(op.isin(*BY_KEY)).withColumns({
        "epoch": F.sum(resets.cast("int")).over(upto),
        "reset": F.last(F.when(resets, op), ignorenulls=True).over(upto),
        "text": F.last(F.when(op == "SET", F.struct("value")), ignorenulls=True).over(upto)["value"],
        "existed": F.coalesce(F.last(F.when(op.isin("SET", "HSET", "DEL"), op), ignorenulls=True).over(before).isin("SET", "HSET"), F.lit(False)),
    })
    per_field = Window.partitionBy("key", "epoch", "field").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mapped", F.last(F.when(op == "HSET", F.struct("value")), ignorenulls=True).over(per_field)["value"])


def replies(commands: DataFrame) -> DataFrame:
    """seq, kind, str, int for every command but KEYS (see all_replies): one row each.

    Rows with an `error` (see from_words) answer with it and change nothing. Each key's history is gone through once; the parts of a
    command meet in one aggregate by seq.
    """
    if "error" not in commands.columns:
        commands = commands.withColumn("error", F.lit(None).cast("string"))
    op, failed = F.col("op"), F.col("error").isNotNull()
    string = F.coalesce(F.col("reset") == "SET", F.lit(False))
    keyed = _history(commands.where(~failed)).select(
        "seq",
        F.when(op == "SET", "simple").when(op.isin("DEL", "EXISTS"), "integer").when(op == "HSET", F.when(string, "error").otherwise("integer")).otherwise("bulk").alias("kind"),
        F.when(op == "SET", "OK").when((op == "HSET") & string, WRONG_TYPE).when((op == "GET") & string, F.col("text")).when((op == "HGET") & ~string, F.col("mapped")).alias("str"),
        F.when(op.isin("DEL", "EXISTS"), F.col("existed").cast("bigint")).when((op == "HSET") & ~string, 1).cast("bigint").alias("int"),
    )
    other = commands.where(failed | op.isin("PING", "SAVE")).select(
        "seq", F.when(failed, "error").otherwise("simple").alias("kind"), F.when(failed, F.col("error")).when(op == "PING", "PONG").otherwise("OK").alias("str"), F.lit(None).cast("bigint").alias("int")
    )
    return keyed.unionByName(other).groupBy("seq").agg(F.min("kind").alias("kind"), F.min("str").alias("str"), F.sum("int").alias("int"))


def key_arrays(commands: DataFrame) -> DataFrame:
    """seq, kind, str, int, items of every KEYS: an array of all live keys in byte order for `*`, an empty one for any other pattern; int is its length."""
    if "error" in commands.columns:
        commands = commands.where(F.col("error").isNull())
    asked = commands.where(F.col("op") == "KEYS").select("seq", F.col("key").alias("pattern"))
    found = keys_at(commands, asked.where("pattern = '*'").select(F.col("seq").alias("at"))).groupBy("at").agg(F.sort_array(F.collect_list("key")).alias("items"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return asked.join(found, F.col("seq") == F.col("at"), "left").select("seq", F.lit("array").alias("kind"), F.lit(None).cast("string").alias("str"), F.size(items).cast("bigint").alias("int"), items.alias("items"))


def all_replies(commands: DataFrame) -> DataFrame:
    """seq, kind, str, int, items for every command; items is null but for KEYS, whose answer is one array."""
    return replies(commands).withColumn("items", F.lit(None).cast("array<string>")).unionByName(key_arrays(commands))


def wire_replies(commands: DataFrame) -> DataFrame:
    """seq, reply (binary): the bytes that answer each command."""
    reply = F.when(F.col("kind") == "array", array_reply(F.col("items"))).otherwise(encode_reply(F.col("kind"), F.col("str"), F.col("int")))
    return all_replies(commands).select("seq", reply.cast("binary").alias("reply"))


def state(commands: DataFrame) -> DataFrame:
    """key, type (string or hash), field (null for strings), value: what the log leaves, each row of the last epoch of its key.

    Minima and maxima by time only, so hot keys are combined before the shuffle.
    """
    if "error" in commands.columns:
        commands = commands.where(F.col("error").isNull())
    op, at = F.col("op"), F.struct("seq", "pos")
    writes = commands.where(op.isin("SET", "DEL", "HSET")).select("key", "op", "field", "value", at.alias("at"))
    last = writes.where(op.isin("SET", "DEL")).groupBy("key").agg(F.max_by(F.struct("op", "value"), "at").alias("last"), F.max("at").alias("from"))
    strings = last.where("last.op = 'SET'").select("key", F.lit("string").alias("type"), F.lit(None).cast("string").alias("field"), F.col("last.value").alias("value"))
    fields = writes.where(op == "HSET").join(last, "key", "left").where(F.col("last").isNull() | ((F.col("last.op") == "DEL") & (F.col("at") > F.col("from"))))
    hashes = fields.groupBy("key", "field").agg(F.max_by("value", "at").alias("value")).select("key", F.lit("hash").alias("type"), "field", "value")
    return strings.unionByName(hashes)


def types(commands: DataFrame) -> DataFrame:
    """key, type of every live key."""
    return state(commands).select("key", "type").distinct()


def lifetimes(commands: DataFrame) -> DataFrame:
    """key, born, gone: the times between which each key exists; gone is null if it still does.

    A key is born by a SET or HSET that finds none, and goes with the next DEL.
    """
    w = Window.partitionBy("key").orderBy("seq", "pos")
    writes = commands.where(F.col("op").isin("SET", "DEL", "HSET")).select("key", "seq", "pos", (F.col("op") != "DEL").alias("alive"))
    change = writes.withColumn("was", F.coalesce(F.lag("alive").over(w), F.lit(False))).where(F.col("alive") != F.col("was"))
    return change.withColumn("gone", F.lead("seq").over(w)).where("alive").select("key", F.col("seq").alias("born"), "gone")


def keys_at(commands: DataFrame, times: DataFrame) -> DataFrame:
    """at, key: the keys that exist at each time, before a command of that seq.

    An interval join with an equality: a lifetime is cut into aligned cells whose widths are powers of
    two, at most two of each width, and a time lies in one cell of each width. So a
    lifetime costs twice the logarithm of its length, however long, and nothing is
    compared with everything. Times are not negative.
    """
    end = commands.agg(F.max("seq")).first()[0]
    if end is None:
        return commands.select(F.col("seq").alias("at"), "key").limit(0)
    widths = F.array(*[F.lit(w) for w in range(int(end + 2).bit_length() + 1)])
    late = times.where(F.col("at") > end).select(F.lit(end + 1).alias("t"), "at")
    asked = times.where(F.col("at") <= end).select(F.col("at").alias("t"), "at").union(late).distinct()

    def cells(w: Column) -> Column:
        lo = F.ceil((F.col("born") + 1) / F.pow(F.lit(2.0), w)).cast("bigint")
        hi = F.floor(F.coalesce(F.col("gone") + 1, F.lit(end + 2)) / F.pow(F.lit(2.0), w)).cast("bigint")
        some = lo < hi
        return F.array_compact(F.array(F.when(some & (lo % 2 == 1), F.struct(w.alias("w"), lo.alias("c"))), F.when(some & (hi % 2 == 1), F.struct(w.alias("w"), (hi - 1).alias("c")))))

    alive = lifetimes(commands).select("key", F.explode(F.flatten(F.transform(widths, cells))).alias("cell"))
    at = asked.select("at", F.explode(F.transform(widths, lambda w: F.struct(w.alias("w"), F.floor(F.col("t") / F.pow(F.lit(2.0), w)).cast("bigint").alias("c")))).alias("cell"))
    return alive.join(at, "cell").select("at", "key")


def exists_at(commands: DataFrame, wanted: DataFrame) -> DataFrame:
    """at, key, found for wanted(at, key): whether the key exists before a command of that seq; repeated wishes once.

    Wishes stand among the writes of their key, and each looks at the last write before it: one sort, nothing compared with all lifetimes.
    """
    writes = commands.where(F.col("op").isin("SET", "DEL", "HSET")).select("key", F.col("seq").alias("at"), "pos", (F.col("op") != "DEL").alias("alive"))
    asked = wanted.select("key", "at").distinct().select("key", "at", F.lit(-1).alias("pos"), F.lit(None).cast("boolean").alias("alive"))
    upto = Window.partitionBy("key").orderBy("at", "pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = writes.unionByName(asked).withColumn("found", F.coalesce(F.last("alive", ignorenulls=True).over(upto), F.lit(False)))
    return seen.where(F.col("alive").isNull()).select("at", "key", "found")
