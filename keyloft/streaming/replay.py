"""Replay of a command stream with per-key state.

Rows are dealt by key; the state of a key is its type, its text and its fields, in the state
store. Rows of a batch come in any order and are sorted by (seq, pos), so commands must not
be split over batches out of order. The replies equal those of keyloft.plans.replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloft.plans.replay import BY_KEY, WRONG_TYPE, key_arrays

REPLIES = "seq bigint, pos int, key string, op string, kind string, str string, int bigint"


OPS = ("SET", "HSET", "DEL", "GET", "HGET", "EXISTS")
SET, HSET, DEL, GET, HGET, EXISTS = range(len(OPS))
#: What KeyReplay gives of a command: string, whether its key held a text then, existed, whether it was there before, and what GET and HGET found.
PARTS = "seq bigint, pos int, key string, op int, string boolean, existed boolean, found string"
#: Rows of a frame that leaves.
FRAME = 1 << 15


class KeyReplay(StatefulProcessor):
    """State of one key: `head` (type, text), and `fields` for maps.

    A batch's rows of the key are sorted and answered as arrays: each by the last write before it. The state store is asked
    only for what older batches left, and told only what the batch leaves, once for each field.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "type string, text string")
        self.fields = handle.getMapState("fields", "field string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seq, pos, op, field, value = self._sorted(rows)
        kind, text = self.head.get() if self.head.exists() else (None, None)
        at = np.arange(len(seq))
        reset = np.maximum.accumulate(np.where((op == SET) | (op == DEL), at, -1))  # -1: the state that the batch met
        string = np.where(reset < 0, kind == "string", op[reset] == SET)
        wrote = np.concatenate([[-1], np.maximum.accumulate(np.where(op <= DEL, at, -1))[:-1]])
        existed = np.where(wrote < 0, kind is not None, op[wrote] != DEL)
        mapped = self._last_of_field(op, field, reset)
        asked = np.flatnonzero((op == HGET) & (reset < 0) & (mapped < 0)) if kind == "hash" else at[:0]
        known = {f: self.fields.getValue((f,))[0] if self.fields.containsKey((f,)) else None for f in dict.fromkeys(field[asked])}
        for a in range(0, len(seq), FRAME):
            cut = slice(a, a + FRAME)
            found = [None] * len(seq[cut])
            for n in (a + np.flatnonzero((op[cut] == GET) & string[cut])).tolist():
                found[n - a] = value[reset[n]] if reset[n] >= 0 else text
            for n in (a + np.flatnonzero((op[cut] == HGET) & ~string[cut])).tolist():
                found[n - a] = value[mapped[n]] if mapped[n] >= 0 else known.get(field[n]) if reset[n] < 0 else None
            yield pd.DataFrame({"seq": seq[cut], "pos": pos[cut], "key": pd.Series([key[0]] * len(found), dtype=object), "op": op[cut], "string": string[cut], "existed": existed[cut], "found": pd.Series(found, dtype=object)})
        self._leave(kind, op, field, value, int(reset[-1]))

    def _sorted(self, rows: Iterator[pd.DataFrame]) -> list[np.ndarray]:
        """seq, pos, op, field and value in the order of the log. Equal texts are held once."""
        held, columns = {}, [[], [], [], [], []]
        for frame in rows:
            for column, name, kind in zip(columns, ("seq", "pos", "op"), (np.int64, np.int32, np.int8)):
                column.append(frame[name].to_numpy(kind))
            for column, name in zip(columns[3:], ("field", "value")):
                own = np.empty(len(frame), object)
                own[:] = [held.setdefault(x, x) if isinstance(x, str) else None for x in frame[name]]
                column.append(own)
        seq, pos, *rest = (np.concatenate(c) for c in columns)
        order = np.lexsort((pos, seq))
        return [c[order] for c in (seq, pos, *rest)]

    @staticmethod
    def _last_of_field(op: np.ndarray, field: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The last HSET of the same field since the same reset, up to each HGET or HSET; -1 where there is none."""
        out = np.full(len(op), -1)
        at = np.flatnonzero((op == HSET) | (op == HGET))
        code = pd.factorize(field[at], use_na_sentinel=False)[0]
        order = np.lexsort((at, code, reset[at]))
        at, code = at[order], code[order]
        start = np.ones(len(at), bool)
        start[1:] = (code[1:] != code[:-1]) | (reset[at[1:]] != reset[at[:-1]])
        place = np.arange(len(at))
        last = np.maximum.accumulate(np.where(op[at] == HSET, place, -1))
        none = last < np.maximum.accumulate(np.where(start, place, 0))
        out[at] = np.where(none, -1, at[last])
        return out

    def _leave(self, kind: str | None, op: np.ndarray, field: np.ndarray, value: np.ndarray, reset: int) -> None:
        if reset >= 0:
            if kind == "hash":
                self.fields.clear()
            if op[reset] == SET:
                self.head.update(("string", value[reset]))
                return
            if kind is not None:
                self.head.clear()
            kind = None
        last = {field[n]: value[n] for n in (reset + 1 + np.flatnonzero(op[reset + 1 :] == HSET)).tolist()} if kind != "string" else {}
        if last and kind is None:
            self.head.update(("hash", None))
        for f, v in last.items():
            self.fields.updateValue((f,), (v,))

    def close(self) -> None:
        pass


def replies(commands: DataFrame) -> DataFrame:
    """Reply parts of a command stream: one for each row on a key, from the state of the key; whole for all other commands.

    KEYS asks about every key, so its part is only the wish, which whole_replies answers. Malformed or
    unknown commands (with an `error`) answer with it.
    """
    error = F.col("error") if "error" in commands.columns else F.lit(None).cast("string")
    rows = commands.withColumn("error", error)
    op, failed = F.col("op"), F.col("error").isNotNull()
    code = F.create_map(*[F.lit(x) for pair in zip(OPS, range(len(OPS))) for x in pair])[op].cast("int")
    keyed = rows.where(~failed & op.isin(*BY_KEY)).select("seq", "pos", code.alias("op"), "key", "field", "value")
    parts = keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=KeyReplay(), outputStructType=PARTS, outputMode="Append", timeMode="None")
    string = F.col("string")
    parts = parts.select(
        "seq", "pos", "key", F.array(*map(F.lit, OPS))[F.col("op")].alias("op"),
        F.when(op == SET, "simple").when((op == HSET) & string, "error").when(op.isin(HSET, DEL, EXISTS), "integer").otherwise("bulk").alias("kind"),
        F.when(op == SET, "OK").when((op == HSET) & string, WRONG_TYPE).otherwise(F.col("found")).alias("str"),
        F.when(op.isin(DEL, EXISTS), F.col("existed").cast("bigint")).when((op == HSET) & ~string, 1).cast("bigint").alias("int"),
    )
    kind = F.when(failed, "error").when(op == "KEYS", "array").otherwise("simple")
    text = F.when(failed, F.col("error")).when(op == "PING", "PONG").when(op == "SAVE", "OK")
    other = rows.where(failed | op.isin("PING", "SAVE", "KEYS")).select(F.col("seq").cast("bigint"), F.col("pos").cast("int"), "key", "op", kind.alias("kind"), text.alias("str"), F.lit(None).cast("bigint").alias("int"))
    return parts.unionByName(other)


def whole_replies(parts: DataFrame) -> DataFrame:
    """One reply for each command but KEYS, of the parts that a sink collected; idempotent in seq."""
    parts = parts.where("kind != 'array'").dropDuplicates(["seq", "pos"])
    return parts.groupBy("seq").agg(F.max("kind").alias("kind"), F.max("str").alias("str"), F.sum("int").alias("int"))


def key_replies(parts: DataFrame) -> DataFrame:
    """The replies to KEYS (see plans.replay.key_arrays), of the parts that a sink collected: the writes among them tell which keys lived."""
    parts = parts.dropDuplicates(["seq", "pos"])
    return key_arrays(parts.where("kind != 'error'"))  # a rejected write leaves a key as it was
