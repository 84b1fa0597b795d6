"""Best-two-fit packing of token sequences.

The plan depends on lengths only, and a length is at most the capacity. So the counts
of each length (at most `capacity` rows) are packed on the driver, as patterns with a
number of times; the rows are then ranked within their length, in salted parts, and
look their place up. Neither the plan nor the ranking gathers the rows of a length in
one task, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keyloft.llm.common import free_names, save, slices, widened
from keyloft.llm.tokens import BATCH_BYTES, word_ids

CAPACITY = 2048
END = (0).to_bytes(4, "little")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The token sequence of each document (its ids, then id 0), cut every `capacity` ids.

    One row for each piece: doc_id, piece (from 0), start, length, ids_crc32, and with
    `with_ids` also the ids as little-endian unsigned 32-bit numbers. A null text is empty and gives the
    single id 0; repeated rows give repeated pieces; an empty table gives none.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                out = []
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    ids = words.of_text(text or "") + END
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, largest first) and how many bins follow each.

    A bin is filled greedily with the longest lengths that fit. Then its smallest
    document goes while two unpacked ones fit the widened gap more tightly. The same
    choice holds as long as its lengths last, so it is made once for all those bins;
    each pattern uses up at least one length, or leaves less of it than a bin takes.
    """
    left = np.asarray(counts, dtype=np.int64).copy()
    plan = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        bin_, gap, free = [], capacity, left.copy()
        while len(fits := np.flatnonzero(free[: gap + 1])):
            size = int(fits[-1])
            k = int(min(free[size], gap // size))
            bin_ += [size] * k
            free[size] -= k
            gap -= k * size
        while gap and len(bin_) > 1:
            wide = gap + bin_[-1]
            pair = tightest_pair(free, wide)
            if pair is None or sum(pair) <= bin_[-1]:
                break
            free[bin_.pop()] += 1
            bin_ = sorted(bin_ + list(pair), reverse=True)
            for size in pair:
                free[size] -= 1
            gap = wide - sum(pair)
        taken = left - free
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left -= taken * times
        plan.append((bin_, times))


def tightest_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum of at most `room`; of equal sums that with the longest first."""
    first = np.flatnonzero(free[:room])
    if not len(first):
        return None
    below = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(min(room + 1, len(free))), -1))
    most = np.minimum(first, room - first)
    second = below[most]
    again = (second == first) & (free[first] < 2)
    second = np.where(again, below[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, -1)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return None if total[best] < 0 else (int(first[best]), int(second[best]))


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs: the ranks from `rank` on of a length stand at `offset` of the bins from `bin` on."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for sizes, times in plan:
        at = 0
        for size in sizes:
            rows.append((size, used.get(size, 0), first, at))
            used[size] = used.get(size, 0) + times
            at += size
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) | table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`.

    Pieces of equal length are interchangeable, so ties and repeated rows are placed in
    any order. `pieces` is read three times and should be a written table. The other
    columns stay, but those named sequence_id and offset. An empty table gives none.
    """
    pieces = free_names(pieces, "sequence_id", "offset")
    spark = pieces.sparkSession
    names = pieces.columns
    found = pieces.groupBy("length").agg(F.count("*").alias("__kl_n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in found:
        if r["length"] is None or not 1 <= r["length"] <= capacity:
            raise ValueError(f"a length of {r['length']} does not fit sequences of {capacity}")
        counts[r["length"]] = r["__kl_n"]
    runs = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity)))
    salts = max(1, int(counts.sum() ** 0.5))
    salted = pieces.withColumn("__kl_salt", F.pmod(F.xxhash64(*[c for c, kind in pieces.dtypes if not kind.startswith("map")]), F.lit(salts)))
    before = salted.groupBy("length", "__kl_salt").agg(F.count("*").alias("__kl_n"))
    order = Window.partitionBy("length").orderBy("__kl_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "__kl_salt", F.coalesce(F.sum("__kl_n").over(order), F.lit(0)).alias("__kl_before"))
    within = Window.partitionBy("length", "__kl_salt").orderBy("ids_crc32")
    ranked = salted.withColumn("__kl_rank", F.row_number().over(within).cast("long") - 1).join(before, ["length", "__kl_salt"])
    ranked = ranked.select(*names, (F.col("__kl_rank") + F.col("__kl_before")).alias("__kl_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        for batch in batches:
            rank, size = batch.column("__kl_rank").to_numpy(), batch.column("length").to_numpy()
            k = np.searchsorted(t["key"], (size << 44) | rank, side="right") - 1
            own = [batch.column(n) for n in names]
            yield pa.record_batch([*own, pa.array(t["bin"][k] + rank - t["rank"][k]), pa.array(t["offset"][k])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, widened(pieces.schema, sequence_id=LongType(), offset=LongType()))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each; see token_pieces and pack."""
    return pack(save(token_pieces(docs, path, capacity), "pieces"), capacity)
