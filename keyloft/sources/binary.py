"""The compact binary snapshot file, read and written as bytes.

Layout: header, a database mark with a number, pairs, an end mark, eight zero bytes. A
string pair is type 0, key, value; a map pair is type 2, key, number of fields, fields and values. Lengths
under 64 are one byte. Longer ones up to 16383 take two bytes, of which readers know only those
with bits 6 and 7 of the length clear; all others are refused here, since the bytes would
not read back. Parquet snapshots (snapshot.py) have no such limits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
HEADER = b"REDIS" + b"0009"
STRING, MAP, DATABASE, END = 0, 2, 0xFE, 0xFF
CHECKSUM = bytes(8)
#: Content of a written file, about.
FILE_BYTES = 64 << 20


class Damaged(ValueError):
    """The bytes are no snapshot of this format."""


def encode_length(n: int) -> bytes:
    if 0 <= n < 64:
        return bytes([n])
    if n < 16384 and not n & 0xC0:
        return bytes([0x40 | n & 0x3F, n >> 8])
    raise ValueError(f"a length of {n} cannot be read back from this format")


def encode_string(s: bytes) -> bytes:
    return encode_length(len(s)) + s


def encode(pairs: Iterable[tuple[bytes, bytes | dict[bytes, bytes]]]) -> bytes:
    """A snapshot of keys with strings or maps."""
    out = [HEADER, bytes([DATABASE]), encode_length(0)]
    for key, value in pairs:
        if isinstance(value, dict):
            out += [bytes([MAP]), encode_string(key), encode_length(len(value)), *(encode_string(x) for pair in value.items() for x in pair)]
        else:
            out += [bytes([STRING]), encode_string(key), encode_string(value)]
    return b"".join([*out, bytes([END]), CHECKSUM])


def decode(data: bytes) -> Iterator[tuple[bytes, bytes | dict[bytes, bytes]]]:
    """Keys with their values in file order; of a repeated key the first counts. Raises Damaged."""
    at = len(HEADER)
    if data[:at] != HEADER:
        raise Damaged("no snapshot header")

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Damaged("the file is cut")
        at += n
        return data[at - n : at]

    def length() -> int:
        b = take(1)[0]
        if b < 64:
            return b
        if b >> 6 != 1:
            raise Damaged("a length that this format does not have")
        return b & 0x3F | take(1)[0] << 8

    seen = set()
    while True:
        kind = take(1)[0]
        if kind == END:
            return
        if kind == DATABASE:
            length()
            continue
        if kind not in (STRING, MAP):
            raise Damaged(f"type {kind} is unknown")
        key = take(length())
        value = take(length()) if kind == STRING else {}
        if kind == MAP:
            for _ in range(length()):
                field = take(length())
                value[field] = take(length())
        if key not in seen:
            seen.add(key)
            yield key, value


class BinarySnapshot(DataSource):
    """spark.read.format("keysnapshot"): option `data` is the hexadecimal content of one snapshot. Files are read by read_files, in parallel."""

    @classmethod
    def name(cls) -> str:
        return "keysnapshot"

    def schema(self) -> str:
        return "key binary, type string, field binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(bytes.fromhex(self.options["data"]))


class _Reader(DataSourceReader):
    def __init__(self, data: bytes):
        self.data = data

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        yield from rows(self.data)


def rows(data: bytes) -> Iterator[tuple]:
    """key, type, field, value of a snapshot's content."""
    for key, value in decode(data):
        if isinstance(value, dict):
            for field, v in value.items():
                yield key, "hash", field, v
        else:
            yield key, "string", None, value


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinarySnapshot)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Many snapshot files at once through Spark's own reader, so any store it knows: key, type, field, value, file. A task holds one file at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1)):
                out = [(*r, p.as_py()) for r in rows(data.as_py())]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds)], names=["key", "type", "field", "value", "file"])

    return files.mapInArrow(run, "key binary, type string, field binary, value binary, file string")


def write_files(relation: DataFrame, path: str, size: int = FILE_BYTES) -> None:
    """Writes key, type (string or hash), field, value as snapshot files of about `size` bytes under a new folder, in parallel and through Spark's own writer, so to any store it knows.

    Keys are dealt by hash and stand in one file each. Lengths that would not read back are an error. An empty relation gives a folder without files.
    """
    parts = relation.select(F.col("key").cast("binary"), "type", F.col("field").cast("binary"), F.col("value").cast("binary"))
    parts = parts.repartition(F.col("key")).sortWithinPartitions("key", "field")

    def pairs(batches):
        """Each key with its value; the rows of a key stand together."""
        last, fields = None, {}
        for batch in batches:
            for key, kind, field, value in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and (kind != "hash" or key != last):
                    yield last, fields
                    last, fields = None, {}
                if kind == "hash":
                    last = key
                    fields[field] = value
                else:
                    yield key, value
        if last is not None:
            yield last, fields

    def run(batches):
        import pyarrow as pa

        held, total = [], 0
        for key, value in pairs(batches):
            held.append((key, value))
            total += len(key) + (sum(len(f) + len(v) for f, v in value.items()) if isinstance(value, dict) else len(value))
            if total >= size:
                yield pa.record_batch([pa.array([encode(held)[:-1]], pa.binary())], names=["content"])
                held, total = [], 0
        if held:
            yield pa.record_batch([pa.array([encode(held)[:-1]], pa.binary())], names=["content"])

    # the text writer ends a row with a separator: here the last byte of the format, and a file for each row
    content = parts.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    content.write.option("lineSep", chr(CHECKSUM[-1])).option("maxRecordsPerFile", 1).text(path)
