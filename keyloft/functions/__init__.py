"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def command_name(op: Column) -> Column:
    """ASCII upper-casing only: other letters stay as they are."""
    return F.translate(op, LOWER, UPPER)


def parse_int(member: Column) -> Column:
    """The integer that a whole string names (one optional sign, ASCII digits, 64 bits), else null."""
    return F.when(member.rlike(r"\A[+-]?[0-9]+\z"), member.try_cast("bigint"))


def list_index(size: Column, index: Column) -> Column:
    """A position from 0 for an index that may count from the end; null out of range."""
    at = F.when(index < 0, index + size).otherwise(index)
    return F.when((at >= 0) & (at < size), at)


def trim_bounds(size: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """First and last position that a trim keeps; the last is before the first where nothing stays."""
    lo = F.greatest(F.when(start < 0, start + size).otherwise(start), F.lit(0))
    hi = F.least(F.when(stop < 0, stop + size).otherwise(stop), size - 1)
    return lo, hi


def simple_reply(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def error_reply(text: Column) -> Column:
    return F.concat(F.lit("-ERR "), text, F.lit("\r\n"))


def integer_reply(number: Column) -> Column:
    return F.concat(F.lit(":"), number.cast("string"), F.lit("\r\n"))


def bulk_reply(text: Column) -> Column:
    """A string with its length in bytes; null is the null reply."""
    return F.when(text.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n")))


def array_reply(texts: Column) -> Column:
    return F.concat(F.lit("*"), F.size(texts).cast("string"), F.lit("\r\n"), F.array_join(F.transform(texts, bulk_reply), ""))


def encode_reply(kind: Column, text: Column, number: Column) -> Column:
    """The wire form of a reply row (kind simple, bulk, error or integer)."""
    return F.when(kind == "simple", simple_reply(text)).when(kind == "error", error_reply(text)).when(kind == "integer", integer_reply(number)).otherwise(bulk_reply(text))
