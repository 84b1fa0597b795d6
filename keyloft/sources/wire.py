"""The wire form of commands: arrays of byte strings with their lengths.

A connection is a stream of bytes that frames bring in any cuts. All commands of it run, in order; what a
frame leaves unfinished waits for the next. Bytes that are no command end what the frame brought, with one error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INCOMPLETE, COMPLETE, ERROR = "incomplete", "complete", "error"
ARRAY, STRING, LINE = b"*", b"$", b"\r\n"
_INTEGER, _SPACE = re.compile(rb"-?[0-9]{1,18}"), re.compile(rb"[ \t\n\v\f\r]*")


class Malformed(ValueError):
    """Bytes that begin no command, or a length that is no number or below what it may be."""


class Splitter:
    """Cuts a stream of bytes into commands, as far as it has come.

    It either waits for a line that says how much follows, or for the bytes of a word and the line end
    behind them; nothing is read twice, however the stream is cut.
    """

    def __init__(self):
        self.rest, self.words, self.open, self.size = b"", None, 0, None
        self.passed = self.taken = 0  # bytes before `rest`, and up to the end of the last whole command

    def feed(self, more: bytes) -> tuple[list[list[bytes]], bool]:
        """The commands that are complete now, and whether what follows them is malformed, which clears the stream."""
        self.rest, done, at = self.rest + more, [], 0
        try:
            while (end := self._line(at) if self.size is None else self._word(at)) is not None:
                at = end
                if self.size is None and len(self.words) == self.open:
                    done.append(self.words)
                    self.words, self.taken = None, self.passed + at
        except Malformed:
            self.__init__()
            return done, True
        self.rest, self.passed = self.rest[at:], self.passed + at
        return done, False

    def waits(self) -> bool:
        """Whether anything but white space has come of a command that is not complete."""
        return self.words is not None or bool(self.rest.strip())

    def _line(self, at: int) -> int | None:
        mark = ARRAY if self.words is None else STRING
        if mark == ARRAY:
            at = _SPACE.match(self.rest, at).end()
        if self.rest[at : at + 1] not in (mark, b""):
            raise Malformed
        end = self.rest.find(LINE, at)
        if end < 0:
            return None
        number = self.rest[at + 1 : end]
        if not _INTEGER.fullmatch(number) or int(number) < (0 if mark == ARRAY else -1):
            raise Malformed
        if mark == ARRAY:
            self.words, self.open = [], int(number)
        elif int(number) < 0:
            self.words.append(b"")  # a null string
        else:
            self.size = int(number)
        return end + len(LINE)

    def _word(self, at: int) -> int | None:
        end = at + self.size
        if end + len(LINE) > len(self.rest):
            return None
        if not self.rest.startswith(LINE, end):
            raise Malformed
        self.words.append(self.rest[at:end])
        self.size = None
        return end + len(LINE)


def parse_all(data: bytes) -> tuple[list[list[bytes]], str, int]:
    """Every command of a buffer, the status after the last, and how far it was read."""
    splitter = Splitter()
    done, broken = splitter.feed(data)
    if broken:
        return done, ERROR, len(data)
    return done, INCOMPLETE if splitter.waits() else COMPLETE, splitter.taken


def parse(data: bytes) -> tuple[str, list[bytes]]:
    """Status and words of the first command of a buffer."""
    done, status, _ = parse_all(data)
    return (COMPLETE, done[0]) if done else (ERROR if status == ERROR else INCOMPLETE, [])


def encode(words: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in words)


def parse_frames(frames: DataFrame, column: str = "frame", conn: str | None = None) -> DataFrame:
    """seq, cmd, status, words (array<binary>): a row for each command of frames (seq, frame binary or string).

    cmd counts the commands of a frame from 0. Malformed bytes give a row with the status error after the commands before
    them, an unfinished command one with incomplete; a null frame brings nothing. Without `conn` each frame
    is a connection of its own. With it, frames of an equal `conn` are one stream in the order of seq, and go through one task,
    which holds the bytes of one unfinished command.
    """
    kept = [F.col("seq").cast("bigint").alias("seq"), F.col(column).cast("binary").alias("frame"), (F.col(conn) if conn else F.lit(None)).cast("string").alias("conn")]
    rows = frames.select(*kept)
    if conn:
        rows = rows.repartition(F.col("conn")).sortWithinPartitions("conn", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last = Splitter(), None
        for batch in batches:
            out = []
            for seq, frame, of in zip(*(c.to_pylist() for c in batch.columns)):
                if not conn or of != last:
                    splitter, last = Splitter(), of
                done, broken = splitter.feed(frame or b"")
                out += [(seq, k, COMPLETE, words) for k, words in enumerate(done)]
                if broken or splitter.waits() or not done:
                    out.append((seq, len(done), ERROR if broken else INCOMPLETE, []))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary())]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 4, kinds)], names=["seq", "cmd", "status", "words"])

    return rows.mapInArrow(run, "seq bigint, cmd int, status string, words array<binary>")
