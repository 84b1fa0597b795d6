"""Token counts and token ids from public tokenizer files.

Both vocabularies used here treat words on their own, which gives safe boundaries:

* sentencepiece BPE with a white-space prefix: no piece holds the prefix sign after
  another character, so no merge crosses the place before a space;
* in the same model, no merge crosses two neighbouring characters that stand together in no piece, so a
  long chunk without spaces is cut between such;
* word-level BPE: white space is dropped and splits pre-tokens, so any space is one.

Texts are cut at those places, chunks not seen before are encoded in one batch, and
each Python worker remembers a bounded number of chunks. Results equal those of the
library on the whole text (tests compare them).
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import slices, worker_limits

#: Bytes of text that one batch of work holds.
BATCH_BYTES = 4 << 20
#: Chunks a worker remembers; on overflow it forgets all and starts anew.
MEMORY = 700_000
#: Longer chunks are encoded but not remembered.
LONG = 64
#: Characters of a chunk from which on it is cut between characters that no piece joins.
SPLIT = 1 << 16

_PIECES = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Token counts of a sentencepiece model without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.starts = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(self.model.get_piece_size())])
        self.known: dict[str, int] = {"": 1}  # what is left of one space at the end of a text
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.pairs = {pair for p in pieces for pair in zip(p, p[1:])}
        if any("\n" in pair for pair in self.pairs):
            raise ValueError("this model joins line ends with other characters")
        self.alone = self.whole("\n")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before each run of spaces that follows another character.

        The model puts a space before each input, so a chunk is given without its
        first space; only the first chunk of a text keeps all of its own.
        """
        parts = text.split(" ")
        if "" not in parts:
            return parts
        parts = _PIECES.findall(text)
        return parts[:1] + [p[1:] for p in parts[1:]]

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut, from every SPLIT characters on, at the first place that no piece crosses."""
        marked, out, start, at = chunk.replace(" ", "▁"), [], 0, SPLIT
        while at < len(chunk):
            while at < len(chunk) and (marked[at - 1], marked[at]) in self.pairs:
                at += 1
            out.append(chunk[start:at])
            start, at = at, at + SPLIT
        return [*out, chunk[start:]] if start < len(chunk) else out

    def of_long(self, chunk: str) -> int:
        """The count of a long chunk; parts after the first are encoded behind a line end, which joins nothing and whose own count is taken off."""
        first, *rest = self.parts(chunk)
        return self.whole(first) + sum(self.whole("\n" + p) - self.alone for p in rest)

    def batch(self, chunks: list[str]) -> list[int]:
        """Counts of many chunks: those without spaces are encoded as one text and told apart by the pieces that begin with the sign of a space."""
        plain = [c for c in chunks if " " not in c and len(c) <= SPLIT]
        out = {c: self.of_long(c) if len(c) > SPLIT else self.whole(c) for c in chunks if " " in c or len(c) > SPLIT}
        if plain:
            at = np.flatnonzero(self.starts[ids := np.array(self.model.encode(" ".join(plain), num_threads=1))])
            out.update(zip(plain, np.diff(at, append=len(ids)).tolist()))
        return [out[c] for c in chunks]

    def counts(self, texts: list[str]) -> list[int]:
        known, out = self.known, []
        cut = [self.chunks(t.replace("▁", " ")) for t in texts]  # the model knows a space by this sign
        new = list(dict.fromkeys(c for parts in cut for c in parts if c not in known))
        if len(known) + len(new) > MEMORY:
            known.clear()
            known[""] = 1
            new = list(dict.fromkeys(c for parts in cut for c in parts if c))
        late = {}
        for c, n in zip(new, self.batch(new)):
            (known if len(c) <= LONG else late)[c] = n
        for text, parts in zip(texts, cut):
            if not text:
                out.append(0)
            elif late:
                out.append(sum(late[c] if c in late else known[c] for c in parts))
            else:
                out.append(sum(map(known.__getitem__, parts)))
        return out


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows;
    an empty table gives none; other columns are not read. Only lengths leave Python.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, BATCH_BYTES):
                part = texts.slice(a, b - a).to_pylist()
                n = counter.counts([t or "" for t in part])
                size = [len(t.encode()) if t else 0 for t in part]
                yield pa.record_batch([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=1)
def byte_signs() -> dict[int, str]:
    """The sign that byte-level BPE uses for each byte: printable Latin-1 stays, the rest get signs from U+0100 on."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stays)]
    return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids, as little-endian unsigned 32-bit bytes, of a word-level BPE file.

    Words are remembered. A chunk between spaces that is one run of Latin-1 letters,
    with or without punctuation after it, goes straight to the BPE model; every other
    chunk takes the library's whole path.
    """

    _PLAIN = re.compile(r"([a-zªµºß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        worker_limits()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_word(self, word: str) -> bytes:
        """Ids of a run of letters, or of a run of punctuation."""
        found = self.known.get(word)
        if found is None:
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(byte_signs())
            found = self.known[word] = array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        return found

    def of_chunk(self, chunk: str) -> bytes:
        if len(chunk) > LONG:
            return self.pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        plain = self._PLAIN.fullmatch(chunk)
        if not plain or "<|" in chunk:
            found = self.pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        elif plain[2]:
            found = self.of_word(plain[1]) + self.of_word(plain[2])
        else:
            return self.of_word(chunk)
        self.known[chunk] = found
        return found

    def of_text(self, text: str) -> bytes:
        # Lower-casing first changes nothing for Latin-1 texts that hold no special token.
        if "<|" not in text and (text.isascii() or _latin(text)):
            text = text.lower()
        if len(self.known) > MEMORY:
            self.known.clear()
        get, of = self.known.get, self.of_chunk
        return b"".join([get(w) or of(w) for w in text.replace("\n", " ").split(" ") if w])


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
