"""Quality classifier on supervised subword embeddings.

Hashed words and hashed character n-grams of words (with signs for the begin and end of a word) have learned
vectors; a document is the mean of the vectors of its features, and a softmax layer gives the classes. Training is stochastic
gradient descent in numpy on a bounded sample. For scoring, the inner product of each vector
with the difference of the two output rows is taken once, so a word comes to an integer sum and a number of
features, which a worker remembers; integer sums make a score independent of batches and cuts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from keyloft.llm.common import crc_of_id, free_names, slices, widened
from keyloft.llm.labelled import PER_CLASS, sample

#: Lengths of the n-grams, in characters. These, WORD_WEIGHT and the feature of a repeated word were chosen by cross-validation inside the training rows (README).
GRAMS = (3, 4, 5)
#: Buckets of n-grams and of words; the last bucket is for a word that repeats the one before it.
GRAM_BITS, WORD_BITS = 16, 16
BUCKETS = (1 << GRAM_BITS) + (1 << WORD_BITS) + 1
REPEAT = BUCKETS - 1
DIM = 8
#: A word feature, and that of a repeated word, counts as often as this.
WORD_WEIGHT = 4
#: Longer texts are taken in pieces of about this many bytes, cut after white space; no feature crosses a cut but that of a repeated word, whose first half is carried over.
PIECE = 1 << 20
#: Characters of words that are hashed at once; a longer word is hashed in parts that overlap.
CHUNK = 1 << 18
#: Words a worker remembers, and the longest of them; on overflow it forgets all and starts anew.
MEMORY, LONG = 300_000, 64
SCALE = 1 << 12
#: Bits of the number of features of a word of at most LONG characters.
COUNT_BITS = 12
BEGIN, END = "\x02", "\x03"
_SPACE = re.compile(rb"[\x09-\x0d ]")


def pieces(text: bytes) -> list[bytes]:
    """The text cut after the first white space from each PIECE bytes on: no word is cut."""
    out, at = [], 0
    while len(text) - at > PIECE:
        found = _SPACE.search(text, at + PIECE)
        if not found:
            break
        out.append(text[at : found.end()])
        at = found.end()
    return [*out, text[at:]]


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return x >> np.uint32(32 - bits)


_PRIME = np.uint32(16777619)
_POWERS = np.cumprod(np.full(4096, _PRIME, np.uint32), dtype=np.uint32)


def grams(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the buckets of the n-grams that start at each place of an array of characters; the last n - 1 places have none."""
    rolled = np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            return
        rolled = rolled[: len(code) - n + 1] * _PRIME + code[n - 1 :]
        if n in GRAMS:
            yield n, _mix(rolled + np.uint32(n * 0x9E3779B), GRAM_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_bucket(word: str) -> int:
    """The bucket of a whole word."""
    total, code = 0, _codes(word)
    for at in range(0, len(code), CHUNK):
        part = code[at : at + CHUNK]
        total += int(((part + np.uint32(1)) * _POWERS[np.arange(at, at + len(part)) & 4095]).sum(dtype=np.uint32))
    return int(_mix(np.array([total & 0xFFFFFFFF], np.uint32), WORD_BITS)[0]) + (1 << GRAM_BITS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners (positions in `words`) of the features of words: their n-grams, and WORD_WEIGHT times the words themselves."""
    marked = "".join(BEGIN + w + END for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    code, owner = _codes(marked), np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(code))  # characters from here to the end of the word
    ids, of = [], []
    for n, buckets in grams(code):
        fits = left[: len(buckets)] >= n
        ids.append(buckets[fits].astype(np.int64))
        of.append(owner[: len(buckets)][fits])
    place = size[owner] - left - 1  # from 0 for the first character of the word itself
    inside = (place >= 0) & (left > 1)
    summed = np.add.reduceat(np.where(inside, (code + np.uint32(1)) * _POWERS[place & 4095], np.uint32(0)), ends - size, dtype=np.uint32) if len(words) else np.zeros(0, np.uint32)
    whole = _mix(summed, WORD_BITS).astype(np.int64) + (1 << GRAM_BITS)
    return np.concatenate([*ids, *[whole] * WORD_WEIGHT]), np.concatenate([*of, *[np.arange(len(words))] * WORD_WEIGHT])


def document_features(text: bytes) -> np.ndarray:
    """Buckets of all features of a document, repeats included."""
    words = text.decode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.int64)
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, owner = features(list(distinct))
    at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    many = np.bincount(at, minlength=len(distinct))
    again = int((at[1:] == at[:-1]).sum())
    return np.concatenate([np.repeat(ids, many[owner]), np.full(again * WORD_WEIGHT, REPEAT)])


@dataclass
class Model:
    """table: log-odds of each feature, times SCALE; bias: log-odds of a text without features."""

    table: np.ndarray
    bias: float
    known: dict[str, int] = field(default_factory=dict)  # sum and number of the features of a word, in one integer

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "known": {}}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        sums = [self.sums(t) for t in texts]
        mean = np.array([total / SCALE / max(n, 1) for total, n in sums])
        return 1 / (1 + np.exp(-np.clip(self.bias + mean, -30, 30)))

    def sums(self, text: bytes) -> tuple[int, int]:
        """The sum of the features' values and their number."""
        total = count = again = 0
        last = None
        for piece in pieces(text):
            words = piece.decode("utf-8", "replace").split()
            if not words:
                continue
            again += (last == words[0]) + sum(map(str.__eq__, words, words[1:]))
            last = words[-1]
            if max(map(len, words)) > LONG:
                for w, times in Counter(w for w in words if len(w) > LONG).items():
                    t, n = self.of_long(w)
                    total, count = total + t * times, count + n * times
                words = [w for w in words if len(w) <= LONG]
            known = self.values(words)
            found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            total, count = total + int((found >> COUNT_BITS).sum()), count + int((found & ((1 << COUNT_BITS) - 1)).sum())
        return total + again * WORD_WEIGHT * int(self.table[REPEAT]), count + again * WORD_WEIGHT

    def values(self, words: list[str]) -> dict[str, int]:
        """What is known of each word of at most LONG characters, at least of these."""
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(set(words))
        for at in range(0, len(new), CHUNK // LONG):
            some = new[at : at + CHUNK // LONG]
            ids, owner = features(some)
            total = np.bincount(owner, weights=self.table[ids], minlength=len(some)).astype(np.int64)
            known.update(zip(some, ((total << COUNT_BITS) | np.bincount(owner, minlength=len(some))).tolist()))
        return known

    def of_long(self, word: str) -> tuple[int, int]:
        """Sum and number of the features of a word of any length, in bounded memory."""
        marked, most = BEGIN + word + END, max(GRAMS) - 1
        total, count = WORD_WEIGHT * int(self.table[word_bucket(word)]), WORD_WEIGHT
        for at in range(0, len(marked), CHUNK):
            part = marked[at : at + CHUNK + most]
            for n, buckets in grams(_codes(part)):
                own = buckets[:CHUNK]
                total, count = total + int(self.table[own].sum(dtype=np.int64)), count + len(own)
        return total, count


def train(rows: list[tuple[bytes, int]], epochs: int = 8, rate: float = 0.4, seed: int = 1) -> Model:
    """Fits vectors and output rows by stochastic gradient descent, one document at a time.

    Classes weigh the same. Without rows of both classes the model knows only the bias,
    which is the smoothed share of label 1.
    """
    labels = np.array([y for _, y in rows], np.int64)
    n1 = int(labels.sum())
    if not 0 < n1 < len(labels):
        return Model(np.zeros(BUCKETS, np.int32), float(np.log((n1 + 1) / (len(labels) - n1 + 1))))
    docs = []
    for text, _ in rows:
        ids, n = np.unique(document_features(text), return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = np.array([len(labels) / 2 / (len(labels) - n1), len(labels) / 2 / n1], np.float32)
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in random.permutation(len(docs)):
            ids, share = docs[k]
            h = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= rate * (1 - step / steps) * min(4.0, weight[labels[k]])
            step += 1
            back = p @ out
            out -= np.outer(p, h)
            bias -= 0.1 * p
            if len(ids):
                # moves the mean by at most the gradient, however many features share it
                vectors[ids] -= np.outer(np.minimum(share * len(ids), 1.0), back)
    values = vectors @ (out[1] - out[0])
    return Model(np.clip(np.round(values * SCALE), -(2**31) + 1, 2**31 - 1).astype(np.int32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """A model of labels.quality, from labelled rows outside the held-out fold only; see labelled.sample for the bound."""
    return train(sample(docs, labels, "quality", folds, held_out, per_class))


def score(docs: DataFrame, model: Model, column: str, threshold: float | None = None, within: tuple = ()) -> DataFrame:
    """docs with `column`: the score of each whole text; null and empty texts get that of no features.

    With a threshold, only rows with at least that score stay and no column is added.
    Every column of docs is kept, but one that has the name of `column`. Repeated rows get equal scores; an empty table gives none.
    """
    if threshold is None:
        docs = free_names(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.binary())
            for a, b in slices(texts, PIECE):
                s = shared.value.scores([t or b"" for t in texts.slice(a, b - a).to_pylist()])
                part = batch.slice(a, b - a)
                if threshold is None:
                    yield pa.record_batch([*part.columns, pa.array(s)], names=[*names, column])
                else:
                    yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema if threshold is not None else widened(docs.schema, **{column: DoubleType()}))


def judged(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null doc_id is not held out, repeated rows stay."""
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, "score")
    held = F.coalesce(crc_of_id("doc_id") % folds == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
