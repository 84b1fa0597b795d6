"""Toxic passages by maximum-scoring segment search.

A token's score is its log-odds between toxic and clean text with Dirichlet priors: the
prior of a word is the estimate of its five-letter beginning, whose prior is that of the
four-letter one, whose prior is even. Counts are of distinct (word before, word) pairs, so copies of
a passage count once. A linear-time scan finds every maximal segment; extreme-value
statistics fitted on clean text turn a segment's score into its expected number in text
of that length, and segments that clean text would hardly have are significant. All of them are found, copies of
one another too; a document's probability follows from their sum, in which evidence that
stood in the document before adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from keyloft.llm.common import crc_of_id, free_names, slices, widened
from keyloft.llm.labelled import PER_CLASS, sample

# DRIFT, PRIOR and EXPECTED, and that repeated evidence counts once, were chosen by cross-validation inside the training rows (README).
#: Every token pays this, so that text without evidence scores below zero.
DRIFT = 0.8
#: Pseudo-counts of each level's prior.
PRIOR = 4.0
#: Segments expected less often than this in clean text of the same length are significant.
EXPECTED = 0.5
#: Scores of words a worker remembers; on overflow it forgets all and starts anew.
MEMORY = 300_000
BATCH_BYTES = 2 << 20
STEMS = (4, 5)

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score), in order, in time linear in the scores.

    Each positive score opens a candidate, known by the sums before and after it. It
    looks for the nearest earlier candidate that began lower, over links that pass those that did
    not; if that one ended lower too, the two join and look again.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    ends = total[positive].tolist()
    begins = (total[positive] - scores[positive]).tolist()
    low, high, start, stop, link = [], [], [], [], []
    for at, lo, hi in zip(positive.tolist(), begins, ends):
        first = at
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            first, lo = start[j], low[j]
            del low[j:], high[j:], start[j:], stop[j:], link[j:]
        low.append(lo)
        high.append(hi)
        start.append(first)
        stop.append(at + 1)
        link.append(j)
    return [(a, b, h - l) for a, b, l, h in zip(start, stop, low, high)]


@dataclass
class Odds:
    """Log-odds of words and of the beginnings of words, each with its prior taken in."""

    words: dict[str, float]
    stems: list[dict[str, float]]  # for each length of STEMS
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "known": {}}

    def of(self, word: str) -> float:
        """The score of a word: its own log-odds, or those of its longest known beginning, less the drift."""
        found = self.words.get(word)
        if found is None:
            found = 0.0
            for n, table in zip(reversed(STEMS), reversed(self.stems)):
                if word[:n] in table:
                    found = table[word[:n]]
                    break
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = found - DRIFT
        return found - DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each token."""
        try:
            return np.array([self.known[w] for w in words])
        except KeyError:
            get, of = self.known.get, self.of
            return np.array([s if (s := get(w)) is not None else of(w) for w in words])


def anew(words, scores: np.ndarray, found: list[tuple[int, int, float]]) -> list[float]:
    """The scores of the segments that are left of those found where a positive token counts only once after the same token, and never after itself."""
    seen, out = set(), []
    for a, b, _ in found:
        fresh = scores[a:b].copy()
        for k in np.flatnonzero(fresh > 0).tolist():
            at = a + k
            pair = (words[at - 1] if at else None, words[at])
            if pair in seen or pair[0] == pair[1]:
                fresh[k] = -DRIFT
            seen.add(pair)
        out += [s for _, _, s in segments(fresh)]
    return out


class Counts:
    """Tokenized texts as numbers of words, and the log-odds that any of them give to all words.

    One vocabulary serves the whole sample and its halves, so only arrays are held for each of them.
    """

    def __init__(self, texts):
        number: dict[str, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts]
        self.names = list(number)
        del number
        self.groups, self.stems = [], []
        for length in STEMS:
            ids: dict[str, int] = {}
            self.groups.append(np.fromiter((ids.setdefault(w[:length], len(ids)) for w in self.names), np.int32, len(self.names)))
            self.stems.append(list(ids))

    def _pairs(self, docs: list[int]) -> np.ndarray:
        """The distinct (word before, word) pairs of some documents, as one number each."""
        size = len(self.names) + 1
        parts = [(np.concatenate([[0], d[:-1].astype(np.int64) + 1])) * size + d for d in (self.docs[k] for k in docs) if len(d)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def log_odds(self, clean: list[int], toxic: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Log-odds of each word, those that it inherits, and those of the stems of each length; all zero without both classes."""
        many = len(self.names)
        if not many or not clean or not toxic:
            return np.zeros(many), np.zeros(many), [np.zeros(len(s)) for s in self.stems]
        pairs = [self._pairs(clean), self._pairs(toxic)]
        least = min(max(1, len(p)) for p in pairs)
        scale = [least / max(1, len(p)) for p in pairs]

        def contexts(group: np.ndarray, size: int) -> list[np.ndarray]:
            """Distinct contexts of each group in clean and toxic text, as if both had the same number of pairs."""
            out = []
            for p, factor in zip(pairs, scale):
                before, word = np.divmod(p, many + 1)
                k = np.unique(before * size + group[word]) % size
                out.append(np.bincount(k, minlength=size) * factor)
            return out

        prior, stems = np.full(many, 0.5), []
        for group, names in zip(self.groups, self.stems):
            above = np.zeros(len(names))
            above[group] = prior
            c, t = contexts(group.astype(np.int64), len(names))
            share = (t + PRIOR * above) / (c + t + PRIOR)
            stems.append(np.log(share / (1 - share)))
            prior = share[group]
        c, t = contexts(np.arange(many), many)
        share = (t + PRIOR * prior) / (c + t + PRIOR)
        return np.log(share / (1 - share)), np.log(prior / (1 - prior)), stems

    def odds(self, clean: list[int], toxic: list[int]) -> Odds:
        """The log-odds by word and stem; words near what they inherit are left out."""
        own, inherited, stems = self.log_odds(clean, toxic)
        keep = np.flatnonzero(np.abs(own - inherited) > 0.05)
        return Odds({self.names[k]: float(own[k]) for k in keep}, [dict(zip(names, x.tolist())) for names, x in zip(self.stems, stems)])


@dataclass
class Model:
    """odds of tokens; decay and rate of the extreme-value law; slope and shift of the probability."""

    odds: Odds
    decay: float
    rate: float
    slope: float
    shift: float

    def surprise(self, score: float, length: int) -> float:
        """Minus the log of how many segments of such a score clean text of a length would have."""
        return self.decay * score - float(np.log(self.rate * max(1, length)))

    def found(self, words: list[str]) -> tuple[list[tuple[int, int, float, float]], float]:
        """Every significant segment (first token, token after the last, score, surprise), and the sum of the surprise of what is new in them."""
        scores = self.odds.scores(words)
        return significant(self, words, scores)

    def probability(self, total: float) -> float:
        z = self.slope * np.log1p(total) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: str) -> float:
        return self.probability(self.found(tokens(text))[1])


def significant(model: Model, words, scores: np.ndarray) -> tuple[list[tuple[int, int, float, float]], float]:
    """What Model.found gives, from tokens in any form and their scores."""
    least, n = -np.log(EXPECTED), len(scores)
    out = [x for x in segments(scores) if model.surprise(x[2], n) >= least]
    fresh = [model.surprise(s, n) for s in anew(words, scores, out)]
    return [(a, b, s, model.surprise(s, n)) for a, b, s in out], sum(v for v in fresh if v >= least)


def decay_of(scores: np.ndarray) -> float:
    """The positive x with mean(exp(x * score)) = 1, by bisection; needs a negative mean and a positive score."""
    values, n = np.unique(np.round(scores, 3), return_counts=True)
    share = n / n.sum()

    def over(x: float) -> bool:
        return float(share @ np.exp(np.minimum(x * values, 700))) > 1

    lo, hi = 0.0, 1.0
    while not over(hi) and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if over(mid) else (mid, hi)
    return hi


def train(rows: list[tuple[bytes, int]]) -> Model:
    """Fits token scores on all rows; the statistics on scores that two half models give to the other half.

    Without rows of both classes nothing is significant and every text has the smoothed share of toxic rows.
    The law of clean text is that of its segments with repeated evidence left out, since it is one of independent tokens.
    """
    labels = np.array([y for _, y in rows], np.int64)
    n1 = int(labels.sum())
    if not 0 < n1 < len(labels):
        return Model(Odds({}, [{} for _ in STEMS]), 1.0, 1.0, 0.0, float(np.log((n1 + 0.1) / (len(labels) - n1 + 1))))
    counts = Counts(t.decode("utf-8", "replace") for t, _ in rows)
    clean, toxic = np.flatnonzero(labels == 0).tolist(), np.flatnonzero(labels == 1).tolist()
    scored: list = [None] * len(rows)
    for half in (0, 1):
        own = counts.log_odds([k for k in clean if k % 2 == half], [k for k in toxic if k % 2 == half])[0] - DRIFT
        for k in range(1 - half, len(rows), 2):
            scored[k] = own[counts.docs[k]].astype(np.float32)
    background = np.concatenate([*(scored[k] for k in clean), [8.0]])  # one strong token, so that the law is defined
    decay = decay_of(background) if background.mean() < 0 else 1.0
    best = []
    for k in clean:
        if len(scored[k]):
            fresh = anew(counts.docs[k].tolist(), scored[k], segments(scored[k]))
            best.append(decay * max(fresh, default=0.0) - np.log(len(scored[k])))
    rate = float(np.exp(np.mean(best) - np.euler_gamma)) if best else 1.0
    model = Model(counts.odds(clean, toxic), decay, max(rate, 1e-6), 0.0, 0.0)
    x = [np.log1p(significant(model, d.tolist(), s)[1]) for d, s in zip(counts.docs, scored)]
    model.slope, model.shift = logistic(np.array(x), labels)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps; classes weigh the same, and a small penalty bounds the slope."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - ridge * b
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """A model of labels.toxic, from labelled rows outside the held-out fold only; see labelled.sample for the bound."""
    return train(sample(docs, labels, "toxic", folds, held_out, per_class))


def score(docs: DataFrame, model: Model, column: str, below: float | None = None, passages: bool = False) -> DataFrame:
    """docs with `column`: the toxicity of each whole text; null and empty texts have no segments.

    With `passages`, also `<column>_passages`: first token, token after the last, score
    and surprise of every significant segment, repeated ones too. With `below`, only rows with a smaller score
    stay and no column is added. Every column of docs is kept, but those that have the names of the new ones. Repeated rows get equal scores; an empty table gives none.
    """
    if below is None:
        docs = free_names(docs, column, *[f"{column}_passages"] * passages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    span = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("score", DoubleType()), StructField("surprise", DoubleType())]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(names.index("text"))
            for a, b in slices(texts, BATCH_BYTES):
                found = [model.found(tokens(t)) if t else ([], 0.0) for t in texts.slice(a, b - a).to_pylist()]
                s = np.array([model.probability(total) for _, total in found])
                part = batch.slice(a, b - a)
                if below is not None:
                    yield part.filter(pa.array(s < below))
                    continue
                more, title = [pa.array(s)], [column]
                if passages:
                    more.append(pa.array([[dict(zip(("start", "stop", "score", "surprise"), x)) for x in f] for f, _ in found], kind))
                    title.append(f"{column}_passages")
                yield pa.record_batch([*part.columns, *more], names=[*names, *title])

    schema = docs.schema
    if below is None:
        schema = widened(schema, **{column: DoubleType()}, **({f"{column}_passages": span} if passages else {}))
    return docs.mapInArrow(run, schema)


def judged(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null doc_id is not held out, repeated rows stay."""
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, "score")
    held = F.coalesce(crc_of_id("doc_id") % folds == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
