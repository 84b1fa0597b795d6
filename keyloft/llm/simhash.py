"""SimHash fingerprints and their near-duplicate join over binary tries.

Fingerprints are made distinct first, so copies meet as one row. Two fingerprints within the
error budget agree in some of any `budget` + r blocks of their bits, in r of them at least. So there is one trie for each choice of r
blocks, with those bits first: below its first levels, which have no errors to spend, a subtrie
goes to one task as it is, and no pair of subtries has to meet. The number of
tries depends on the budget and slowly on the number of fingerprints, so the rows that are shuffled grow with the
input. A task goes through the node pairs of all its subtries level by level, adds up differing
bits and drops pairs over the budget. A subtrie of more than `leaf` fingerprints is dealt into parts that meet in
pairs. A task gives a spanning forest of the links it finds, not the links themselves, so a
dense group costs as many rows as it has members.

Similarity of shingles, not bits, is asked for by `similar_documents`. Sets of a Jaccard similarity
have a shingle in common among their first ones in any one order of all shingles, so texts meet at those and
every pair of the similarity is found. Large groups of near copies are joined before that, by wider fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import Saved, save, tidied
from keyloft.llm.components import components, dealt_anew, spanning

BITS = 64
#: Fingerprints of a subtrie that one task takes whole.
LEAF = 4096
#: Node pairs that one step of a traversal handles at once, and rows that a task gathers from subtries before it goes through them.
FRONTIER, ROWS = 1 << 20, 1 << 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of `words` words, as an unsigned number; 0 without words.

    ASCII letters are lower-cased, words are runs of other than ASCII white space. Each
    shingle counts as often as it stands there; a bit is set if it is set in more than
    half of the hashes. Memory is bounded by the text and 64 KB of hashes at a time.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found))).tolist()
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :].tolist()
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, n, 8192):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + 8192)], last[at : at + 8192])])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def sketch(text: bytes | None, words: int, width: int, seed: int = 42) -> bytes:
    """SimHash of `width` times 64 bits over the distinct shingles of `words` words; zeros without words.

    The further words of 64 bits come from the shingles' hashes by a mixing function of their number.
    """
    return _sketched(shingles(text, words, seed), width)


def shingles(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of the distinct shingles of `words` words, sorted; none without words, the whole sequence of fewer words."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found))).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: max(1, len(found) - words + 1)], ends[min(words, len(found)) - 1 :].tolist())), np.uint64))


def _sketched(hashes: np.ndarray, width: int) -> bytes:
    total = np.zeros((width, BITS), np.int64)
    for at in range(0, len(hashes), 4096):
        for k in range(width):
            x = hashes[at : at + 4096] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            total[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(hashes)).tobytes()


class Tries:
    """The orders of bits in which fingerprints within `budget` bits of one another share the first bits of at least one.

    There are budget + r blocks of bits, and a trie for each choice of r of them, which come first. With
    `fingerprints` in all, r is the least that leaves a quarter of `leaf` of them to a subtrie on average.
    """

    def __init__(self, budget: int, fingerprints: int, leaf: int):
        for agree in range(1, BITS - budget + 1):
            blocks = budget + agree
            edges = [BITS * k // blocks for k in range(blocks + 1)]
            pieces = [(BITS - b, b - a) for a, b in zip(edges, edges[1:])]  # shift, width
            self.orders = [[*chosen, *(p for p in pieces if p not in chosen)] for chosen in combinations(pieces, agree)]
            self.bits = [sum(w for _, w in order[:agree]) for order in self.orders]
            if fingerprints <= leaf / 4 * 2.0 ** min(self.bits) or agree == 4:
                return

    def values(self, t: int, fps: np.ndarray) -> np.ndarray:
        """Unsigned fingerprints with their bits in the order of trie t."""
        out = np.zeros(len(fps), np.uint64)
        for shift, width in self.orders[t]:
            out = (out << np.uint64(width % BITS)) | ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)) if width < BITS else fps
        return out

    def subtries(self, t: int, values: np.ndarray) -> np.ndarray:
        """A number for the subtrie of each value: that of the trie and its first bits."""
        return (np.int64(t) << np.int64(40)) | _top(values, self.bits[t])


def _top(values: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of 64, at most 40 of them, as a number."""
    return (values >> np.uint64(BITS - min(bits, 40))).astype(np.int64)


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, depth: int = 0, roots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b) of fingerprints that differ in at most `budget` bits; both sorted and unsigned.

    A node pair is two ranges with the bits in which their prefixes differ. A step takes
    a stack of node pairs of one level to the next level: two children pairs keep the
    error, two add one, empty ones and those over budget go. Pairs of small nodes are
    compared outright. With `roots`, ranges of equal first `depth` bits, only pairs within a range are
    looked for; where a is b, each pair is given in one order at least, not in both.
    """
    if not len(a) or not len(b):
        return
    same = a is b
    first = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64) if roots is None else np.stack([*roots, *roots, np.zeros(roots.shape[1], np.int64)])
    stack = [(depth, first)]
    while stack:
        level, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(level, nodes[:, :half]), (level, nodes[:, half:])]
            continue
        area = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (area <= 4) if level < BITS else np.ones(len(area), bool)
        if small.any():
            yield from _compare(a, b, nodes[:, small], area[small], budget)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        a_mid, b_mid = _split(a, nodes[0], nodes[1], bit), _split(b, nodes[2], nodes[3], bit)
        (a0, a1, b0, b1, err), out = nodes, []
        mirrored = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        for lo, hi, b_lo, b_hi, more in ((a0, a_mid, b0, b_mid, 0), (a_mid, a1, b_mid, b1, 0), (a0, a_mid, b_mid, b1, 1), (a_mid, a1, b0, b_mid, 1)):
            keep = (lo < hi) & (b_lo < b_hi) & (err + more <= budget)
            if more and lo is a_mid:
                keep &= ~mirrored
            out.append(np.stack([lo[keep], hi[keep], b_lo[keep], b_hi[keep], err[keep] + more]))
        stack.append((level + 1, np.concatenate(out, axis=1)))


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range of the sorted x the given bit, the first that can differ, turns to one."""
    first = (x[lo] & ~(bit - np.uint64(1))) | bit  # the first value of the right child, if the range starts in the left one
    return np.where(x[lo] & bit, lo, np.minimum(np.searchsorted(x, first), hi))


def _compare(a, b, nodes, area, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lo, _, b_lo, b_hi, _ = nodes
    ends = np.cumsum(area)
    start = 0
    while start < len(area):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + 4 * FRONTIER, side="right")))
        n = area[start:stop]
        which = np.repeat(np.arange(start, stop), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (b_hi - b_lo)[which]
        i, j = lo[which] + within // width, b_lo[which] + within % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if near.any():
            yield i[near], j[near]
        start = stop


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest node of 0..n-1 that each node reaches over the links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def dealt(rows: DataFrame, by: Column, leaf: int, weight: Column | None = None) -> DataFrame:
    """Adds lo and hi to rows with a `slot`: those of a slot over `leaf` rows are dealt into parts by `by`, and each goes to every pair of parts that has its own.

    Rows that meet in a slot meet in some (slot, lo, hi). The counts are combined before the shuffle. A row counts as `weight` rows.
    """
    hot = save(rows.groupBy("slot").agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).where(F.col("n") > leaf).select(F.col("slot").alias("hot"), F.ceil(F.col("n") / leaf).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).otherwise(0)
    met = rows.join(hot, F.col("slot") == F.col("hot"), "left").withColumn("part", part)
    others = F.when(F.col("parts").isNotNull(), F.filter(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda q: q != F.col("part"))).otherwise(F.array(F.lit(0)))
    each = met.withColumn("with", F.explode(others))
    return each.select(*rows.columns, F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))


def subtrie_tables(batches: Iterator[pa.RecordBatch], rows: int = ROWS, keys: tuple[str, ...] = ("slot", "lo", "hi")) -> Iterator[pa.Table]:
    """The rows again, sorted by the keys, as tables of about `rows` rows that end where a group ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        k = [batch.column(c).to_numpy() for c in keys]
        last = np.flatnonzero(np.any([x != x[-1] for x in k], axis=0))
        if len(last):
            cut = int(last[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, size = [batch.slice(cut)], batch.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _ranges(*keys: np.ndarray) -> np.ndarray:
    """First and one past the last position of each run of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return np.stack([starts, np.append(starts[1:], len(change))])


def _self_pairs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the budget, of rows of one trie that are in the same subtrie, lo and hi."""
    order = np.lexsort((values, hi, lo))
    for a, b in _ranges(lo[order], hi[order]).T:  # one for all subtries that are whole, and one for each pair of parts of the others
        own = order[a:b]
        x = values[own]
        for i, j in trie_pairs(x, x, budget, depth, _ranges(x >> np.uint64(BITS - depth)) if depth else None):
            yield own[i], own[j]


def near_links(distinct: DataFrame, budget: int = 4, leaf: int | None = None) -> DataFrame:
    """u, v: links that join the fingerprints within `budget` bits into their groups; `distinct` has each fp once.

    The links are a spanning forest for each trie of a task: the groups that they make are those of all links.
    """
    leaf = leaf or LEAF
    tries = Tries(budget, distinct.count(), leaf)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for t in range(len(tries.orders)):
                yield pa.record_batch([pa.array(tries.subtries(t, tries.values(t, fps))), batch.column(0)], names=["slot", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches):
            slot, lo, hi, signed = (table.column(c).to_numpy() for c in ("slot", "lo", "hi", "fp"))
            for a, b in _ranges(slot >> 40).T:
                t, fps = int(slot[a] >> 40), signed[a:b].view(np.uint64)
                root = forest(b - a, _self_pairs(tries.values(t, fps), lo[a:b], hi[a:b], min(tries.bits[t], 40), budget))
                moved = np.flatnonzero(root != np.arange(b - a))
                if len(moved):
                    yield pa.record_batch([pa.array(fps[moved].view(np.int64)), pa.array(fps[root[moved]].view(np.int64))], names=["u", "v"])

    rows = dealt(distinct.select("fp").mapInArrow(spread, "slot long, fp long"), F.col("fp"), leaf)
    keys = ["slot", "lo", "hi"]
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, budget: int = 4, leaf: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row.

    Fingerprints link at `budget` or fewer differing bits; component_id is the smallest
    doc_id reachable. Null and empty texts have the fingerprint zero and link like any
    other; rows with a null doc_id link too but give no component_id, which is null only
    where a component has no doc_id at all; repeated rows are kept; other columns are
    not read; an empty table gives no rows.
    """
    with tidied():
        rows = save(fingerprints(docs, words, seed), "fingerprints", outer=True)
        distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(near_links(distinct, budget, leaf))
        grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
        of = save(grouped.select("fp", "root").join(least.select(dealt_anew("root"), "component_id"), "root").select("fp", "component_id"), "components", outer=True)
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- one document of each group ------------------------------------------------


def _identity() -> dict[str, Column]:
    """What tells rows apart: doc_id and the text; null texts are empty ones."""
    return {"__kl_id": F.col("doc_id").cast("long"), "__kl_text": F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))}


def first_of(groups: DataFrame) -> DataFrame:
    """__kl_key: the name of the row that stands for each group; groups: __kl_id, __kl_text, group for each row.

    The row with the smallest doc_id, one without a doc_id only if no row has any; of rows with that doc_id, the
    one whose text's MD5 is smallest.
    """
    first = F.min(F.struct(F.col("__kl_id").isNull().alias("nameless"), "__kl_id", "__kl_text")).alias("first")
    return groups.groupBy("group").agg(first).select(_row(F.col("first.__kl_id"), F.col("first.__kl_text")).alias("__kl_key"))


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that stand for their groups, by their names; see first_of.

    Rows of equal doc_id and text are copies, of which any one stays. Rows
    with one doc_id but texts in different groups are different documents. All columns are kept.
    """
    own = _identity()
    rows = docs.withColumn("__kl_row", _row(own["__kl_id"], own["__kl_text"]))
    return rows.join(kept, F.col("__kl_row") == F.col("__kl_key"), "left_semi").dropDuplicates(["__kl_row"]).drop("__kl_row")


def _row(doc_id: Column, digest: Column) -> Column:
    """One name for a doc_id, which may be null, and a text's digest: the texts are shuffled by it once."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)


def distinct_documents(docs: DataFrame, words: int = 4, seed: int = 42, budget: int = 4, leaf: int | None = None) -> DataFrame:
    """One row of docs for each group of fingerprints within `budget` bits of one another; see first_of.

    An empty table gives none.
    """
    rows = docs.select("doc_id", "text").withColumns(_identity())
    with tidied():
        fps = save(_with(rows, F.col("text"), lambda t: fingerprint(t, words, seed), pa.uint64(), "fp", "long"), "fingerprints")
        distinct = save(fps.select("fp").distinct(), "distinct")
        roots = components(near_links(distinct, budget, leaf)).withColumnRenamed("root", "top")
        groups = fps.join(roots, fps["fp"] == roots["node"], "left").select("__kl_id", "__kl_text", F.coalesce("top", "fp").alias("group"))
        kept = save(first_of(groups), "kept", outer=True)
    return one_of_each(docs, kept)


def _with(rows: DataFrame, text: Column, of, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    """__kl_id, __kl_text and `name`: what a function of the text's bytes gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([of(t.as_py()) for t in batch.column(2)], kind)
            yield pa.record_batch([batch.column(0), batch.column(1), found.view(pa.int64()) if kind == pa.uint64() else found], names=["__kl_id", "__kl_text", name])

    return rows.select("__kl_id", "__kl_text", text.cast("string").cast("binary").alias("t")).mapInArrow(run, f"__kl_id long, __kl_text string, {name} {sql}")


#: 64-bit words of a wide fingerprint at least, the recall that the number of tries is chosen for, and the error of an estimate, in standard deviations, from which a pair is sure.
WIDTH, RECALL, MARGIN = 8, 0.96, 3.0
#: Pairs that a task holds before it reduces them; texts up to this number are sought by a broadcast of their names.
HELD, FEW = 1 << 21, 100_000
#: Tries by which large groups are joined at first, and texts of a subtrie that the others are compared with.
STARS, CENTRES = 6, 8
#: One text of so many is in the sample by which shingles are ordered, of small tables more, and the frequent shingles kept of it. They bear on cost alone: any order gives the same pairs.
SAMPLE, FREQUENT = 10, 1 << 18
#: Near texts at a shingle over which they are a cell; of a cell about so many texts give its centre, and so many shingles of a difference from it count as a row.
CROWD, SAMPLED, HEAVY = 32, 64, 256
#: Pairs for each row at shared shingles, on average, over which texts are first compared with one of each shingle, another one in each of so many rounds.
CROWDED, ROUNDS = 2, 2


class Bands:
    """Tries for texts of a shingle similarity: each begins with some bits of a wide fingerprint, and the shares of bits that may differ.

    Sets of similarity s have a cosine of at least 2 s / (1 + s), and a bit differs with a chance of that angle over 180 degrees. With `texts` in all, the first
    bits are as many as leave a sixteenth of `leaf` texts to a subtrie, ten at least, and the
    tries as many as bring a pair of similarity s together with a chance of `recall`.
    """

    def __init__(self, similarity: float, texts: int, leaf: int, recall: float = RECALL):
        self.differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.first = min(32, max(10, math.ceil(math.log2(max(1, texts * 16 / leaf)))))
        self.tries = math.ceil(math.log(1 - recall) / math.log(1 - (1 - self.differ) ** self.first))
        self.width = max(WIDTH, math.ceil(self.tries * self.first / BITS))
        #: Differing bits up to which a pair is sure, and beyond which it is none; in between its shingles are compared.
        self.sure, self.budget = self.most(BITS * self.width, -MARGIN), self.most(BITS * self.width, MARGIN)
        #: Errors in the 64 bits that a trie is made of, its first bits having none.
        self.trie_budget = self.most(BITS - self.first, 3.5)

    def most(self, bits: int, deviations: float) -> int:
        return math.floor(bits * self.differ + deviations * math.sqrt(bits * self.differ * (1 - self.differ)))

    def values(self, t: int, sketches: np.ndarray) -> np.ndarray:
        """The 64 bits from the first of trie t on, going round the end."""
        word, shift = divmod(t * self.first, BITS)
        high, low = sketches[:, word % self.width], sketches[:, (word + 1) % self.width]
        return (high << np.uint64(shift)) | (low >> np.uint64(BITS - shift)) if shift else high


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary values of 8 * width bytes as rows of unsigned numbers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, width)


class Doubtful:
    """Pairs (i, j) with their differing bits, reduced to those of a minimum spanning forest over given groups."""

    def __init__(self):
        self.pairs, self.size = [], 0

    def add(self, root: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> None:
        self.pairs.append(np.stack([i, j, bits]))
        self.size += len(i)
        if self.size > HELD:
            self.pairs = [self.forest(root)]
            self.size = self.pairs[0].shape[1]

    def forest(self, root: np.ndarray) -> np.ndarray:
        """i, j and bits of the pairs that join the groups, the closest first."""
        i, j, bits = np.concatenate([np.zeros((3, 0), np.int64), *self.pairs], axis=1)
        own, out = root.copy(), []
        for d in np.unique(bits):
            at = np.flatnonzero(bits == d)
            out.append(at[spanning(own, i[at], j[at])])
        at = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
        return np.stack([i[at], j[at], bits[at]])


def star_links(distinct: DataFrame, bands: Bands) -> DataFrame:
    """u, v: links of wide fingerprints (node, sketch) that are surely similar, of each text with the first ones of its subtries.

    Their number grows with the texts, whatever the size of a group. What they leave apart is for `meetings`.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), bands.width)
            for t in range(min(STARS, bands.tries) if len(m) else 0):
                slot = (np.int64(t) << np.int64(40)) | _top(bands.values(t, m), bands.first)
                yield pa.record_batch([pa.array(slot), batch.column(0), batch.column(1)], names=["slot", "node", "sketch"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, keys=("slot",)):
            slot, node, m = table.column("slot").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("sketch"), bands.width)
            left = np.arange(len(slot))
            for _ in range(CENTRES):
                runs = _ranges(slot[left])
                centre = np.repeat(left[runs[0]], runs[1] - runs[0])
                sure = np.bitwise_count(m[left] ^ m[centre]).sum(axis=1, dtype=np.int64) <= bands.sure
                linked = sure & (left != centre)
                if linked.any():
                    yield pa.record_batch([pa.array(node[centre[linked]]), pa.array(node[left[linked]])], names=["u", "v"])
                left = left[~sure]
                if not len(left):
                    break

    rows = distinct.select("node", "sketch").mapInArrow(spread, "slot long, node long, sketch binary")
    return rows.repartition("slot").sortWithinPartitions("slot", "node").mapInArrow(link, "u long, v long")


# -- exact: texts that share one of their first shingles -------------------------


def frequent(rows: DataFrame, texts: int, words: int, seed: int) -> np.ndarray:
    """Shingles that many texts of a sample have, the most frequent last; rows: __kl_text, text."""
    every = max(1, min(SAMPLE, texts // 5000))
    chosen = rows.where(F.crc32(F.col("__kl_text").cast("binary")) % every == 0).groupBy("__kl_text").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.record_batch([pa.array(shingles(text.as_py(), words, seed).view(np.int64))], names=["h"])

    counts = chosen.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.col("n").desc(), "h").limit(FREQUENT).toArrow()
    return found.column("h").to_numpy().view(np.uint64)[::-1].copy()


def places(hashes: np.ndarray, common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers that stand for the shingles and give their order, sorted: frequent ones last, the others by hash. common: sorted, order: their places."""
    out = hashes >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = common[at] == hashes
        out[known] = np.uint64(1 << 63) | order[at[known]].astype(np.uint64)
    return np.sort(out)


def first_shingles(sizes, similarity: float):
    """How many of the first shingles of a set have one in common with any set of the similarity."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def shared(rows: DataFrame) -> DataFrame:
    """Those rows (token, node, top, n, pos, cell) whose token texts of other groups and cells have, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, keys=("token",)):
            top, cell, runs = table.column("top").to_numpy(), table.column("cell").to_numpy(), _ranges(table.column("token").to_numpy())
            apart = np.logical_and(*(np.minimum.reduceat(x, runs[0]) != np.maximum.reduceat(x, runs[0]) for x in (top, cell)))
            yield from table.filter(pa.array(np.repeat(apart, runs[1] - runs[0]))).combine_chunks().to_batches()

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, rows.schema)


def meetings(rows: DataFrame, similarity: float, stars: int = 0) -> DataFrame:
    """u, v, ru, rv: the pairs of nodes of different groups and cells that can have the similarity, by a token of both, their sizes and places; and their groups.

    Tokens are in order, so what comes after the first one in common bounds the rest. With `stars`, the number of a round, only pairs with one node of each token, the same for most tokens of a group.
    """
    part = similarity / (1 + similarity)

    def possible(n, pos, top, node, cell, i, j):
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (top[i] != top[j]) & (cell[i] != cell[j]) & (small >= similarity * large - 1e-6) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= part * (n[i] + n[j]) - 1e-6)
        i, j = i[ok], j[ok]
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return np.stack([node[i], node[j], top[i], top[j]])

    def once(held: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(held, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
        return x[:, new]

    def pairs(n, node, cell, runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if stars:
            draw = (node.astype(np.uint64) + np.uint64(stars)) * np.uint64(0x9E3779B97F4A7C15)  # no two nodes are equal
            draw = (draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            at = np.flatnonzero(draw == np.repeat(np.minimum.reduceat(draw, runs[0]), runs[1] - runs[0]))
            centre = np.repeat(at, runs[1] - runs[0])
            yield centre, np.arange(len(node))
            return
        run = np.repeat(np.arange(runs.shape[1]), runs[1] - runs[0])
        key = run.astype(np.float64) * 2.0**32 + n  # rows are sorted by size within a token
        last = run * 2.0**32 + np.minimum(n / similarity + 1e-6, 2.0**32 - 1)
        lone, within = np.flatnonzero(cell < 0), np.flatnonzero(cell >= 0)
        yield from windows(lone, lone, np.arange(len(lone)) + 1, np.searchsorted(key[lone], last[lone], side="right"))
        if len(within):  # all that are not in the token's largest cell, with those in any
            at = within[np.lexsort((cell[within], run[within]))]
            blocks = _ranges(run[at], cell[at])
            by = np.lexsort((blocks[0] - blocks[1], run[at[blocks[0]]]))
            of, first = np.unique(run[at[blocks[0][by]]], return_index=True)
            main = np.full(runs.shape[1], -1, np.int64)
            main[of] = cell[at[blocks[0][by][first]]]
            others = np.flatnonzero((cell != main[run]) & (main[run] >= 0))
            yield from windows(others, within, np.searchsorted(key[within], run[others] * 2.0**32 + n[others] * similarity - 1e-6), np.searchsorted(key[within], last[others], side="right"))

    def windows(one, two, start, stop) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each of `one` with those from start to stop in `two`, some at a time."""
        count = np.maximum(stop - start, 0)
        ends = np.cumsum(count)
        a = 0
        while a < len(one):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FRONTIER, side="right")))
            at = np.repeat(np.arange(a, b), count[a:b])
            yield one[at], two[start[at] + np.arange(len(at)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])]
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in subtrie_tables(batches, keys=("token",)):
            token, node, top, n, pos, cell = (table.column(c).to_numpy() for c in ("token", "node", "top", "n", "pos", "cell"))
            for i, j in pairs(n, node, cell, _ranges(token)):
                held.append(possible(n, pos, top, node, cell, i, j))
                size += held[-1].shape[1]
                if size > HELD // 2:
                    held = [once(held)]
                    size = held[0].shape[1]
                    if size > HELD // 4:
                        yield pa.record_batch([pa.array(c) for c in held[0]], names=["u", "v", "ru", "rv"])
                        held, size = [], 0
        if size:
            yield pa.record_batch([pa.array(c) for c in once(held)], names=["u", "v", "ru", "rv"])

    return rows.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(run, "u long, v long, ru long, rv long").dropDuplicates(["u", "v"])


def possible_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v, ...) whose first shingles leave room for the similarity; sets: node, n, prefix. None that has it goes."""
    part, names, schema = similarity / (1 + similarity), pairs.columns, pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "p1", "p2"))):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                last = min(x[-1], y[-1])  # up to there all tokens of both are known
                x, y = x[: np.searchsorted(x, last, side="right")], y[: np.searchsorted(y, last, side="right")]
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(both + min(n - len(x), m - len(y)) >= part * (n + m) - 1e-6)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k, c in ((1, "u"), (2, "v")))
    return pairs.join(one, "u").join(two, "v").select(*names, "n1", "n2", "p1", "p2").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """node, shingles: the hashes of the distinct shingles of each text (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                found = (text.as_py() or b"").lower().split()
                hashes = {xxhash.xxh64_intdigest(b" ".join(found[k : k + words]), seed) for k in range(max(1, len(found) - words + 1) if found else 0)}
                own = np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)
                yield pa.record_batch([pa.array([node.as_py()], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("string").cast("binary")).mapInArrow(run, "node long, shingles array<long>")


def crowds(rows: DataFrame, sketches: DataFrame, bands: Bands, similarity: float) -> DataFrame:
    """u, v: links of wide fingerprints (node, sketch) that can be near one text, of the first ones of a token with those of more than CROWD others near them.

    Two texts of the similarity to a third have one of 2 s - 1 at least. These links bear on cost alone.
    """
    loose, bits = math.acos((2 * similarity - 1) / similarity) / math.pi if similarity > 0.5 else 0.5, BITS * bands.width
    budget = bits * loose + MARGIN * math.sqrt(bits * loose * (1 - loose))

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, keys=("token",)):
            runs = _ranges(table.column("token").to_numpy())
            yield from table.select(["token", "node"]).filter(pa.array(np.repeat(runs[1] - runs[0] > CROWD, runs[1] - runs[0]))).combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, keys=("token",)):
            token, node, m = table.column("token").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("sketch"), bands.width)
            left = np.arange(len(token))
            for _ in range(CENTRES):
                runs = _ranges(token[left])
                size = runs[1] - runs[0]
                centre = np.repeat(left[runs[0]], size)
                near = np.bitwise_count(m[left] ^ m[centre]).sum(axis=1, dtype=np.int64) <= budget
                crowd = near & np.repeat(np.add.reduceat(near, runs[0], dtype=np.int64) > CROWD, size)
                if crowd.any():
                    u, v = np.unique(np.stack([node[left[crowd]], node[centre[crowd]]]), axis=1)
                    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                left = left[~near]
                if not len(left):
                    break

    found = save(rows.repartition("token").sortWithinPartitions("token").mapInArrow(many, "token long, node long"), "many")
    known = found.join(sketches.select("node", "sketch"), "node").select("token", "node", "sketch")
    return known.repartition("token").sortWithinPartitions("token", "node").mapInArrow(link, "u long, v long").distinct()


def linked_by_differences(top: np.ndarray, n: np.ndarray, differ: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of groups that join those of all similar pairs; of each text its group, size, and what its set and a centre, the same for all, do not share.

    Two sets differ by what is in one of these differences but not in both. So the texts near the centre are similar to the one nearest to it,
    and any other is compared with all texts by the shingles that its difference shares with theirs.
    """
    many = np.array([len(d) for d in differ], np.int64)
    owner = np.repeat(np.arange(len(differ)), many)
    token = np.unique(np.concatenate([np.zeros(0, np.uint64), *differ]), return_inverse=True)[1]
    own = np.split(token, np.cumsum(many)[:-1])
    by = np.argsort(token, kind="stable")
    holders, ends = owner[by], np.cumsum(np.bincount(token, minlength=1))
    alike, now = n - many, top.copy()  # half the sum of two of these, and the shingles that the differences share, are those that the sets share
    order = np.argsort((1 + similarity) * many - (1 - similarity) * n, kind="stable")
    for y in order:
        if y != order[0] and now[y] == now[order[0]]:
            continue
        both = np.bincount(np.concatenate([holders[:0], *(holders[ends[t - 1] if t else 0 : ends[t]] for t in own[y])]), minlength=len(n))
        common = (alike + alike[y]) // 2 + both
        near = common >= similarity * (n + n[y] - common)
        for other in np.unique(now[near & (now != now[y])]):
            yield int(other), int(now[y])
            now[now == other] = now[y]


def cell_links(cells: DataFrame, sets: DataFrame, similarity: float, leaf: int) -> DataFrame:
    """u, v: links of groups that join those of all similar pairs within a cell; cells: node, top, cell; sets: node, shingles.

    A cell's centre is what more than half of a sample of its texts have; it bears on cost alone. A text goes on as its difference
    from the centre, so what a task holds and does grows with the edits, not with the texts' lengths, and pairs do not leave it.
    """

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, 1, keys=("cell",)):
            cell = table.column("cell").to_numpy()
            for a, b in _ranges(cell).T:
                found, n = np.unique(table.column("shingles").slice(a, b - a).combine_chunks().flatten().to_numpy().view(np.uint64), return_counts=True)
                yield pa.record_batch([pa.array(cell[a : a + 1]), pa.array([found[2 * n > b - a].astype("<u8").tobytes()], pa.binary())], names=["centre_of", "centre"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array(x.values.to_numpy(), np.int64).view(np.uint64) for x in batch.column(3)]
            differ = [np.setxor1d(x, np.frombuffer(c.as_py() or b"", "<u8"), assume_unique=True) for x, c in zip(own, batch.column(4))]
            n, weight = pa.array([len(x) for x in own], pa.int64()), pa.array([1 + len(d) // HEAVY for d in differ], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), n, weight, pa.array([d.astype("<u8").tobytes() for d in differ], pa.binary())], names=["slot", "node", "top", "n", "weight", "differ"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in subtrie_tables(batches, 1):
            slot, lo, hi, top, n = (table.column(c).to_numpy() for c in ("slot", "lo", "hi", "top", "n"))
            for a, b in _ranges(slot, lo, hi).T:
                differ = [np.frombuffer(d, "<u8") for d in table.column("differ").slice(a, b - a).to_pylist()]
                found = [*linked_by_differences(top[a:b], n[a:b], differ, similarity)]
                if found:
                    yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    sizes = cells.groupBy("cell").agg(F.count("*").alias("many")).withColumnRenamed("cell", "cell_of")
    draw = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("many") / SAMPLED))) == 0
    sample = cells.join(sizes, F.col("cell") == F.col("cell_of")).where(draw).select("node", "cell").join(sets, "node").select("cell", "shingles")
    centres = save(sample.repartition("cell").sortWithinPartitions("cell").mapInArrow(centre, "centre_of long, centre binary"), "centres")
    small = (centres.agg(F.sum(F.length("centre"))).first()[0] or 0) <= HEAVY << 14
    known = cells.join(sets, "node").join(F.broadcast(centres) if small else centres, F.col("cell") == F.col("centre_of"), "left")
    rows = save(known.select("cell", "node", "top", "shingles", "centre").mapInArrow(differences, "slot long, node long, top long, n long, weight long, differ binary"), "differences")
    keys = ["slot", "lo", "hi"]
    return dealt(rows, F.col("node"), leaf, F.col("weight")).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "u long, v long")


def sets_of(wanted: DataFrame, docs: DataFrame, words: int, seed: int) -> DataFrame:
    """node, shingles of the texts named by wanted: node, __kl_key."""
    own = _identity()
    rows = docs.select("text", _row(own["__kl_id"], own["__kl_text"]).alias("__kl_row"))
    found = rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, F.col("__kl_row") == F.col("__kl_key")).dropDuplicates(["node"])
    return save(shingle_sets(found.select("node", "text"), words, seed), "sets")


def confirmed(doubtful: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """u, v of the pairs in doubt whose distinct shingles have the similarity; nodes: node, __kl_row of one text each."""
    ends = save(doubtful.select(F.explode(F.array("u", "v")).alias("end")).distinct(), "ends")
    wanted = save(nodes.join(ends, F.col("node") == F.col("end"), "left_semi").select("node", F.col("__kl_row").alias("__kl_key")), "wanted")
    sets = sets_of(wanted, docs, words, seed)
    both = doubtful.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("one")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("two")), "v")
    common = F.size(F.array_intersect("one", "two"))
    return both.where(common >= similarity * (F.size("one") + F.size("two") - common)).select("u", "v")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """One row of docs for each group of texts whose distinct shingles of `words` words have a similarity of `similarity` or more; see first_of.

    No pair of the similarity is left out: texts of different groups that share one of their first shingles are compared by all their shingles.
    Pairs whose estimate by wide fingerprints (512 bits at least) is MARGIN standard deviations above the threshold are not compared.
    Texts without words are equal. An empty table gives none.
    """
    bands = Bands(similarity, docs.count(), leaf)
    with tidied():
        return one_of_each(docs, save(first_of(_similar_groups(docs, bands, words, similarity, seed, leaf)), "kept", outer=True))


def _sets(rows: DataFrame, bands: Bands, words: int, similarity: float, seed: int, order: np.ndarray) -> DataFrame:
    """__kl_id, __kl_text and of the set of shingles: digest, n, sketch and prefix, its first ones."""
    width, by = bands.width, np.argsort(order)
    shared_order = rows.sparkSession.sparkContext.broadcast((order[by], by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places_of = shared_order.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(2):
                h = shingles(t.as_py(), words, seed)
                tokens = places(h, common, places_of)
                found = (hashlib.md5(h.tobytes()).digest(), len(h), _sketched(h, width), tokens[: int(first_shingles(np.int64(len(h)), similarity))].astype("<u8").tobytes())
                for column, x in zip(out, found):
                    column.append(x)
            columns = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["__kl_id", "__kl_text", "digest", "n", "sketch", "prefix"])

    return rows.select("__kl_id", "__kl_text", F.col("text").cast("string").cast("binary").alias("t")).mapInArrow(run, "__kl_id long, __kl_text string, digest binary, n long, sketch binary, prefix binary")


def _at_tokens(nodes: DataFrame) -> DataFrame:
    """token, node, top, n, pos, cell for each of the first shingles of the nodes (node, top, n, prefix); each is in a cell of its own, below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                node, top, n = (batch.column(c).slice(a, 512).to_numpy() for c in range(3))
                prefix = batch.column(3).slice(a, 512).to_pylist()
                many = np.array([len(p) // 8 for p in prefix], np.int64)
                pos = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                yield pa.record_batch([pa.array(np.frombuffer(b"".join(prefix), "<i8")), *(pa.array(np.repeat(x, many)) for x in (node, top, n)), pa.array(pos), pa.array(np.repeat(-1 - node, many))], names=["token", "node", "top", "n", "pos", "cell"])

    return nodes.select("node", "top", "n", "prefix").mapInArrow(run, "token long, node long, top long, n long, pos long, cell long")


def _crowded(rows: DataFrame) -> bool:
    """Whether the pairs at tokens are many more than the rows."""
    n = rows.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    return (n[1] or 0) > CROWDED * (n[0] or 0)


def _similar_groups(docs: DataFrame, bands: Bands, words: int, similarity: float, seed: int, leaf: int) -> DataFrame:
    """__kl_id, __kl_text, group for each row of docs."""
    rows = docs.select("doc_id", "text").withColumns(_identity())
    order = frequent(rows, docs.count(), words, seed)
    sets = save(_sets(rows, bands, words, similarity, seed, order), "sketches")
    of_one = F.min(_row(F.col("__kl_id"), F.col("__kl_text"))).alias("__kl_row")
    distinct = sets.groupBy("digest").agg(of_one, *[F.first(c).alias(c) for c in ("n", "sketch", "prefix")])
    distinct = save(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    joined = save(components(star_links(distinct, bands)), "joined")

    def renewed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """rows with the new roots of their groups as top."""
        known = roots.select(F.col("node").alias("__kl_node"), F.col("root").alias("__kl_root"))
        return rows.join(known, F.col("top") == F.col("__kl_node"), "left").withColumn("top", F.coalesce("__kl_root", "top")).drop("__kl_node", "__kl_root").select(*rows.columns)

    tops = save(renewed(distinct.select("node", F.col("node").alias("top")), joined), "tops")
    met = save(shared(_at_tokens(distinct.join(tops, "node"))), "met")
    crowded = save(crowds(met, distinct, bands, similarity), "crowded")
    if not crowded.isEmpty():
        cells = save(crowded.select(F.col("u").alias("node")).distinct().join(components(crowded), "node", "left").select("node", F.coalesce("root", "node").alias("cell")), "cells")
        members = save(cells.join(tops, "node").join(distinct.select("node", F.col("__kl_row").alias("__kl_key")), "node"), "members")
        found = save(cell_links(members.select("node", "top", "cell"), sets_of(members.select("node", "__kl_key"), docs, words, seed), similarity, leaf), "found")
        if not found.isEmpty():
            roots = save(components(found), "joined")
            tops, met = save(renewed(tops, roots), "tops"), renewed(met, roots)
        known = cells.select(F.col("node").alias("__kl_node"), F.col("cell").alias("__kl_cell"))
        met = met.join(F.broadcast(known) if known.count() <= FEW else known, F.col("node") == F.col("__kl_node"), "left").withColumn("cell", F.coalesce("__kl_cell", "cell")).drop("__kl_node", "__kl_cell")
        met = save(shared(met), "met")
    stars = int(_crowded(met))
    while not met.isEmpty():
        pairs = Saved(meetings(met, similarity, stars), "pairs")
        near = save(possible_pairs(pairs.df, distinct, similarity), "possible")
        pairs.drop()
        found = save(confirmed(near.select("u", "v"), docs, distinct.select("node", "__kl_row"), words, similarity, seed), "found")
        if not found.isEmpty():
            roots = save(components(near.join(found, ["u", "v"]).select("ru", "rv")), "joined")
            tops = save(renewed(tops, roots), "tops")
        if not stars:
            break
        if not found.isEmpty():
            met = save(shared(renewed(met, roots)), "met")
        stars = stars + 1 if stars < ROUNDS and _crowded(met) else 0  # at last all pairs that are left
    group = distinct.select("node", F.col("digest").alias("of")).join(tops, "node").select("of", F.col("top").alias("group"))
    return sets.join(group, F.col("digest") == F.col("of")).select("__kl_id", "__kl_text", "group")
