"""Embedding near-duplicates by NN-descent.

Equal vectors become one node. Seeded hyperplane trees, more of them for larger labels, sort the nodes of a label, and
windows over that order give each node a first list of its nearest neighbours. Each
round then compares the neighbours of every node with one another (a join brings their
vectors to the node, in lists of bounded length) and merges what is closer into their lists, until few
change. Links are the listed pairs over the threshold.

A list that is full of links is saturated: its node may have more. The pairs of every
component are computed in blocks, whatever its size. A link that neither end lists joins two components with saturated lists: blocks of these are compared with one
another too, within a label and unless their centres are too far apart. An audit compares samples of nodes with brute force, and trees are added
until it is passed; if it is not passed after some attempts, all pairs of each label are computed in blocks.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloft.llm.common import Saved, save, tidied
from keyloft.llm.components import components, dealt_anew
from keyloft.llm.mixing import running
from keyloft.llm.simhash import forest

THRESHOLD = 0.93
#: Length of a neighbour list, and the least cosine of a neighbour that is kept to search through.
LISTED, REACH = 16, 0.7
#: Least number of trees of the first lists, bits of their codes, rows of a window.
TREES, CODE_BITS, WINDOW = 4, 24, 128
ROUNDS = 6
#: Vectors of a block of a component.
BLOCK = 256
#: Sample of the recall audit for each kind of node, and the recall that ends the search.
AUDIT, RECALL = 2048, 0.98


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node (the smallest vec_id), label, x, copies (its vec_ids) for each distinct vector that can link at all."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda v: v != 0)
    # forall is null where a component is: such rows go, as do empty vectors
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("x")).distinct()
    return rows.groupBy("label", "x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def numbered(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Adds least, the smallest vec_id, to nodes, and makes node a name of one vector only; whether that changed any.

    Where vectors that differ share their smallest vec_id, node is the place in the order of it, label and a hash of the vector.
    The smallest node of a group then still has its smallest vec_id.
    """
    own = nodes.withColumn("least", F.col("node"))
    if own.groupBy("least").count().where(F.col("count") > 1).isEmpty():
        return own, False
    order = [F.col("least"), F.col("label"), F.xxhash64("x")]
    return save(running(own.drop("node"), order, {}).withColumnRenamed("__kl_no", "node"), "numbered"), True


def unit(x: pa.Array, size: int) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows again, as tables that end where the key changes; each batch is sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (rest and rest[-1].column(key)[-1].as_py() != k[0]):
            if rest and not cut:
                yield pa.Table.from_batches(rest)
                rest = [batch]
                continue
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


LISTS = "node long, nbrs array<long>, sims array<double>"


def _lists(node: np.ndarray, nbrs: list[np.ndarray], sims: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(nbrs, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], names=["node", "nbrs", "sims"])


def _closest(ids: np.ndarray, x: np.ndarray, k: int, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row with any: its id, and ids and cosines of its k closest others within reach."""
    near = x @ x.T
    near[ids[:, None] == ids] = -2
    many = (near >= reach).sum(axis=1)
    for i in np.flatnonzero(many):
        top = np.argpartition(-near[i], min(k, len(ids) - 1) - 1)[:k] if many[i] > k else np.flatnonzero(near[i] >= reach)
        yield int(ids[i]), ids[top], near[i][top]


def _top(owner: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """One list for each owner: its k closest neighbours, each once."""
    order = np.lexsort((nbrs, -sims, owner))
    owner, nbrs, sims = owner[order], nbrs[order], sims[order]
    by = np.lexsort((nbrs, owner))
    first = np.ones(len(by), bool)
    first[1:] = (owner[by][1:] != owner[by][:-1]) | (nbrs[by][1:] != nbrs[by][:-1])
    keep = np.sort(by[first])  # lexsort is stable, so of equal pairs the closest is first
    owner, nbrs, sims = owner[keep], nbrs[keep], sims[keep]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    stop = np.append(start[1:], len(owner))
    if len(start):
        yield _lists(owner[start], [nbrs[a : min(b, a + k)] for a, b in zip(start, stop)], [sims[a : min(b, a + k)] for a, b in zip(start, stop)])


def _combined(found: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Lists found for nodes, those of one node as one before they are shuffled: a node that many others list does not send a list for each."""
    if found:
        node, nbrs, sims = zip(*found)
        yield from _top(np.repeat(np.array(node, np.int64), list(map(len, nbrs))), np.concatenate(nbrs), np.concatenate(sims), k)


def first_lists(nodes: DataFrame, trees: int, seed: int, k: int, reach: float) -> DataFrame:
    """Lists from windows over the order of each tree; a node has one row for each window that gave it any."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), trees * (CODE_BITS + 1)))
                p = (unit(part.column("x"), int(d)) @ planes).reshape(-1, trees, CODE_BITS + 1)
                code = (p[:, :, :CODE_BITS] > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1))
                for t in range(trees):
                    yield pa.record_batch([part.column("node"), part.column("label"), part.column("size"), part.column("x"), pa.array(np.full(len(p), t), pa.int32()), pa.array(code[:, t]), pa.array(p[:, t, CODE_BITS])], names=["node", "label", "size", "x", "tree", "code", "along"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, tree, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "tree", "label"))
            change = np.flatnonzero((size[1:] != size[:-1]) | (tree[1:] != tree[:-1]) | (label[1:] != label[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(size)]):
                ids, x = batch.column("node").slice(a, b - a).to_numpy(), unit(batch.column("x").slice(a, b - a), int(size[a]))
                out = [r for at in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2) for r in _closest(ids[at : at + WINDOW], x[at : at + WINDOW], k, reach)]
                yield from _combined(out, k)

    with_size = nodes.select("node", "label", F.size("x").cast("long").alias("size"), "x")
    keyed = with_size.mapInArrow(keys, with_size.selectExpr("*", "0 as tree", "0L as code", "0D as along").schema)
    order = ["tree", "label", "size", "code", "along", "node"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(windows, LISTS)


def trees_for(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The trees in which a pair at the threshold, without other neighbours, shares a window with a chance of `recall`.

    A plane parts the pair with a chance of its angle over 180 degrees; the vectors of a label fill windows after
    as many planes as halve them to the half of a window.
    """
    most = nodes.groupBy("label", F.size("x")).count().agg(F.max("count")).first()[0] or 1
    together = (1 - np.arccos(threshold) / np.pi) ** min(CODE_BITS, max(0.0, np.log2(most / (WINDOW // 2))))
    return TREES if together > 0.999 else max(TREES, int(np.ceil(np.log(1 - recall) / np.log(1 - together))))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list for each node: the k closest of all of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "node"):
            count = table.column("nbrs").combine_chunks().value_lengths().to_numpy()
            nbrs, sims = (np.concatenate([c.flatten().to_numpy() for c in table.column(n).chunks]) for n in ("nbrs", "sims"))
            yield from _top(np.repeat(table.column("node").to_numpy(), count), nbrs, sims, k)

    return lists.repartition(F.col("node")).sortWithinPartitions("node").mapInArrow(run, LISTS)


def joined(lists: DataFrame, nodes: DataFrame, k: int, reach: float) -> DataFrame:
    """Lists that the members of each node's list, and those that list it, give one another: at most 2 k members for each node."""
    out = lists.select(F.col("node").alias("hub"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("hub", F.col("e.nbrs").alias("node"), F.col("e.sims").alias("sim"))
    back = out.select(F.col("node").alias("hub"), F.col("hub").alias("node"), "sim")
    rank = F.row_number().over(Window.partitionBy("hub").orderBy(F.col("sim").desc(), "node"))
    back = back.withColumn("r", rank).where(F.col("r") <= k).drop("r")
    members = out.union(back).select("hub", "node").union(lists.select(F.col("node").alias("hub"), "node")).distinct()
    placed = members.join(nodes.select("node", "x"), "node").select("hub", "node", "x", F.size("x").cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "hub"):
            hub = table.column("hub").to_numpy()
            batch = table.combine_chunks().to_batches()[0]
            cuts = np.flatnonzero(hub[1:] != hub[:-1]) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(hub)]):
                part = batch.slice(a, b - a)
                size = part.column("size").to_numpy()
                if b - a > 2 and (size == size[0]).all():
                    out += _closest(part.column("node").to_numpy(), unit(part.column("x"), int(size[0])), k, reach)
            yield from _combined(out, k)

    return placed.repartition(F.col("hub")).sortWithinPartitions("hub").mapInArrow(run, LISTS)


def descend(nodes: DataFrame, trees: int = TREES, seed: int = 5, k: int = LISTED, reach: float = REACH, rounds: int = ROUNDS, start: DataFrame | None = None) -> Saved:
    """The neighbour lists (node, nbrs, sims) after NN-descent; a node without a neighbour within reach has no row."""
    first = first_lists(nodes, trees, seed, k, reach)
    now = Saved(merged(first if start is None else first.union(start), k), "lists")
    for _ in range(rounds):
        total = now.df.agg(F.sum(F.size("nbrs")), F.sum(F.aggregate("sims", F.lit(0.0), lambda a, v: a + v))).first()
        new = Saved(merged(now.df.union(joined(now.df, nodes, k, reach)), k), "lists")
        after = new.df.agg(F.sum(F.size("nbrs")), F.sum(F.aggregate("sims", F.lit(0.0), lambda a, v: a + v))).first()
        now.drop()
        now = new
        if not after[0] or after[0] - total[0] <= 0.001 * after[0] and after[1] - total[1] <= 0.0001 * after[1]:
            break
    return now


def exact_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """node, other, linked: for each node the copies of what it links with (other null), and links of roots (linked 0) that join them.

    members: part, label, root, node, x, copies, full. Nodes of one part, whose vectors have one length, are all
    compared; so are nodes of different parts of a label that are both full, except for blocks whose
    centres lie too far apart for their radii. A pair of blocks is one row and one matrix
    product; what leaves it is a sum for each node and a spanning forest of the roots that it joins.
    """
    sizes = members.groupBy("part").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    cut = members.join(sizes.select(dealt_anew("part"), "blocks"), "part").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = save(cut.groupBy("label", "part", "b").agg(F.first("blocks").alias("blocks"), F.max("full").alias("full"), F.collect_list(F.struct("node", "root", "copies", "x")).alias("rows")), "blocks")
    inside = packed.select("part", "b", F.col("part").alias("other"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("c"))
    index = inside.union(close_blocks(packed.where("full = 1").select("label", "part", "b", "rows"), threshold))
    left = index.join(packed.select("part", "b", "rows"), ["part", "b"])
    right = packed.select(F.col("part").alias("other"), F.col("b").alias("c"), F.col("rows").alias("others"))
    pairs = left.join(right, ["other", "c"]).select((F.col("part") == F.col("other")) & (F.col("b") == F.col("c")), "rows", "others")

    def rows(node: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(linked)], names=["node", "other", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, one, two in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                (a, r, n, x), (b, t, m, y) = (_rows(v.values) for v in (one, two))
                for d in set(x) & set(y):
                    (i, p), (j, q) = x[d], y[d]
                    near = (p @ q.T >= threshold) & (a[i][:, None] != b[j])
                    yield rows(a[i], near @ m[j])
                    if not same:
                        yield rows(b[j], n[i] @ near)
                    u, v = np.nonzero(near & (r[i][:, None] != t[j]))
                    if len(u):
                        names, at = np.unique(np.concatenate([r[i][u], t[j][v]]), return_inverse=True)
                        root = forest(len(names), iter([(at[: len(u)], at[len(u) :])]))
                        moved = np.flatnonzero(root != np.arange(len(root)))
                        yield pa.record_batch([pa.array(names[moved]), pa.array(names[root[moved]]), pa.array(np.zeros(len(moved), np.int64))], names=["node", "other", "linked"])

    return pairs.mapInArrow(run, "node long, other long, linked long").groupBy("node", "other").agg(F.sum("linked").alias("linked"))


def close_blocks(packed: DataFrame, threshold: float, cell: int = 1024) -> DataFrame:
    """part, b, other, c: blocks of different parts of a label that may hold a link; packed: label, part, b, rows.

    By the triangle inequality of angles: no link if the centres are further apart than both radii and the threshold's angle.
    """

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, centres, radii = [], [], []
            for rows in batch.column("rows"):
                ((d, (_, x)),) = _rows(rows.values)[3].items()
                c = x.sum(axis=0)
                c = c / np.linalg.norm(c) if c.any() else x[0]
                size.append(d)
                centres.append(c)
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            yield pa.record_batch([*(batch.column(n) for n in ("label", "part", "b")), pa.array(size, pa.int64()), pa.array(radii, pa.float64()), pa.array(centres, pa.list_(pa.float64()))], names=["label", "part", "b", "size", "radius", "x"])

    near = packed.mapInArrow(centre, packed.select("label", "part", "b", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("radius"), F.array(F.lit(0.0)).alias("x")).schema)
    cells = near.groupBy("label", "size").agg(F.ceil(F.count("*") / cell).cast("long").alias("cells"))
    dealt = near.join(cells, ["label", "size"]).withColumn("cell", F.pmod(F.xxhash64("part", "b"), F.col("cells")))
    lists = dealt.groupBy("label", "size", "cell").agg(F.first("cells").alias("cells"), F.collect_list(F.struct("part", "b", "radius", "x")).alias("rows"))
    left = lists.select("label", "size", F.explode(F.sequence("cell", F.col("cells") - 1)).alias("to"), "cell", "rows")
    both = left.join(lists.select("label", "size", F.col("cell").alias("to"), F.col("rows").alias("others")), ["label", "size", "to"])
    angle = float(np.arccos(threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, same, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                p, q = one.values, two.values
                (k, b, r), (m, c, t) = ([v.field(n).to_numpy() for n in ("part", "b", "radius")] for v in (p, q))
                x, y = (v.field("x").flatten().to_numpy().reshape(-1, d) for v in (p, q))
                may = np.arccos(np.clip(x @ y.T, -1, 1)) <= r[:, None] + t + angle
                i, j = np.nonzero(may & ((k[:, None] < m) if same else (k[:, None] != m)))
                yield pa.record_batch([pa.array(v) for v in (k[i], b[i], m[j], c[j])], names=["part", "b", "other", "c"])

    return both.select("size", F.col("cell") == F.col("to"), "rows", "others").mapInArrow(run, "part long, b long, other long, c long")


def component_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """node, linked (the copies of all nodes of its component that it links with); members: root, node, x, copies."""
    alone = members.select(F.col("root").alias("part"), F.lit(0).alias("label"), "root", "node", "x", "copies", F.lit(0).alias("full"))
    return exact_links(alone, threshold, block).where("other is null").select("node", "linked")


def _rows(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Nodes, roots, copies, and by vector length the positions and unit vectors."""
    x = rows.field("x")
    size = x.value_lengths().to_numpy()
    return *(rows.field(n).cast(pa.int64()).to_numpy() for n in ("node", "root", "copies")), {int(d): (np.flatnonzero(size == d), unit(x.filter(pa.array(size == d)), int(d))) for d in np.unique(size)}


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float | None:
    """The share of the links of a node that counts (node, linked) has, by brute force over all nodes; None if no node that was looked at has any.

    Seeded samples are drawn from nodes without known links, with few and with many. Nodes without known links are told
    apart from the few by numbers: what of them turns out to have links counts as missed, at the weight of all
    such nodes. The lesser of that mean and of the mean over nodes with many links counts: a large group cannot hide what small ones miss.
    """
    linked = F.coalesce("linked", F.lit(0))
    told = nodes.join(counts, "node", "left").select("node", "label", "x", F.when(linked == 0, 0).when(linked <= LISTED, 1).otherwise(2).alias("many"))
    sizes = {r["many"]: r["count"] for r in told.groupBy("many").count().collect()}  # at most three rows
    parts = [told.where(F.col("many") == k).orderBy(F.xxhash64("node", F.lit(11)), "node").limit(sample) for k in sorted(sizes)]
    if not parts:
        return 1.0  # no vector can link
    chosen = reduce(DataFrame.union, parts).toArrow()  # at most three times `sample` vectors
    known = nodes.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_ = known.value.combine_chunks().to_batches()[0]
        ids, labels, lengths = batch_.column("node").to_numpy(), batch_.column("label").to_numpy(zero_copy_only=False), batch_.column("x").value_lengths().to_numpy()
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            size, label = batch.column("x").value_lengths().to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            for d in set(np.unique(size)) & set(np.unique(lengths)):
                for y in set(np.unique(label[size == d])) & set(np.unique(labels[lengths == d])):
                    mine, own = (lengths == d) & (labels == y), batch.filter(pa.array((size == d) & (label == y)))
                    near = unit(batch_.column("x").filter(pa.array(mine)), int(d)) @ unit(own.column("x"), int(d)).T >= threshold
                    near &= ids[mine][:, None] != own.column("node").to_numpy()
                    total[mine] += near @ own.column("copies").to_numpy()
        yield pa.record_batch([pa.array(ids), batch_.column("many"), pa.array(total)], names=["node", "many", "truth"])

    truth = nodes.select("node", "label", "x", "copies").mapInArrow(run, "node long, many int, truth long").groupBy("node", "many").agg(F.sum("truth").alias("truth"))
    share = F.least("truth", linked) / F.col("truth")
    found = truth.join(counts, "node", "left").groupBy("many").agg(F.count("*").alias("n"), F.count_if(F.col("truth") > 0).alias("ends"), F.coalesce(F.sum(F.when(F.col("truth") > 0, share)), F.lit(0.0)).alias("share"))
    seen = {r["many"]: r for r in found.collect()}  # at most three rows
    ends = {k: sizes[k] * r["ends"] / r["n"] for k, r in seen.items()}  # nodes with links, as the samples tell
    held = {k: sizes[k] * r["share"] / r["n"] for k, r in seen.items()}
    few, many = ends.get(0, 0) + ends.get(1, 0), ends.get(2, 0)
    means = ([held.get(1, 0) / few] if few else []) + ([held[2] / many] if many else [])
    return min(means, default=None)


def rooted(ends: DataFrame, found: DataFrame) -> DataFrame:
    """The members with the roots that the links of roots in `found` give them."""
    joins = found.where("other is not null").select("node", "other")
    if joins.isEmpty():
        return ends
    moved = components(joins).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return save(ends.join(moved, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "members")


def by_labels(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (node, root and more) and counts (node, linked) from all pairs of each label in blocks: exact, at the cost of their square."""
    kinds = nodes.groupBy("label", F.size("x").alias("size")).agg(F.min("node").alias("part"))
    placed = nodes.withColumn("size", F.size("x")).join(kinds, ["label", "size"])
    found = save(exact_links(placed.select("part", "label", F.col("node").alias("root"), "node", "x", "copies", F.lit(0).alias("full")), threshold), "found")
    return rooted(nodes.withColumn("root", F.col("node")), found), found.where("other is null").select("node", "linked")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = LISTED, trees: int | None = None, recall: float = RECALL, most: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Links join vectors of equal, not null label with a cosine of at least the threshold,
    in double precision; n_links counts other vec_ids. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without label or vec_id, link with nothing: n_links 0, component_id =
    vec_id. Vectors of different lengths never link. Rows equal in vec_id, label and vector are one vector, those that share only
    a vec_id are vectors of their own, and equal vectors link as copies. An empty table gives none. If none of the vectors that the audit looks at has a link, the recall is not known, and a warning says so.
    """
    with tidied():
        nodes, renamed = numbered(save(nodes_of(vectors), "nodes"))
        start, seed = None, 5
        trees = trees or trees_for(nodes, threshold, recall)
        for attempt in range(most):
            lists = descend(nodes, trees << attempt, seed + attempt, k, min(REACH, threshold), start=start)
            start = lists.df
            linked = lists.df.select("node", "sims", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).where(F.col("e.sims") >= threshold)
            links = linked.select(F.col("node").alias("u"), F.col("e.nbrs").alias("v"))
            roots = components(links)
            full = lists.df.where((F.size("sims") >= k) & (F.array_min("sims") >= threshold)).select("node")
            ends = save(nodes.join(roots.union(roots.select("root", "root").distinct()).toDF("node", "root"), "node"), "members")
            across = ends.join(full.withColumn("full", F.lit(1)), "node", "left").groupBy("root").agg(F.max(F.coalesce("full", F.lit(0))).alias("full")).select(dealt_anew("root"), "full")
            members = ends.join(across, "root").select(dealt_anew("root").alias("part"), "label", "root", "node", "x", "copies", "full")
            found = save(exact_links(members, threshold), "found")
            counts = found.where("other is null").select("node", "linked")
            ends = rooted(ends, found)
            measured = audit(nodes, counts, threshold)
            if measured is None:
                warnings.warn("the recall of the links is not measured: no vector of the audit's samples has any", stacklevel=2)
            if measured is None or measured >= recall:
                break
        else:
            ends, counts = by_labels(nodes, threshold)
        tops = ends.select("node", F.col("root").alias("top"))
        if renamed:
            tops = tops.join(nodes.select(F.col("node").alias("top"), F.col("least").alias("named")), "top").select("node", F.col("named").alias("top"))
        info = nodes.select("label", "x", "node", "least", "copies").join(counts, "node", "left").join(tops, "node", "left")
        info = save(info.select(F.col("label").alias("n_label"), F.col("x").alias("n_x"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "least").alias("component_id")), "info", outer=True)
    v = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    out = v.join(info, (F.col("label") == F.col("n_label")) & (F.col("embedding") == F.col("n_x")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
