"""Connected components of a link table, by alternating large-star and small-star steps.

Each step keeps the components and moves links towards the smallest node, in a number of
steps that grows with the logarithm of the nodes. A step is two joins on a node, whose
skew Spark splits, and minima that are combined before the shuffle; nothing gathers the
links of a node or a component. Links that fit one task are settled there at once: the steps
are dozens of small queries, whose threads and plans the driver has to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import Saved, save

#: Links up to which one task settles them, in about 145 MB; more go through the steps.
ALONE = 1 << 20


def dealt_anew(column: str) -> Column:
    """The same numbers, not known to be dealt by them: Spark then shuffles both sides of the join, and can split a node with many links."""
    return F.col(column).bitwiseXOR(F.lit(0)).alias(column)  # a sum with 0 would be simplified away


def _large(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of u to the smallest of u and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u"), F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them; u is the larger end."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least.select(dealt_anew("u"), "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the groups of `root` over links (i, j), in place; the positions of links that do it, a spanning forest."""
    used, at = [], np.arange(len(i))
    while True:
        x, y = root[i[at]], root[j[at]]
        apart = x != y
        if not apart.any():
            return np.concatenate([*used, np.zeros(0, np.int64)]).astype(np.int64)
        at, x, y = at[apart], x[apart], y[apart]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        root[high] = np.minimum(x, y)[first]  # a larger root hangs on a smaller one, so no circle
        used.append(at[first])
        while (root[root] != root).any():
            root[:] = root[root]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links (u, v) of a task, as `components` gives them."""
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*([b.column(0).to_numpy(), b.column(1).to_numpy()] for b in batches))]
    if ends:
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = np.arange(len(nodes))
        spanning(root, at[: len(ends[0])], at[len(ends[0]) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["node", "root"])


def components(links: DataFrame, most: int = 100, alone: int = ALONE) -> DataFrame:
    """node, root (the smallest node reachable) for every node that differs from its root.

    `links` has two columns u, v of whole numbers, in any direction, repeated or
    not; links of a node to itself, and links with a null end, are left out.
    """
    ends = links.toDF("u", "v").where("u != v")
    now = Saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _sign(now.df)
    if 0 < before[0] <= alone:
        kinds = [f.dataType for f in now.schema]
        roots = now.df.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_settled, "node long, root long")
        found = save(roots.select(F.col("node").cast(kinds[0]).alias("node"), F.col("root").cast(kinds[1]).alias("root")), "links")
        now.drop()
        return found
    for _ in range(most):
        if not before[0]:
            break
        new = Saved(_small(_large(now.df)), "links")
        now.drop()
        now = new
        after = _sign(now.df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
