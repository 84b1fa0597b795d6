"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import crc_of_id

#: Labelled rows of each class that a classifier is fitted on, at most, and the longest text among them in bytes.
PER_CLASS = 1500
LONGEST = 100_000


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int = PER_CLASS, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """(text, label) of at most `per_class` documents of each class, in a fixed order.

    Only rows whose crc32(doc_id as text) mod `folds` is not `held_out` are taken, in the
    order of a hash of doc_id. Rows with a null or other label, null doc_ids and texts
    over `longest` bytes are left out; a doc_id labelled twice counts with its larger label, and one
    that stands in several documents with its smallest text.
    """
    kept = labels.where(F.col(label).isin(0, 1)).where(crc_of_id("doc_id") % folds != held_out)
    kept = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    parts = [kept.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_class rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= longest)
    found = texts.join(chosen, "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))
    rows = found.select("h", "doc_id", "y", F.col("text").cast("binary").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    return [(bytes(r["text"]), r["y"]) for r in rows]
