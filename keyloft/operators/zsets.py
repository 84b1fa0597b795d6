"""Scored sets: members ordered by score, then by member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add(writes: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """zset_scores after writes(key, member, score, seq): the last score of a member holds. A NaN score is an error."""
    score = F.col("score").cast("double")
    checked = F.when(F.isnan(score), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(score)
    new = writes.select("key", "member", checked.alias("score"), F.struct(F.lit(1).alias("new"), F.col("seq").cast("bigint").alias("seq")).alias("o"))
    if scores is not None:
        new = new.unionByName(scores.select("key", "member", "score", F.struct(F.lit(0).alias("new"), F.lit(0).cast("bigint").alias("seq")).alias("o")))
    return new.groupBy("key", "member").agg(F.max_by("score", "o").alias("score"))


def remove(scores: DataFrame, gone: DataFrame) -> DataFrame:
    return scores.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def score(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key, member) with the score, null where it is missing."""
    return wanted.join(scores.select("key", "member", "score"), ["key", "member"], "left")


def rank(scores: DataFrame) -> DataFrame:
    """key, member, score, rank from 0."""
    w = Window.partitionBy("key").orderBy("score", "member")
    return scores.select("key", "member", "score", (F.row_number().over(w).cast("bigint") - 1).alias("rank"))


def rank_of(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, member, rank of wanted(key, member) that are there: the sets that are asked about are sorted once, however many members are wanted."""
    asked = wanted.select("key", "member").distinct()
    ranked = rank(scores.join(asked.select("key").distinct(), "key", "left_semi"))
    return ranked.join(asked, ["key", "member"], "left_semi").select("key", "member", "rank")


def range_by_score(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Rows with a score from low to high, both included."""
    return scores.where(F.col("score").between(low, high)).select("key", "member", "score")


def size(scores: DataFrame) -> DataFrame:
    return scores.groupBy("key").agg(F.count("*").alias("size"))
