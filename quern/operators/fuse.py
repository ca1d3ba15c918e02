"""Reciprocal-rank fusion of ranked lists (RET-6, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dense import ranked


def fused(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, top: int | None = None) -> DataFrame:
    """(query_id, id, score, rank_no) from lists (query_id, id, rank_no): the sum of weight / (k + rank).

    Scores of the lists do not matter. An id that only a list of weight 0 holds
    stays, with score 0; no lists give an error, weights must match the lists.
    """
    if not lists:
        raise ValueError("no ranked lists to fuse")
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists are needed")
    parts = [x.select("query_id", "id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank_no"))).alias("part")) for x, w in zip(lists, weights, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    scores = every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(scores, top if top is not None else 2**31 - 1)
