"""The N best items of every group, by a hot-cold split.

Items are reduced to one score each (partial before the shuffle), groups are
counted exactly, and groups above ``heavy`` items take the salted way: range
partitioning on (group, score, item) spreads one group over as many partitions
as it needs, each keeps its own N best by rank, and only these meet again. Light
groups take an ordinary window. Both parts are joined by union.

Defined cases
  * hits with a null id, a null or NaN score do not count; null or empty lists give nothing.
  * an item counts once in a group, with its greatest score; negative and infinite scores are allowed.
  * order: score descending, then id ascending by code point; a null group is a group.
  * an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import parallelism

HEAVY = 20_000
#: Names of heavy groups that are sent to every task; more are joined by shuffle.
HOT_LISTED = 10_000


def _ranked(items: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("hit_id").asc())
    return items.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def _hits(rows: DataFrame) -> DataFrame:
    hits = rows.select("query_id", F.explode("hits").alias("h")).select("query_id", F.col("h.id").alias("hit_id"), F.col("h.score").alias("score"))
    return hits.where(F.col("hit_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def _best_scores(hits: DataFrame) -> DataFrame:
    """The greatest score of each item in each group."""
    return hits.groupBy("query_id", "hit_id").agg(F.max("score").alias("score"))


def heavy_groups(rows: DataFrame, heavy: int) -> DataFrame:
    """(query_id) of the groups with more than ``heavy`` hits, by an exact count."""
    return rows.groupBy("query_id").agg(F.sum(F.greatest(F.size("hits"), F.lit(0))).alias("n")).where(F.col("n") > heavy).select("query_id")


def top_items(rows: DataFrame, n: int = 10, heavy: int = HEAVY) -> DataFrame:
    """(query_id, hit_id, score, rank_no): the n best items of every group."""
    spark = rows.sparkSession
    hot = heavy_groups(rows, heavy)
    known = hot.limit(HOT_LISTED + 1).collect()
    if len(known) <= HOT_LISTED:  # few names: sent to every task; beyond that, a join by shuffle
        hot = F.broadcast(spark.createDataFrame(known, hot.schema))
    hits = _hits(rows)
    on = hits["query_id"].eqNullSafe(hot["query_id"])
    # a light group meets in one task by its key, once for both the scores and the ranks
    light = _ranked(_best_scores(hits.join(hot, on, "left_anti").repartition("query_id")), n)
    if known:
        many = _best_scores(hits.join(hot, on, "left_semi")).repartitionByRange(parallelism(spark), "query_id", F.col("score").desc(), "hit_id")
        # the window's rank limit keeps n rows of a group in each range partition before anything meets in one task
        light = light.unionByName(_ranked(many, n))
    return light.withColumn("rank_no", F.col("rank_no").cast("bigint"))
