"""Retrieval metrics (AGG-1..5, 7..15, STA-1, 15). Queries without a run score 0; the judgments drive the outer side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.positions import numbered


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, recall_at: int = 100) -> DataFrame:
    """(query_id, ndcg, rr, rr_at_k, recall) from run (query_id, id, rank_no) and qrels (query_id, id, rel)."""
    best = W.partitionBy("query_id").orderBy(F.col("rel").desc(), "id")
    ideal = (
        qrels.where("rel > 0").withColumn("r", F.row_number().over(best))
        .groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r"))).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("relevant"))
    )
    hits = run.join(qrels.where("rel > 0"), ["query_id", "id"])
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank_no") <= k, gain(F.col("rel"), F.col("rank_no"))).otherwise(0.0)).alias("dcg"),
        F.min("rank_no").alias("first"), F.count_if(F.col("rank_no") <= recall_at).alias("found"),
    )
    every = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    return every.select(
        "query_id",
        F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.coalesce(F.when(F.col("first") <= k, 1 / F.col("first")), F.lit(0.0)), 6).alias("rr_at_k"),
        F.round(F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)), 6).alias("recall"),
    )


def means(scores: DataFrame) -> DataFrame:
    """(queries, ndcg, mrr, mrr_at_k, recall): averages over all judged queries."""
    return scores.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.avg("rr_at_k"), F.lit(0.0)), 6).alias("mrr_at_k"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"),
    )


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., n, p...): percentiles by nearest rank, the index rounded half to even; only the wanted ranks leave the sort."""
    by = by or []
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*by, value), [F.col(value)], by)
    picks = [F.max(F.when(F.col("at") == F.bround(F.lit(s) * (F.col("n") - 1)).cast("int"), F.col(value))).alias(f"p{int(round(s * 100))}") for s in shares]
    return placed.groupBy(*by, "n").agg(*picks) if by else placed.groupBy("n").agg(*picks)


def quartiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Quartiles with linear interpolation."""
    return rows.groupBy(*(by or [])).agg(*[F.expr(f"percentile({value}, {s})").alias(f"q{int(s * 100)}") for s in (0.25, 0.5, 0.75)])


def rank_bucket(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank <= 10, "2-10").when(rank <= 100, "11-100").otherwise("beyond")


def terciles(rows: DataFrame, order: list, value: str) -> DataFrame:
    """(tercile, n, mean): thirds by position, the remainder in the last one."""
    size = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    placed = numbered(rows, order).select(value, F.least(F.floor(F.col("at") / size), F.lit(2)).alias("tercile"))
    return placed.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def bands(rows: DataFrame, value: str, edges: list[float], measure: str) -> DataFrame:
    """(band, n, mean) by edges; empty bands are left out."""
    band = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        band = F.when((F.col(value) >= lo) & (F.col(value) < hi), k).otherwise(band)
    return rows.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 6).alias("mean"))


def deciles(rows: DataFrame, value: str, hit: str) -> DataFrame:
    """(decile, n, hit_rate) of rows by falling value; each has n // 10 rows, the remainder is left out."""
    size = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    placed = numbered(rows, [F.col(value).desc(), F.col("query_id")]).select(hit, F.floor(F.col("at") / size).alias("decile")).where("decile < 10")
    return placed.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("hit_rate"))


def label_summary(rows: DataFrame) -> DataFrame:
    """(label, share, top1, top10) of rows (label, rank_no of the answer or null)."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("k"), F.round(F.avg(F.coalesce((F.col("rank_no") == 1).cast("double"), F.lit(0.0))), 6).alias("top1"),
        F.round(F.avg(F.coalesce((F.col("rank_no") <= 10).cast("double"), F.lit(0.0))), 6).alias("top10"),
    )
    return g.withColumn("n", total).select("label", F.round(F.col("k") / F.col("n"), 6).alias("share"), "top1", "top10")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """(queries, top1, top3, top10, mrr) of ranks (rank_no or null)."""
    def within(k: int) -> Column:
        return F.round(F.avg(F.coalesce((F.col("rank_no") <= k).cast("double"), F.lit(0.0))), 6)

    return ranks.agg(
        F.count(F.lit(1)).alias("queries"), within(1).alias("top1"), within(3).alias("top3"), within(10).alias("top10"),
        F.round(F.avg(F.coalesce(1 / F.col("rank_no"), F.lit(0.0))), 6).alias("mrr"),
    )


def describe(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(lang, n, shortest, median, longest): sizes of a collection by language."""
    size = F.length(text)
    return docs.where(F.col(text).isNotNull()).groupBy(language).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("shortest"), F.expr(f"percentile(length({text}), 0.5)").alias("median"), F.max(size).alias("longest")
    )


def reuse_percentage(reused: Column, new: Column) -> Column:
    return F.round(100.0 * reused / F.greatest(F.lit(1), reused + new), 1)


def single_answer_ndcg(rank: Column, k: int = 10) -> Column:
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)
