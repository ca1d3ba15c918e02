"""Hubness: documents that are near to everything (HUB-1..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.dense import dense_topk, ranked, scored
from quern.operators.positions import numbered


def hub_scores(docs: DataFrame, refs: DataFrame, k: int, exclude: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """(id, hub): the mean of the k greatest similarities of each document to the references.

    exclude (id, query_id) takes pairs out; a document left with fewer than k
    references has the mean of those (in parity mode minus infinity).
    """
    extra = 0
    if exclude is not None:
        extra = exclude.groupBy("id").count().agg(F.max("count")).collect()[0][0] or 0
    turned = docs.select(F.col("id").alias("query_id"), "vector")
    near = scored(turned, refs.select(F.col("query_id").alias("id"), "vector", F.lit(0.0).alias("bias")), k + extra, None)
    if exclude is not None:
        near = near.join(exclude.select(F.col("id").alias("query_id"), F.col("query_id").alias("id")), ["query_id", "id"], "left_anti")
    hub = ranked(near, k).groupBy(F.col("query_id").alias("id")).agg(F.avg("score").alias("hub"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") >= k, F.col("hub")).otherwise(F.lit(float("-inf"))) if parity else F.col("hub")
    return hub.select("id", F.round(value, 6).alias("hub"))


def document_hubs(docs: DataFrame, k: int) -> DataFrame:
    """(id, hub): as ``hub_scores`` among the documents themselves, each without itself."""
    near = dense_topk(docs.select(F.col("id").alias("query_id"), "vector"), docs, k, None, skip_self=True)
    return near.groupBy(F.col("query_id").alias("id")).agg(F.round(F.avg("score"), 6).alias("hub"))


def penalised_topk(queries: DataFrame, docs: DataFrame, hubs: DataFrame, beta: float, k: int = 10) -> DataFrame:
    """The k best by similarity minus beta times hub; every document must have a hub."""
    known = docs.join(hubs, "id", "left")
    bias = F.coalesce(-beta * F.col("hub"), F.raise_error(F.concat(F.lit("no hub for document "), F.col("id").cast("string"))).cast("double"))
    return dense_topk(queries, known, k, bias=bias)


def extended_queries(queries: DataFrame) -> DataFrame:
    from quern.functions.vectors import extended

    return queries.withColumn("vector", extended(F.col("vector"), F.lit(1.0)))


def extended_documents(docs: DataFrame, hubs: DataFrame, beta: float) -> DataFrame:
    from quern.functions.vectors import extended

    return docs.join(hubs, "id").withColumn("vector", extended(F.col("vector"), -beta * F.col("hub"))).drop("hub")


def separation_auc(rows: DataFrame, empty: float = 0.5) -> DataFrame:
    """(auc): how well score parts the group (a boolean) from the rest; ties count half.

    By average ranks; rows are numbered by range partitions, equal scores are never gathered.
    """
    placed = numbered(rows.select("score", "group"), [F.col("score")])
    ties = placed.groupBy("score").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"), F.count_if("group").alias("p"))
    s = ties.agg(F.sum(F.col("p") * (F.col("first") + (F.col("k") + 1) / 2)).alias("ranks"), F.sum("p").alias("np"), F.sum(F.col("k") - F.col("p")).alias("nq"))
    u = F.col("ranks") - F.col("np") * (F.col("np") + 1) / 2
    return s.select(F.coalesce(F.round(F.try_divide(u, F.col("np") * F.col("nq")), 6), F.lit(empty)).alias("auc"))


def hub_share(wrong: DataFrame, least: int = 5) -> DataFrame:
    """(share, top_hub): the part of wrong first answers (id) that come from documents wrong at least ``least`` times."""
    counts = wrong.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("share"),
        F.max_by("id", F.struct("n", "id")).alias("top_hub"),
    )


def reverse_neighbour_counts(docs: DataFrame, k: int) -> DataFrame:
    """(id, n): how often a document is among the k nearest of another; 0 where never."""
    near = dense_topk(docs.select(F.col("id").alias("query_id"), "vector"), docs, k, None, skip_self=True)
    counts = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def centroid_similarity(docs: DataFrame) -> DataFrame:
    """(id, similarity): dot product with the mean vector at unit length."""
    mean = docs.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    c, size = centre.select("c").scalar(), centre.select("size").scalar()
    from quern.functions.vectors import dot

    placed = docs.withColumn("c", c).withColumn("size", size)
    return placed.select("id", F.round(dot(F.col("vector"), F.col("c")) / F.col("size"), 6).alias("similarity"))


def zscores(rows: DataFrame, value: str) -> DataFrame:
    """rows with z: population z-score of a column; 0 where it does not vary."""
    stats = rows.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    m, s = stats.select("m").scalar(), stats.select("s").scalar()
    return rows.withColumn("m", m).withColumn("s", s).withColumn("z", F.when(F.col("s") > 0, F.round((F.col(value) - F.col("m")) / F.col("s"), 6)).otherwise(0.0)).drop("m", "s")


def hub_table(docs: DataFrame, hubs: DataFrame) -> DataFrame:
    """(text_hash, hub, ids, conflicting) by text: the mean hub of equal texts and whether they disagree; docs (id, text)."""
    from quern.functions.text import content_hash

    both = docs.select("id", content_hash(F.col("text")).alias("text_hash")).join(hubs, "id")
    return both.groupBy("text_hash").agg(
        F.round(F.avg("hub"), 6).alias("hub"), F.count(F.lit(1)).alias("ids"), ((F.max("hub") - F.min("hub")) > 1e-6).alias("conflicting")
    )


def hub_default(corpus_kind: Column) -> Column:
    """The correction is on only for collections of task solutions."""
    return corpus_kind == "apps"


def sweep(queries: DataFrame, docs: DataFrame, refs: DataFrame, ks: list[int], betas: list[float], top: int = 10) -> DataFrame:
    """(k, beta, query_id, id, score, rank_no) for a grid of parameters."""
    out = None
    for k in ks:
        hubs = hub_scores(docs, refs, k)
        for beta in betas:
            part = penalised_topk(queries, docs, hubs, beta, top).select(F.lit(k).alias("k"), F.lit(beta).alias("beta"), "query_id", "id", "score", "rank_no")
            out = part if out is None else out.unionByName(part)
    return out


def cross_fitted(queries: DataFrame, docs: DataFrame, refs: DataFrame, qrels: DataFrame, ks: list[int], betas: list[float], top: int = 10, draws: int = 200) -> DataFrame:
    """(fold, k, beta, queries, ndcg, diff, low, high, p, significant): parameters chosen on one half of the queries, measured on the other.

    Queries fall into two folds by a hash of their id. Of each fold the parameters of the
    best mean ndcg are taken (the smaller ones of equal) and their ranking of the other fold, named by ``fold``, is compared with no correction.
    """
    from quern.operators.metrics import per_query
    from quern.operators.stats import paired
    from quern.session import checkpoint

    runs = checkpoint(sweep(queries, docs, refs, ks, [0.0, *betas], top))
    key = F.struct("k", "beta", "query_id")
    grid = runs.select("k", "beta").distinct()
    judged = qrels.join(F.broadcast(grid), how="cross")  # as many copies as settings
    scores = per_query(runs.select(key.alias("query_id"), "id", "rank_no"), judged.select(key.alias("query_id"), "id", "rel")).select("query_id.*", "ndcg")
    scores = checkpoint(scores.withColumn("fold", F.pmod(F.xxhash64("query_id"), F.lit(2)).cast("int")))
    best = scores.groupBy("fold", "k", "beta").agg(F.avg("ndcg").alias("m")).groupBy("fold").agg(F.max_by(F.struct("k", "beta"), F.struct("m", -F.col("k"), -F.col("beta"))).alias("b"))
    out = None
    for fold, b in best.orderBy("fold").collect():  # two rows
        held = scores.where(F.col("fold") == 1 - fold)
        mine = held.where((F.col("k") == b["k"]) & (F.col("beta") == b["beta"]))
        plain = held.where((F.col("k") == ks[0]) & (F.col("beta") == 0.0))
        both = mine.select(F.lit("fitted").alias("system"), "query_id", F.col("ndcg").alias("score")).unionByName(plain.select(F.lit("plain").alias("system"), "query_id", F.col("ndcg").alias("score")))
        whole = mine.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
        test = paired(both, "fitted", "plain", draws).select("diff", "low", "high", "p", "significant")
        part = whole.select(F.lit(1 - fold).alias("fold"), F.lit(b["k"]).alias("k"), F.lit(b["beta"]).alias("beta"), "queries", "ndcg").join(test, how="cross")  # a row each
        out = part if out is None else out.unionByName(part)
    return out
