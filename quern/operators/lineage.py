"""Snippets through versions: identity, history, collapsing, releases (VER-1..6, 8, 10)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.operators.snapshots import canonical_hash, version_order


def current_rows(snippets: DataFrame) -> DataFrame:
    """Of the rows of one id and version the one of the greatest load time, with all columns; equal copies once."""
    w = W.partitionBy("id", "version").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("content").desc_nulls_last())
    return snippets.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_version(versions: DataFrame) -> DataFrame:
    """(version) built last."""
    return versions.orderBy(F.col("built_at").desc(), F.col("version").desc()).limit(1).select("version")


def lineage_keys(rows: DataFrame) -> DataFrame:
    """rows (id, version, ...) with lineage: the id without its line, unless that is ambiguous in any version."""
    base = F.regexp_replace("id", "#[^#]*$", "")
    placed = rows.withColumn("base", base)
    ambiguous = (
        placed.groupBy("version", "base").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .where("a <> b").select("base").distinct().withColumn("twice", F.lit(True))
    )
    return placed.join(ambiguous, "base", "left").withColumn("lineage", F.when(F.col("twice"), F.col("id")).otherwise(F.col("base"))).drop("twice", "base")


def history(snippets: DataFrame, versions: DataFrame) -> DataFrame:
    """(lineage, ord, version, id, h, changed, content): members of each lineage in the order of versions."""
    rows = current_rows(snippets).select("id", "version", canonical_hash().alias("h"), "content")
    placed = lineage_keys(rows).join(version_order(versions).select("version", "ord"), "version")
    w = W.partitionBy("lineage").orderBy("ord", "id")
    return placed.withColumn("changed", F.coalesce(F.lag("h").over(w) != F.col("h"), F.lit(False)))


def history_labels(hist: DataFrame) -> DataFrame:
    """(lineage, label) such as ``v1 = v2 != v3``."""
    steps = F.array_sort(F.collect_list(F.struct("ord", "id", "version", "changed")))
    joined = F.transform(steps, lambda s, i: F.concat(F.when(i == 0, "").when(s["changed"], "!= ").otherwise("= "), s["version"]))
    return hist.groupBy("lineage").agg(F.array_join(joined, " ").alias("label"))


@F.pandas_udf(StringType())
def _diff(before: pd.Series, after: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y, p, q in zip(before, after, a, b, strict=True):
        d = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), fromfile=p, tofile=q, n=2, lineterm=""))
        out.append("\n".join(d if len(d) <= 30 else [*d[:30], f"... {len(d) - 30} more diff lines"]))
    return pd.Series(out)


def history_diffs(hist: DataFrame) -> DataFrame:
    """(lineage, before, after, diff): unified diffs, context 2, of the changes of each lineage; a view of up to 30 lines and the number of the rest."""
    w = W.partitionBy("lineage").orderBy("ord", "id")
    steps = hist.withColumn("before", F.lag("version").over(w)).withColumn("old", F.lag("content").over(w)).where("changed")
    return steps.select("lineage", "before", F.col("version").alias("after"), _diff("old", "content", "before", "version").alias("diff"))


def collapsed(hits: DataFrame, members: DataFrame, k: int = 10, newest: bool = False) -> DataFrame:
    """One row for each lineage of the hits (query_id, id, version, score): the best, with all its versions in order.

    members (lineage, id, version, ord, h) lists every loaded row. With
    ``newest`` the shown member is the newest one of equal content.
    """
    placed = hits.join(members, ["id", "version"])
    w = W.partitionBy("query_id", "lineage").orderBy(F.col("score").desc(), "id", "ord")
    best = placed.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "lineage", "id", "version", "score", "h")
    spans = members.groupBy("lineage").agg(F.array_join(F.transform(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "version"))), lambda s: s["version"])), lambda v: v), " ").alias("versions"))
    if newest:
        last = members.groupBy("lineage", "h").agg(F.max(F.struct("ord", "id", "version")).alias("m"))
        best = best.join(last, ["lineage", "h"]).select("query_id", "lineage", F.col("m.id").alias("id"), F.col("m.version").alias("version"), "score", "h")
    r = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id", "version")
    return best.join(spans, "lineage").withColumn("rank_no", F.row_number().over(r).cast("bigint")).where(F.col("rank_no") <= k).drop("h")


def release_diff(snippets: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, added, removed, changed, new_texts) of each version against the one before."""
    from quern.operators.snapshots import snapshot_changes

    changes = snapshot_changes(snippets, versions).groupBy("version").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    placed = current_rows(snippets).select("version", canonical_hash().alias("h")).join(version_order(versions).select("version", "ord"), "version").select("version", "ord", "h").distinct()
    before = placed.select((F.col("ord") + 1).alias("ord"), "h")
    fresh = placed.where("ord > 1").join(before, ["ord", "h"], "left_anti").groupBy("version").agg(F.count(F.lit(1)).alias("new_texts"))
    return changes.join(fresh, "version", "left").select("version", "added", "removed", "changed", F.coalesce("new_texts", F.lit(0)).alias("new_texts"))


def reuse_report(snippets: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, snippets, new_texts, reused_texts): distinct texts of each version that an earlier version already holds, and those it is the first to hold."""
    placed = current_rows(snippets).select("id", "version", canonical_hash().alias("h")).join(version_order(versions).select("version", "ord"), "version")
    first = placed.groupBy("h").agg(F.min("ord").alias("first_ord"))
    texts = placed.select("version", "ord", "h").distinct().join(first, "h")
    counts = texts.groupBy("version").agg(F.count_if(F.col("ord") == F.col("first_ord")).alias("new_texts"), F.count_if(F.col("ord") > F.col("first_ord")).alias("reused_texts"))
    return placed.groupBy("version").agg(F.count(F.lit(1)).alias("snippets")).join(counts, "version")


def uid(identity: Column, version: Column, several: bool) -> Column:
    """How a loaded row is named: the id alone when one version is loaded."""
    return F.concat(identity, F.lit("@"), version) if several else identity


def rank_probes(hits: DataFrame, golds: DataFrame, base: str, probe: str, k: int = 10) -> DataFrame:
    """(query_id, lineage, rank_no): where the probed version's member of the answer stands among the base version's hits; null beyond k.

    hits (query_id, lineage, id, version, score), golds (query_id, lineage). Other
    lineages keep their hits of the base version, the answer's own those of the probed one, as if it alone had been replaced.
    """
    own = hits.join(golds.withColumnRenamed("lineage", "gold"), "query_id")
    mine = F.col("lineage") == F.col("gold")
    kept = own.where((mine & (F.col("version") == probe)) | (~mine & (F.col("version") == base)))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    placed = kept.withColumn("n", F.row_number().over(w)).where((F.col("n") <= k) & mine).groupBy("query_id").agg(F.min("n").cast("bigint").alias("rank_no"))
    return golds.select("query_id", "lineage").join(placed, "query_id", "left")
