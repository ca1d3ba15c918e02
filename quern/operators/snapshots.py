"""Changes between consecutive full snapshots of a table, by gaps and islands.

Every (key, snapshot) is reduced to its current row first; runs of consecutive
snapshots with an equal row hash become validity intervals; the starts, ends
and adjacencies of the intervals of a key are its change events.

Defined cases
  * repeated rows: the row with the greatest load time counts, equal copies once;
    rows of the same load time with different hashes: the greatest hash counts.
  * a null or blank hash stands for the sha256 of the content; a null content
    then counts as a value of its own (the empty string's hash is not used).
  * a null key is a key like any other (one key, null).
  * snapshots named by rows but missing from the list of versions are ignored;
    a version listed without any row is an empty snapshot: every key that stood
    before it is removed there.
  * empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"


def canonical_hash(hash_col: str = "hash", content_col: str = "content") -> Column:
    """The stated hash, trimmed and in lower case, or else the sha256 of the content."""
    stated = F.lower(F.regexp_replace(F.col(hash_col), BLANKS, ""))
    return F.coalesce(F.nullif(stated, F.lit("")), F.sha2(F.col(content_col).cast("binary"), 256), F.lit("null content"))


def current_hashes(rows: DataFrame) -> DataFrame:
    """(id, version, h): one row for each id and version, by the greatest load time.

    The aggregation is partial before the shuffle, so an id delivered many
    times sends one row per input partition and version.
    """
    return (
        rows.select("id", "version", "loaded_at", canonical_hash().alias("h"))
        .groupBy("id", "version")
        .agg(F.max(F.struct("loaded_at", "h")).alias("last"))
        .select("id", "version", F.col("last.h").alias("h"))
    )


def version_order(versions: DataFrame) -> DataFrame:
    """(version, ord, n_versions) with consecutive ord by built_at, then label; one row for each label."""
    one = versions.where(F.col("version").isNotNull()).groupBy("version").agg(F.max("built_at").alias("built_at"))
    w = W.orderBy("built_at", "version")
    return one.select("version", F.row_number().over(w).alias("ord"), F.count(F.lit(1)).over(W.partitionBy()).alias("n_versions"))


def validity_intervals(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, h, first_ord, last_ord, n_versions): the longest runs of consecutive snapshots with one hash."""
    placed = current_hashes(rows).join(version_order(versions), "version")
    w = W.partitionBy("id").orderBy("ord")
    starts = placed.withColumn(
        "new", F.when((F.lag("h").over(w) == F.col("h")) & (F.lag("ord").over(w) == F.col("ord") - 1), 0).otherwise(1)
    ).withColumn("island", F.sum("new").over(w))
    return starts.groupBy("id", "island").agg(
        F.first("h").alias("h"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.first("n_versions").alias("n_versions")
    )


def snapshot_changes(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, id, change): added, removed or changed, at the later of each two consecutive snapshots."""
    w = W.partitionBy("id").orderBy("first_ord")
    spans = validity_intervals(rows, versions).select(
        "id", "first_ord", "last_ord", "n_versions",
        F.lag("last_ord").over(w).alias("before"), F.lead("first_ord").over(w).alias("after"),
    )
    began = F.when(F.col("first_ord") > 1, F.struct(F.col("first_ord").alias("ord"), F.when(F.col("before") == F.col("first_ord") - 1, "changed").otherwise("added").alias("change")))
    ended = F.when(
        (F.col("last_ord") < F.col("n_versions")) & ~F.coalesce(F.col("after") == F.col("last_ord") + 1, F.lit(False)),
        F.struct((F.col("last_ord") + 1).alias("ord"), F.lit("removed").alias("change")),
    )
    events = spans.select("id", F.explode(F.array_compact(F.array(began, ended))).alias("e")).select("id", "e.ord", "e.change")
    return events.join(version_order(versions).select("version", "ord"), "ord").select("version", "id", "change")
