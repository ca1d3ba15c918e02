"""Positions of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import checkpoint, parallelism


def numbered(rows: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """rows with at (from 0) in the order, and n: the number of rows; both within the groups of ``by`` if given.

    Rows are partitioned by range of (by, order) and sorted within partitions; the
    position is the place in the partition plus the sizes of the partitions before
    it, and a group's first position is taken off. Only one row for each partition
    and one for each group is ever looked at together. The sorted rows are written
    to the shared folder, so that both readings of them agree.
    """
    by = by or []
    names = rows.columns
    keys = [F.col(c) for c in by] + list(order)
    sorted_rows = rows.repartitionByRange(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = checkpoint(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition: bounded by the session's number of partitions
    starts = F.broadcast(sizes.select("_part", (before - F.col("_first")).alias("_shift")))
    whole = placed.join(starts, "_part").select(*names, (F.col("_row") + F.col("_shift")).alias("at"))
    if not by:
        total = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
        return whole.withColumn("n", total)
    groups = whole.groupBy(*by).agg(F.min("at").alias("_start"), F.count(F.lit(1)).alias("n"))
    kept = [F.col(f"w.{c}") for c in names]
    on = None
    for c in by:
        same = F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}"))
        on = same if on is None else on & same
    return whole.alias("w").join(groups.alias("g"), on).select(*kept, (F.col("w.at") - F.col("g._start")).alias("at"), F.col("g.n").alias("n"))
