"""Watching heads of repositories as a stream (STR-1, 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def head_changes(rows: DataFrame) -> DataFrame:
    """(repo, at, head) of batch rows (repo, at, head) whose head differs from the one before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("repo").orderBy("at", "head")
    return rows.where(F.col("head").isNotNull()).withColumn("before", F.lag("head").over(w)).where(~F.col("head").eqNullSafe(F.col("before"))).select("repo", "at", "head")


def head_changes_stream(stream: DataFrame) -> DataFrame:
    """(repo, at, head) of a stream (repo, at, head) as ``head_changes``: the last head of each repository is state.

    Observations of a micro-batch are taken in the order of their time; what arrives in a
    later batch follows what is known. A repository's observations of one batch are one group.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("repo", "at", "head")}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "head"], kind="stable")
        before = rows["head"].shift(1)
        before.iloc[0] = state.get[0] if state.exists else None
        state.update((rows["head"].iloc[-1],))
        yield rows[rows["head"] != before][["repo", "at", "head"]]

    rows = stream.where(F.col("head").isNotNull()).select("repo", "at", "head")
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return rows.groupBy("repo").applyInPandasWithState(run, schema, f"head {kinds['head']}", "append", GroupStateTimeout.NoTimeout)


def taken_in(stream: DataFrame, out: str, progress: str) -> None:
    """Write what a stream has by now to files and end; run again with the same folders it goes on where it was."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def watch(stream: DataFrame, sync: Callable[[str, str], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``sync(repo, head)`` for the newest head of each repository of a micro-batch.

    The polling interval is the trigger; without one the query takes what is
    there and ends. sync must skip a head it has already, so a batch that runs
    again after a failure does no harm.
    """

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.where(F.col("head").isNotNull()).groupBy("repo").agg(F.max_by("head", F.struct("at", "head")).alias("head"))
        for r in newest.toLocalIterator():
            sync(r["repo"], r["head"])

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def heads_of(spark: SparkSession, folder: str, schema: str = "repo string, at timestamp, head string") -> DataFrame:
    """A stream of head observations from files that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def distinct_heads(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first sight of each (repo, head) within a delay: state is dropped as the watermark passes."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["repo", "head"])
