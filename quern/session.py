"""Sessions, table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query of this engine assumes (UTC, AQE, Arrow)."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # one thread for each Python worker: tasks are what runs side by side
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all tasks share, named in spark.checkpoint.dir.

    Where it is unset, a session on one machine (as in tests) gets a folder of its own; on a cluster there is no folder all tasks share, which is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: what the session says for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows over enough tasks for work that is heavy per row.

    Input of many splits is left as it is. Of few splits (a small file, or a shuffle
    that was coalesced by size) the rows are dealt out by a hash of the key.
    """
    spark = df.sparkSession
    wanted = max(parallelism(spark), 3 * spark.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= wanted // 3 else df.repartition(wanted, key)


def tasks(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row, after a shuffle that would be coalesced by size."""
    return max(parallelism(spark), 3 * spark.sparkContext.defaultParallelism)
