"""How often every distinct term occurs, in how many records, and which are too rare or too common.

Method: (term, record) pairs are sorted externally by range partitioning on the
pair and sorting within partitions; one scan over the sorted runs of each
partition adds the counts and the distinct records of every term. A term that
spans partitions (a hot one) leaves one short run in each of them, and these
runs are added at the end. No term is ever gathered in one task.

Defined cases
  * null or blank terms and null counts or counts below 1 are dropped.
  * of several rows of one (version, shard, term as written) the greatest
    loaded_at counts, equal copies once; at equal loaded_at the greater count.
  * a null version or shard is a record like any other.
  * terms are trimmed of white space, put in NFC, then in lower case.
  * an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import parallelism

RARE_BELOW = 10
COMMON_PERCENT = 5


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = [unicodedata.normalize("NFC", t.strip()).lower() for t in b.column("term").to_pylist()]
        kept = [k for k, t in enumerate(terms) if t]
        if len(kept) < len(terms):
            terms, b = [terms[k] for k in kept], b.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column("record"), b.column("n")], ["term", "record", "n"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (term, record, n); a run that goes on in the next batch is emitted in parts, with its first record counted once."""
    last_term = last_record = None
    for b in batches:
        if not b.num_rows:
            continue
        terms = b.column("term").to_numpy(zero_copy_only=False)
        records = b.column("record").to_numpy(zero_copy_only=False)
        n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        new_term = np.ones(len(terms), bool)
        new_term[1:] = terms[1:] != terms[:-1]
        new_pair = new_term.copy()
        new_pair[1:] |= records[1:] != records[:-1]
        if terms[0] == last_term and records[0] == last_record:
            new_pair[0] = False
        at = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms[at], pa.string()), pa.array(np.add.reduceat(n, at)), pa.array(np.add.reduceat(new_pair.astype(np.int64), at))],
            ["term", "total", "records"],
        )
        last_term, last_record = terms[-1], records[-1]


def latest_counts(df: DataFrame) -> DataFrame:
    """(term, record, n) of the counts that hold; record names version and shard."""
    good = df.where(F.col("term").isNotNull() & F.col("term").rlike(r"(?U)\S") & (F.col("n") >= 1))
    return (
        good.groupBy("version", "shard", "term")
        .agg(F.max(F.struct("loaded_at", "n")).alias("last"))
        .select("term", F.to_json(F.struct("version", "shard")).alias("record"), F.col("last.n").alias("n"))
    )


def term_counts(df: DataFrame) -> DataFrame:
    """(term, total, records): over all versions and shards."""
    pairs = latest_counts(df).mapInArrow(_normalise, "term string, record string, n bigint")
    ordered = pairs.repartitionByRange(parallelism(df.sparkSession), "term", "record").sortWithinPartitions("term", "record")
    runs = ordered.mapInArrow(_scan_runs, "term string, total bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, snippets: DataFrame, rare_below: int = RARE_BELOW, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """(term, total, records, mark): mark is rare, common or null; common is judged against the number of current rows of snippets."""
    current = snippets.select("id", "version").distinct().agg(F.count(F.lit(1)).alias("rows")).scalar()
    return term_counts(df).withColumn(
        "mark",
        F.when(F.col("total") < rare_below, "rare").when(F.col("total") * 100 > current * common_percent, "common"),
    )
