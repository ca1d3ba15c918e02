"""Encoding of texts through a cache, resumable by buckets (EMB-1, 2, 7, 9)."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import content_hash
from quern.functions.vectors import hashed_vector


class Encoder(Protocol):
    """Anything with a signature that makes a vector column of a text column."""

    signature: str

    def column(self, text: Column) -> Column: ...


class HashingEncoder:
    """The default encoder: word counts by hash bucket, inside the JVM."""

    def __init__(self, dim: int = 32):
        self.dim = dim
        self.signature = f"hashing-{dim}"

    def column(self, text: Column) -> Column:
        return hashed_vector(text, self.dim)


class PandasEncoder:
    """An encoder of one's own: a function from a Series of texts to a Series of vectors, run in Arrow batches."""

    def __init__(self, signature: str, function: Callable):
        self.signature = signature
        self._udf = F.pandas_udf(function, "array<float>")

    def column(self, text: Column) -> Column:
        return self._udf(text)


def cache_misses(texts: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """(key, text) of the distinct texts the cache has no vector of."""
    keyed = texts.where(F.col("text").isNotNull()).select(content_hash(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.where(F.col("sig") == signature).select("key"), "key", "left_anti")


def encode(texts: DataFrame, encoder: Encoder, cache: DataFrame | None = None) -> DataFrame:
    """texts (id, text) with vector; equal texts are encoded once, cached ones not at all."""
    keyed = texts.withColumn("key", content_hash(F.col("text")))
    distinct = keyed.where(F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
    if cache is not None:
        held = cache.where(F.col("sig") == encoder.signature).select("key", "vector")
        fresh = distinct.join(held.select("key"), "key", "left_anti").select("key", encoder.column(F.col("text")).alias("vector"))
        vectors = held.unionByName(fresh)
    else:
        vectors = distinct.select("key", encoder.column(F.col("text")).alias("vector"))
    return keyed.join(vectors, "key", "left").drop("key")


def encode_into(spark: SparkSession, texts: DataFrame, encoder: Encoder, folder: str, buckets: int = 16) -> DataFrame:
    """Fill a cache folder (sig, key, vector), bucket by bucket; a run that broke off goes on with the buckets that are missing."""
    path = f"{folder}/sig={encoder.signature}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    keyed = texts.where(F.col("text").isNotNull()).select(content_hash(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    placed = keyed.withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.lit(buckets)))
    for b in range(buckets):
        done = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"bucket={b}", "_SUCCESS"))
        if not fs.exists(done):
            placed.where(F.col("bucket") == b).select("key", encoder.column(F.col("text")).alias("vector")).write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return spark.read.parquet(path).select(F.lit(encoder.signature).alias("sig"), "key", "vector")


def plain_texts(rows: DataFrame, columns: list[str]) -> Column:
    """One text of heterogeneous record columns: the non-empty ones, joined by spaces."""
    have = [c for c in columns if c in rows.columns]
    return F.trim(F.concat_ws(" ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in have]))
