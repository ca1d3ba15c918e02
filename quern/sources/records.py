"""Record files, judgments and rankings: readers and writers (SRC-6..12, 17, SNK-4..6, 10)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The names under which records keep their id, text and path.
ID_KEYS = ("id", "_id", "query_id", "query-id", "corpus_id", "corpus-id", "doc_id", "qid")
TEXT_KEYS = ("text", "query", "code", "content", "body", "question")
PATH_KEYS = ("path", "file", "filename")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL, NDJSON, JSON (list or map id to text), CSV or TSV file, all columns as text.

    The form follows the ending, for other files the first sign; a malformed JSON line is an error.
    """
    low = path.lower()
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0].lstrip("\ufeff ").lower() if head else ""
    if low.endswith((".jsonl", ".ndjson")) or (not low.endswith((".json", ".csv", ".tsv")) and first.startswith("{")):
        return spark.read.option("mode", "FAILFAST").option("primitivesAsString", "true").json(path)
    if low.endswith(".json"):
        whole = spark.read.option("wholetext", "true").text(path)
        if first.startswith("["):
            return spark.read.option("multiLine", "true").option("mode", "FAILFAST").option("primitivesAsString", "true").json(path)
        pairs = F.explode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), "map<string,string>", {"mode": "FAILFAST"}))
        return whole.select(pairs.alias("id", "text"))
    sep = "\t" if "\t" in first else ","
    rows = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def field(rows: DataFrame, keys: tuple[str, ...], what: str, needed: bool = True) -> Column:
    """The first non-empty of the named columns; none is an error that names the field."""
    have = [F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys if k in rows.columns]
    fail = F.raise_error(F.lit(f"a record has no {what} (one of {', '.join(keys)})")).cast("string")
    return F.coalesce(*have, fail) if needed else (F.coalesce(*have) if have else F.lit(None).cast("string"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, path); an id that stands twice is an error."""
    rows = read_records(spark, path)
    out = rows.select(field(rows, ID_KEYS, "id").alias("id"), field(rows, TEXT_KEYS, "text").alias("text"), field(rows, PATH_KEYS, "path", False).alias("path"))
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    return out.withColumn("id", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col("id"))).cast("string")).otherwise(F.col("id")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text); of equal ids the last in the file counts."""
    rows = read_records(spark, path)
    out = rows.select(field(rows, ID_KEYS, "id").alias("query_id"), field(rows, TEXT_KEYS, "text").alias("text"), F.monotonically_increasing_id().alias("at"))
    return out.groupBy("query_id").agg(F.max_by("text", "at").alias("text"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, id, rel) of lines (value) of four columns: query, iteration, document, relevance."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(p) == 4).select(p[0].alias("query_id"), p[2].alias("id"), p[3].cast("double").cast("int").alias("rel"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id, rel): TREC columns, or records with a default relevance of 1."""
    head = spark.read.text(path).limit(1).collect()
    if head and len(head[0][0].split()) == 4 and head[0][0].lstrip()[:1] not in "{[":
        return parse_qrels(spark.read.text(path))
    rows = read_records(spark, path)
    rel = field(rows, ("score", "rel", "relevance"), "relevance", False)
    return rows.select(
        field(rows, ("query-id", "query_id", "qid", "query"), "query").alias("query_id"), field(rows, ("corpus-id", "corpus_id", "doc_id", "id"), "document").alias("id"),
        F.coalesce(rel.cast("double").cast("int"), F.lit(1)).alias("rel"),
    )


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have a judgment."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def title_and_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(F.trim(title), F.lit("")), text))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, ids) of a rankings file, ids in order of rank, then id; ranks must be whole numbers."""
    rows = spark.read.option("header", "true").csv(path)
    missing = {"query_id", "corpus_id", "rank"} - set(rows.columns)
    if missing:
        raise ValueError(f"rankings lack {sorted(missing)}")
    rank = F.coalesce(F.expr("try_cast(rank AS int)"), F.raise_error(F.lit("a rank is no whole number")).cast("int"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "corpus_id"))), lambda s: s["corpus_id"]).alias("ids"))


def ranking_rows(run: DataFrame) -> DataFrame:
    """(query_id, corpus_id, rank, score) as rankings files have them; score with six places."""
    return run.select("query_id", F.col("id").alias("corpus_id"), F.col("rank_no").alias("rank"), F.format_string("%.6f", F.col("score").cast("double")).alias("score"))


def write_rankings(run: DataFrame, path: str) -> None:
    refuse_foreign(path, "query_id")
    ranking_rows(run).orderBy("query_id", "rank").write.mode("overwrite").option("header", "true").csv(path)


def write_described(run: DataFrame, described: DataFrame, path: str) -> None:
    """Rankings with path, lines and name of each hit, as JSON lines."""
    run.join(described, "id").write.mode("overwrite").json(path)


def predictions_to_ranks(predictions: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, id, score, rank_no) of predictions (query_id, scores map); ties by id from the end of the alphabet."""
    return prediction_ranks(predictions.select("query_id", F.explode("scores").alias("id", "score")), k)


def prediction_ranks(rows: DataFrame, k: int = 100) -> DataFrame:
    """The same of predictions that stand one to a row."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc())
    return rows.withColumn("rank_no", F.row_number().over(w).cast("bigint")).where(F.col("rank_no") <= k)


def refuse_foreign(path: str, mark: str) -> None:
    """An existing file of another kind is never overwritten."""
    if os.path.isfile(path):
        with open(path, errors="replace") as f:
            if mark not in f.readline():
                raise FileExistsError(f"{path} exists and was not written by this engine")
