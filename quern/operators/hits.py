"""What is said about hits: confidence, place, language, files (RET-9, 17, 19, 22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import is_test_path

HIGH, LOW = 0.03, 0.01

# The languages of file endings.
ENDINGS = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx",
    "java": "java", "go": "go", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
    "rs": "rust", "kt": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua", "dart": "dart", "m": "objective-c", "sh": "shell", "sql": "sql",
}


def margins(hits: DataFrame, identity: Column | None = None) -> DataFrame:
    """(query_id, margin, n): first score minus the next one; copies of the first under other ids of the same identity do not count."""
    same = F.col("id") if identity is None else identity
    w = W.partitionBy("query_id").orderBy("rank_no")
    rows = hits.withColumn("top", F.first(same).over(w)).withColumn("first_score", F.first("score").over(w))
    other = (F.col("rank_no") > 1) & (same != F.col("top"))
    return rows.groupBy("query_id").agg(
        (F.first("first_score") - F.max(F.when(other, F.col("score")))).alias("margin"), F.count(F.lit(1)).alias("n")
    )


def confidence(hits: DataFrame, identity: Column | None = None) -> DataFrame:
    """(query_id, margin, label): high from 0.03 on, low below 0.01; a single hit is medium."""
    m = margins(hits, identity)
    label = F.when(F.col("margin").isNull(), "medium").when(F.col("margin") >= HIGH, "high").when(F.col("margin") < LOW, "low").otherwise("medium")
    return m.select("query_id", F.coalesce("margin", F.lit(0.0)).alias("margin"), label.alias("label"))


def file_ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.coalesce(table[file_ending(path)], F.lit("unknown"))


def described(rows: DataFrame) -> DataFrame:
    """rows (id, content) with path, name, start_line, end_line and language, by the id path::name#line."""
    rest = F.element_at(F.split("id", "::", 2), 2)
    start = F.expr("try_cast(nullif(substring_index(split(id, '::', 2)[1], '#', -1), split(id, '::', 2)[1]) AS int)")
    n_lines = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace("content", r"\R$", ""), r"\R")))
    return rows.select(
        "*", F.split_part("id", F.lit("::"), F.lit(1)).alias("unit_path"), F.split_part(rest, F.lit("#"), F.lit(1)).alias("name"),
        start.alias("first_line"), (start + n_lines - 1).alias("last_line"), language_of(F.split_part("id", F.lit("::"), F.lit(1))).alias("language"),
    )


def without_tests(hits: DataFrame, k: int) -> DataFrame:
    """Hits outside of test paths, ranked anew."""
    from quern.operators.dense import ranked

    return ranked(hits.where(~is_test_path(F.split_part("id", F.lit("::"), F.lit(1)))).drop("rank_no"), k)


def file_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, path, file_rank): files in the order in which their first snippet appears."""
    first = hits.groupBy("query_id", F.split_part("id", F.lit("::"), F.lit(1)).alias("path")).agg(F.min("rank_no").alias("first_rank"))
    return first.withColumn("file_rank", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank")).cast("bigint"))
