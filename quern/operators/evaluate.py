"""Query sets from code, and evaluation of configurations (STA-7b, 11..14, LEX-6, VER-7, TXT-24, SRC-11)."""

from __future__ import annotations

import ast
import json
import time
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.operators import metrics, stats
from quern.operators.search import SearchConfig, search
from quern.session import spread

LEAST_WORDS = 5


# query sets


def docstring_of(content: str) -> tuple[str, str] | None:
    """(first paragraph of the docstring in one line, the source without the docstring) of a Python definition."""
    source = content.strip()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            top = ast.parse(source + "\n").body[:1]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if not top or not isinstance(top[0], ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
        return None
    text = ast.get_docstring(top[0])
    if not text:
        return None
    stated = top[0].body[0]
    lines = source.splitlines()
    rest = lines[: stated.lineno - 1] + lines[stated.end_lineno :]
    return (" ".join(text.strip().split("\n\n")[0].split()), "\n".join(rest)) if len(rest) > 1 else None


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("stripped", StringType())]))
def _docstrings(contents: pd.Series) -> pd.DataFrame:
    found = [docstring_of(c) if isinstance(c, str) else None for c in contents]
    return pd.DataFrame({"text": [f[0] if f else None for f in found], "stripped": [f[1] if f else None for f in found]})


def docstring_queries(snippets: DataFrame) -> DataFrame:
    """(query_id, version, text, answer, stripped): docstrings of Python definitions of five words or more as questions.

    snippets (id, version, content). Docstrings that several lineages share, or that
    stand in the rest of any snippet, are left out, as for comments
    (``stats.unleaked``); stripped is the answer's content without its docstring.
    """
    from quern.functions.text import content_hash, words
    from quern.session import checkpoint

    digest = content_hash(F.col("content")).alias("digest")
    python = F.split_part("id", F.lit("::"), F.lit(1)).endswith(".py")
    contents = snippets.where(F.col("content").isNotNull()).groupBy(digest).agg(F.first("content").alias("content"), F.max(python).alias("python"))
    read = spread(contents, "digest").withColumn("d", F.when(F.col("python"), _docstrings("content")))
    read = checkpoint(read.select("digest", F.coalesce("d.stripped", "content").alias("stripped"), "d.text"))
    norm = lambda c: F.lower(F.array_join(words(c), " "))
    fields = read.select("digest", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(norm(F.col("text")), F.lit("")).alias("norm"), norm(F.col("stripped")).alias("body"))
    kept = stats.unleaked(snippets.select("id", "version", digest), fields, LEAST_WORDS)
    return kept.join(read.select("digest", "stripped"), "digest").select(F.col("id").alias("query_id"), "version", "text", F.col("id").alias("answer"), "stripped")


def handwritten_queries(spec: DataFrame, snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spec (query_id, text, answer path::name) resolved to (query_id, text, answer id), the smallest of several; and (query_id, answer) of those no snippet (id) has."""
    ids = snippets.groupBy(F.regexp_replace("id", "#[^#]*$", "").alias("answer")).agg(F.min("id").alias("id"))
    found = spec.join(ids, "answer", "left")
    return found.where("id IS NOT NULL").select("query_id", "text", F.col("id").alias("answer")), found.where("id IS NULL").select("query_id", "answer")


def judged(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A benchmark's tables as this engine takes them: corpus (id, title, text) to (id, text), the queries (query_id, text) that have judgments, and qrels.

    limit keeps that many queries by id, their answers, and the first 2,000 documents by id.
    """
    text = F.when(F.coalesce("title", F.lit("")) != "", F.trim(F.concat("title", F.lit("\n"), F.coalesce("text", F.lit(""))))).otherwise(F.coalesce("text", F.lit("")))
    docs, asked = corpus.select("id", text.alias("text")), queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    if limit:
        asked = asked.orderBy("query_id").limit(limit)
        qrels = qrels.join(asked.select("query_id"), "query_id", "left_semi")
        keep = qrels.select("id").unionByName(docs.select("id").orderBy("id").limit(2_000)).distinct()
        docs = docs.join(keep, "id", "left_semi")
    return docs, asked, qrels


# calls


def call_pairs(snippets: DataFrame, least: int = 2) -> DataFrame:
    """(first, second, snippets): in how many snippets (id, content) one defined name is called before another for the first time.

    Defined names are those of the ids path::name#line, of more than three letters.
    Only names that ``least`` snippets call can form a pair that as many hold, so all others go before pairs are made.
    """
    name = F.split_part(F.split_part("id", F.lit("::"), F.lit(2)), F.lit("#"), F.lit(1))
    defined = snippets.select(name.alias("name")).where((F.length("name") > 3) & ~F.col("name").isin("window", "main", "__init__")).distinct()
    runs = F.transform(F.regexp_extract_all("content", F.lit(r"[\w$.]++\s*\("), F.lit(0)), lambda s: F.regexp_replace(s, r"\s*\($", ""))
    called = snippets.select("id", F.posexplode(F.array_distinct(runs)).alias("at", "name")).where(F.col("name").rlike(r"^[A-Za-z_$][\w$]*$")).join(defined, "name", "left_semi")
    often = called.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("name")
    kept = called.join(often, "name", "left_semi")
    a, b = kept.select("id", F.col("at").alias("i"), F.col("name").alias("first")), kept.select("id", F.col("at").alias("j"), F.col("name").alias("second"))
    pairs = a.join(b, "id").where("i < j").groupBy("first", "second").agg(F.count(F.lit(1)).alias("snippets"))
    return pairs.where(F.col("snippets") >= least)


# samples


def save_sample(spark: SparkSession, query_ids: DataFrame, folder: str, validation: dict | None = None) -> None:
    """Store a sample (query_id) and what its validation said, if it had one."""
    query_ids.select("query_id").write.mode("overwrite").parquet(f"{folder}/query_ids")
    spark.createDataFrame([(json.dumps(validation or {}),)], "validation string").coalesce(1).write.mode("overwrite").text(f"{folder}/validation")


def load_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id) of a stored sample; warns where it was not validated as keeping the ranking."""
    said = json.loads(spark.read.text(f"{folder}/validation").first()[0])
    if not said.get("preserved", False):
        warnings.warn(f"the sample in {folder} was not validated as keeping the ranking: use all queries for decisions", stacklevel=2)
    return spark.read.parquet(f"{folder}/query_ids")


# evaluation


def evaluated(runs: DataFrame, qrels: DataFrame, base: str, draws: int = 1000) -> DataFrame:
    """(config, queries, ndcg, mrr, recall, diff, low, high, p, significant) of runs (config, query_id, id, rank_no), each but the base compared with it."""
    configs = runs.select("config").distinct()
    key = F.struct("config", "query_id").alias("query_id")
    judged_by = qrels.join(F.broadcast(configs), how="cross").select(key, "id", "rel")  # as many copies as configurations
    scores = metrics.per_query(runs.select(key, "id", "rank_no"), judged_by).select("query_id.config", "query_id.query_id", "ndcg", "rr", "recall")
    whole = scores.groupBy("config").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall")
    )
    own = scores.select(F.col("config").alias("system"), "query_id", F.col("ndcg").alias("score"))
    compared = None
    for (name,) in configs.where(F.col("config") != base).orderBy("config").collect():  # a handful by their nature
        part = stats.paired(own, name, base, draws).select(F.col("system_a").alias("config"), "diff", "low", "high", "p", "significant")
        compared = part if compared is None else compared.unionByName(part)
    if compared is None:
        compared = runs.sparkSession.createDataFrame([], "config string, diff double, low double, high double, p double, significant boolean")
    return whole.join(compared, "config", "left")


def ablation(slow: bool = False) -> dict[str, SearchConfig]:
    """Named configurations that each differ from the shipped one in a single step."""
    from dataclasses import replace

    from quern.functions.queries import QuestionConfig
    from quern.operators.rerank import Weights

    shipped = replace(SearchConfig.shipped(), view_weights=None)
    grid = {
        "lexical, plain questions": replace(SearchConfig.lexical_only(), question=QuestionConfig.baseline()),
        "lexical": SearchConfig.lexical_only(),
        "shipped": shipped,
        "rerank": replace(shipped, rerank=Weights()),
        "fusion 0.15": replace(shipped, use_sparse=True, sparse_weight=0.15),
        "fusion 0.30": replace(shipped, use_sparse=True, sparse_weight=0.3),
        "rerank of 500": replace(shipped, rerank=Weights(), shortlist=500),
        "questions without sections": replace(shipped, question=QuestionConfig(cut_sections=True)),
    }
    return grid | ({"fusion 0.15, rerank of 500": replace(grid["fusion 0.15"], rerank=Weights(), shortlist=500)} if slow else {})


def run_grid(docs: DataFrame, questions: DataFrame, grid: dict[str, SearchConfig], top: int = 100) -> DataFrame:
    """(config, query_id, id, rank_no) of a search by each configuration."""
    from dataclasses import replace

    out = None
    for name, config in grid.items():
        part = search(docs, questions, replace(config, top_k=top)).select(F.lit(name).alias("config"), "query_id", "id", "rank_no")
        out = part if out is None else out.unionByName(part)
    return out


def as_markdown(table: DataFrame) -> str:
    """A report table, a line for each configuration by falling ndcg."""
    rows = table.orderBy(F.col("ndcg").desc(), "config").collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["config", "queries", "ndcg", "mrr", "recall", "diff", "low", "high", "p", "significant"]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)])


def timed_reindex(spark: SparkSession, before: DataFrame, after: DataFrame, folder: str, label: str = "next") -> dict:
    """Seconds of building a later version (id, text) anew and on top of an earlier one, and how many vectors that saved."""
    from quern.sources import store

    began = time.perf_counter()
    full = store.build(spark, after, f"{folder}/full", label)
    middle = time.perf_counter()
    store.build(spark, before, f"{folder}/grown", "first")
    ready = time.perf_counter()
    grown = store.build(spark, after, f"{folder}/grown", label)
    took = {"full_seconds": middle - began, "incremental_seconds": time.perf_counter() - ready}
    return took | {"snippets": full["snippets"], "new_vectors": grown["new_vectors"], "reused_vectors": grown["reused_vectors"]}


# long documents


def token_windows(docs: DataFrame, tokenizer: str, window: int = 512, stride: int = 384) -> DataFrame:
    """(id, window_no, text): docs (id, text) cut by the token ids of a tokenizer file; a text of one window stays as it is, a null one has none.

    tokenizer: a file every node can read. Windows begin every ``stride`` tokens; the last is the first that reaches the end.
    """
    if not 0 < stride <= window:
        raise ValueError("a stride of 1 to the size of a window is needed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        read = Tokenizer.from_file(tokenizer)
        read.encode_special_tokens = True
        for f in frames:
            for key, text in zip(f["id"], f["text"], strict=True):
                if isinstance(text, str):
                    parts = list(_windows(text, read, window, stride))
                    yield pd.DataFrame({"id": [key] * len(parts), "window_no": range(len(parts)), "text": parts})

    schema = StructType([docs.schema["id"]]).add("window_no", "integer").add("text", "string")
    return spread(docs.select("id", "text"), "id").mapInPandas(run, schema)


def _windows(text: str, read, window: int, stride: int) -> Iterator[str]:
    ids = read.encode(text, add_special_tokens=False).ids
    if len(ids) <= window:
        yield text
        return
    for start in range(0, len(ids), stride):
        yield read.decode(ids[start : start + window], skip_special_tokens=False)
        if start + window >= len(ids):
            break

