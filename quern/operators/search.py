"""Ranked search from question to hits, and the answer to a question about code lines (RET-8, 9, 18, LEX-7)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import queries as Q
from quern.functions import text as T
from quern.operators import dense, fuse, lexical, lineage, rerank, sparse
from quern.operators.encode import Encoder, HashingEncoder


@dataclass(frozen=True)
class SearchConfig:
    """Which arms a search has and how far each goes; the plan is chosen when it is built."""

    use_dense: bool = True
    use_sparse: bool = True
    shortlist: int = 100
    top_k: int = 10
    sparse_weight: float = 0.15
    fusion_k: int = 60
    question: Q.QuestionConfig = field(default_factory=Q.QuestionConfig)
    rerank: rerank.Weights = field(default_factory=rerank.Weights)
    hub_beta: float = 0.0
    include_tests: bool = True
    corpus_kind: str = ""
    view_weights: dict[str, float] | None = None
    newest: bool = False

    @classmethod
    def lexical_only(cls) -> SearchConfig:
        return cls(use_dense=False, rerank=rerank.Weights.off())

    @classmethod
    def dense_only(cls) -> SearchConfig:
        return cls(use_sparse=False, rerank=rerank.Weights.off())

    @classmethod
    def shipped(cls) -> SearchConfig:
        """Dense only, over the views of code (RET-9)."""
        return cls(use_sparse=False, rerank=rerank.Weights.off(), view_weights={"code": 1.0, "nl": 0.0, "raw": 1.0})

    def without_rerank(self) -> SearchConfig:
        return replace(self, rerank=rerank.Weights.off())


def search(docs: DataFrame, questions: DataFrame, config: SearchConfig = SearchConfig(), encoder: Encoder | None = None, hubs: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank_no) of docs (id, text, and category and identifiers for reranking) for questions (query_id, text).

    The arms' lists are cut to the shortlist, fused, cut again, reranked and cut to
    top_k; where tests are left out, four times as many are ranked before. All
    questions go through one plan. A question no arm answers has no rows. With view
    weights the dense arm takes the best weighted view of views (id, view_name, text).
    """
    rows: DataFrame | None = None
    held: dict[str, DataFrame] = {}
    for stage, run in _stages(docs, questions, config, encoder or HashingEncoder(), hubs, views):
        held[stage] = rows = run(held)
    return rows


Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def _stages(docs: DataFrame, questions: DataFrame, config: SearchConfig, encoder: Encoder, hubs: DataFrame | None, views: DataFrame | None) -> list[Stage]:
    """The stages of a search in their order: a name, and what it makes of the stages before it."""
    texts = docs.select("id", "text")
    arms: list[Stage] = []
    if config.use_dense:
        if config.view_weights is not None and (views is None or hubs is not None and config.hub_beta):
            raise ValueError("view weights need views, and no hubs")

        def by_vectors(_: dict[str, DataFrame]) -> DataFrame:
            vectors = texts.select("id", encoder.column(F.col("text")).alias("vector"))
            asked = questions.select("query_id", encoder.column(F.col("text")).alias("vector"))
            bias: Column | None = None
            if hubs is not None and config.hub_beta:
                vectors = vectors.join(hubs, "id", "left")
                bias = -config.hub_beta * F.coalesce("hub", F.raise_error(F.lit("an indexed document has no hub")).cast("double"))
            if config.view_weights is not None:
                seen = views.select("id", "view_name", encoder.column(F.col("text")).alias("vector"))
                return dense.multi_view_topk(asked, seen, config.view_weights, config.shortlist)
            return dense.dense_topk(asked, vectors, config.shortlist, bias=bias)

        arms.append(("dense", by_vectors))
    if config.use_sparse:
        arms.append(("sparse", lambda _: sparse.bm25(texts, questions, config.shortlist)))
    if not arms:
        raise ValueError("a search needs an arm")
    out = list(arms)
    short = arms[0][0]
    if len(arms) > 1:
        short = "fused"
        out.append((short, lambda held: fuse.fused([held["dense"], held["sparse"]], config.fusion_k, [1.0, config.sparse_weight], config.shortlist)))
    wanted = config.top_k if config.include_tests else 4 * config.top_k
    if config.rerank.enabled:
        out.append(("reranked", lambda held: _reranked(held[short], docs, questions, config, wanted)))
    else:
        out.append(("cut", lambda held: dense.ranked(held[short].select("query_id", "id", "score"), wanted)))
    if not config.include_tests:
        from quern.operators.hits import without_tests

        last = out[-1][0]
        out.append(("without tests", lambda held: without_tests(held[last], config.top_k)))
    return out


def explained(docs: DataFrame, questions: DataFrame, config: SearchConfig = SearchConfig(), encoder: Encoder | None = None, hubs: DataFrame | None = None, views: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """A search stage by stage: its hits, (stage, seconds, hits, questions) in order, and notes on arms that are off or left questions without hits.

    Every stage is written before the next one starts, so that its time is its own.
    """
    from quern.session import checkpoint

    spark = docs.sparkSession
    held: dict[str, DataFrame] = {}
    report, notes = [], [f"the {arm} arm is off" for arm, on in (("dense", config.use_dense), ("sparse", config.use_sparse)) if not on]
    asked = questions.select("query_id").distinct().count()
    if config.hub_beta and hubs is None:
        notes.append("no hubs were given: the correction is off")
    for stage, run in _stages(docs, questions, config, encoder or HashingEncoder(), hubs, views):
        began = time.perf_counter()
        held[stage] = checkpoint(run(held))
        n = held[stage].agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("questions")).first()
        report.append((len(report), stage, time.perf_counter() - began, n["hits"], n["questions"]))
        if n["questions"] < asked:
            notes.append(f"{stage}: {asked - n['questions']} of {asked} questions without hits")
    return held[report[-1][1]], spark.createDataFrame(report, "place int, stage string, seconds double, hits bigint, questions bigint"), notes


def search_versions(docs: DataFrame, questions: DataFrame, versions: DataFrame, config: SearchConfig = SearchConfig(), encoder: Encoder | None = None, views: DataFrame | None = None) -> DataFrame:
    """(query_id, lineage, id, version, score, versions, rank_no): ``search`` over all versions, collapsed by lineage.

    docs (id, version, h, text, ...) with h the hash of the content, views (id,
    version, view_name, text), versions (version, ord). Every row is a document of
    its own; the ranking before the collapse is as many times longer as there are versions.
    """
    key = F.to_json(F.struct("id", "version"))
    n = max(1, versions.count())
    deep = replace(config, include_tests=True, top_k=config.top_k * n * (1 if config.include_tests else 4), shortlist=max(config.shortlist, 10 * config.top_k) * n)
    keyed = docs.withColumn("id", key).drop("version", "h")
    hits = search(keyed, questions, deep, encoder, views=None if views is None else views.withColumn("id", key).drop("version"))
    k = F.from_json("id", "id string, version string")
    found = hits.select("query_id", k.alias("k"), "score").select("query_id", "k.id", "k.version", "score")
    if not config.include_tests:
        found = found.where(~T.is_test_path(F.split_part("id", F.lit("::"), F.lit(1))))
    members = lineage.lineage_keys(docs.select("id", "version", "h")).join(versions.select("version", "ord"), "version")
    return lineage.collapsed(found, members, config.top_k, config.newest).select("query_id", "lineage", "id", "version", "score", "versions", "rank_no")


def _reranked(short: DataFrame, docs: DataFrame, questions: DataFrame, config: SearchConfig, k: int) -> DataFrame:
    p = questions.select("query_id", Q.processed(F.col("text"), config.question).alias("p")).select("query_id", "p.tokens", "p.category", "p.identifiers")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = rerank.term_weights(sparse.document_frequency(docs.select("id", "text")), n)
    feats = rerank.features(short.select("query_id", "id", "rank_no"), docs.select("id", "text"), p.select("query_id", F.col("tokens").alias("terms")), idf, config.rerank)
    have = docs.columns
    about = docs.select(
        "id", F.length("text").alias("length"), (F.col("category") if "category" in have else F.lit("")).alias("doc_category"),
        (F.col("identifiers") if "identifiers" in have else F.array().cast("array<string>")).alias("doc_identifiers"),
    )
    rows = feats.join(about, "id").join(p.withColumnRenamed("identifiers", "asked"), "query_id")
    lower = F.transform("doc_identifiers", F.lower)
    adjust = rerank.structural(F.col("category"), F.col("doc_category"), lower, F.col("asked"), F.col("tokens"), F.col("length"), config.corpus_kind, config.rerank)
    return rerank.reranked(rows, adjust, k, config.rerank)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, n): how many hits each stage of a search left."""
    out = None
    for name, rows in stages.items():
        part = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select("query_id", F.lit(name).alias("stage"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def answer(snippets: DataFrame, question: str, config: SearchConfig = SearchConfig()) -> tuple[str, DataFrame]:
    """The kind of a question and its answer: lines for usage, callers, definition and order, else a ranked search; snippets (id, content)."""
    spark = snippets.sparkSession
    r = lexical.routed(spark.createDataFrame([(question,)], "question string")).first()
    if r["kind"] is not None:
        vocab = lexical.vocabulary(snippets)
        wanted = [p for p in (r["phrase"], r["second"]) if p]
        found = {x["phrase"]: x["name"] for x in lexical.resolve(vocab, spark.createDataFrame([(p,) for p in wanted], "phrase string")).where("place = 1").collect()}
        names = [found.get(p) for p in wanted]
        if all(names):
            if r["kind"] == "order":
                a, b = names if r["order"] == "before" else names[::-1]
                return "order", lexical.calls_before(snippets, a, b)
            return r["kind"], {"usage": lexical.uses, "callers": lexical.callers, "definition": lexical.definitions}[r["kind"]](snippets, names[0])
    docs = snippets.select("id", F.col("content").alias("text"))
    return "search", search(docs, spark.createDataFrame([("q", question)], "query_id string, text string"), config)
