"""Exact dense search over all rows, as a grid of blocks (RET-1..4, 18, 20, 21, 23).

Queries and documents are dealt out by hash into blocks of a bounded number of
rows; each pair of blocks meets in one group, where scores are matrix products.
Nothing is collected, both sides are read once, and a task holds one block of
either side, whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quern.session import tasks

#: Rows of a block of either side; documents a block has at least if it is not the only one; queries and documents multiplied at once.
BLOCK_ROWS, LEAST_ROWS = 50_000, 500
CHUNK_QUERIES, CHUNK_DOCS = 1_024, 4_096


def grid(queries: DataFrame, docs: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """run(queries, documents) of every pair of a block of queries (query_id, ...) and a block of documents (id, ...)."""
    n_queries, n_docs = queries.count(), docs.count()
    across = -(-n_queries // block_rows) or 1
    down = max(-(-n_docs // block_rows), min(tasks(docs.sparkSession), n_docs // LEAST_ROWS)) or 1

    n = min(across * down, tasks(docs.sparkSession))  # said outright: by size these shuffles would be put together, though what follows is heavy

    def dealt(rows: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        at = F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int")
        copies = rows.select("*", at.alias(own[0]), F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0]))
        return copies.repartition(n, "block_d", "block_q")

    q = dealt(queries, "query_id", ("block_q", across), ("block_d", down))
    d = dealt(docs, "id", ("block_d", down), ("block_q", across))
    return q.groupBy("block_d", "block_q").cogroup(d.groupBy("block_d", "block_q")).applyInArrow(run, schema)


def arrow_type(t: DataType) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32()}.get(t.typeName(), pa.string())


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, query) places of the k best scores of each query (documents by queries); ties with the k-th are kept, minus infinity is not."""
    n = min(k, len(scores))
    least = np.partition(scores, len(scores) - n, axis=0)[len(scores) - n]
    return np.nonzero((scores >= least) & np.isfinite(scores))


class Best:
    """The k best documents of each query over many blocks of scores, ties with the k-th kept; held as places, cut whenever it has doubled."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.room = k, max(2 * k * n_queries, 100_000)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, first_doc: int, first_query: int) -> None:
        """scores: documents by queries, minus infinity where there is none."""
        doc, query = best_of(scores, self.k)
        self.parts.append(((query + first_query).astype(np.int32), (doc + first_doc).astype(np.int32), scores[doc, query]))
        self.size += len(doc)
        if self.size > self.room:
            self.parts = [self.cut()]
            self.size = len(self.parts[0][0])
            self.room = max(self.room, 2 * self.size)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) places of what is left."""
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        query, doc, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, query))
        query, doc, score = query[order], doc[order], score[order]
        start = np.searchsorted(query, query)  # where each query begins
        bar = score[np.minimum(start + self.k - 1, np.searchsorted(query, query, side="right") - 1)]
        keep = score >= bar
        return query[keep], doc[keep], score[keep]

    def table(self, names: list, ids: list, query_type: pa.DataType, id_type: pa.DataType) -> pa.Table:
        query, doc, score = self.cut()
        columns = [pa.array(names, query_type).take(pa.array(query)), pa.array(ids, id_type).take(pa.array(doc)), pa.array(score, pa.float64())]
        return pa.table(columns, ["query_id", "id", "score"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    dim = len(whole[0]) if len(whole) else 0
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _chunks(n: int, size: int) -> list[slice]:
    return [slice(a, min(n, a + size)) for a in range(0, n, size)]


def _score(k: int, floor: float | None, digits: int, id_type: pa.DataType, query_type: pa.DataType, skip_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        best = Best(k, queries.num_rows)
        ids, names = docs["id"].to_pylist(), queries["query_id"].to_pylist()
        if ids and names:
            x, q = _matrix(docs["vector"]), _matrix(queries["vector"])
            bias = docs["bias"].to_numpy()
            place = {v: i for i, v in enumerate(ids)} if skip_self else {}
            own = np.array([place.get(v, -1) for v in names])
            for qs in _chunks(len(q), CHUNK_QUERIES):
                for ds in _chunks(len(x), CHUNK_DOCS):
                    s = np.round(x[ds] @ q[qs].T + bias[ds, None], digits)  # documents by queries
                    mine = np.flatnonzero((own[qs] >= ds.start) & (own[qs] < ds.stop))
                    s[own[qs][mine] - ds.start, mine] = -np.inf
                    if floor is not None:
                        s[~(s > floor)] = -np.inf
                    best.add(s, ds.start, qs.start)
        return best.table(names, ids, query_type, id_type)

    return run


def scored(queries: DataFrame, docs: DataFrame, k: int, floor: float | None = 0.0, digits: int = 6, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score): of every block of documents, what may be among the k best of a query.

    queries (query_id, vector), docs (id, vector, bias).
    """
    query_kind, id_kind = queries.schema["query_id"].dataType, docs.schema["id"].dataType
    run = _score(k, floor, digits, arrow_type(id_kind), arrow_type(query_kind), skip_self)
    return grid(queries.select("query_id", "vector"), docs.select("id", "vector", "bias"), run, f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, score double")


def ranked(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best by score, then id; rank_no from 1."""
    w = W.partitionBy(by).orderBy(F.col("score").desc(), F.col("id").asc())
    return scores.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k).withColumn("rank_no", F.col("rank_no").cast("bigint"))


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = 10, floor: float | None = 0.0, bias: Column | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank_no). A bias is added to each score; the floor then no longer applies."""
    held = docs.withColumn("bias", F.lit(0.0) if bias is None else bias.cast("double"))
    return ranked(scored(queries, held, k, None if bias is not None else floor, skip_self=skip_self), k)


def multi_view_topk(queries: DataFrame, docs: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """Best weighted view of each document; docs (id, view_name, vector). Views of weight 0 are not read."""
    parts = None
    for view, weight in sorted(weights.items()):
        if weight == 0:
            continue
        rows = docs.where(F.col("view_name") == view).select("id", F.transform("vector", lambda x: x.cast("double") * weight).alias("vector"), F.lit(0.0).alias("bias"))
        part = ranked(scored(queries, rows, k), k).withColumn("view_name", F.lit(view))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max_by("view_name", F.struct("score", "view_name")).alias("best_view"))
    return ranked(best, k)


def optimistic_ranks(queries: DataFrame, docs: DataFrame, answers: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, id, best_rank): 1 + the number of other documents with a strictly greater score than the known answer (query_id, id).

    Documents are counted block by block; only counts leave the tasks.
    """
    from quern.functions.vectors import dot

    own = answers.join(docs.select("id", F.col("vector").alias("v")), "id").join(queries, "query_id").select("query_id", "vector", F.round(dot(F.col("v"), F.col("vector")), digits).alias("own"))
    kind = queries.schema["query_id"].dataType
    query_type = arrow_type(kind)

    def counting(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = asked["query_id"].to_pylist()
        better = np.zeros(len(names), np.int64)
        if len(names) and held.num_rows:
            x, q, bar = _matrix(held["vector"]), _matrix(asked["vector"]), asked["own"].to_numpy()
            place = {v: i for i, v in enumerate(held["id"].to_pylist())}
            for qs in _chunks(len(q), CHUNK_QUERIES):
                for ds in _chunks(len(x), CHUNK_DOCS):
                    better[qs] += (np.round(x[ds] @ q[qs].T, digits) > bar[None, qs]).sum(0)
            for j, name in enumerate(names):
                i = place.get(name)
                better[j] -= i is not None and np.round(x[i] @ q[j], digits) > bar[j]
        return pa.table([pa.array(names, query_type), pa.array(better)], ["query_id", "better"])

    out = grid(own, docs.select("id", "vector"), counting, f"query_id {kind.simpleString()}, better bigint")
    counts = out.groupBy("query_id").agg((F.sum("better") + 1).alias("best_rank"))
    return answers.select("query_id", "id").join(counts, "query_id")


def adaptive(queries: DataFrame, docs: DataFrame, low: float = 0.01, k: int = 10, floor: float | None = 0.0, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank_no) by the vectors, and for queries of a low margin by the mean over both passes.

    queries (query_id, vector, second), docs (id, vector, second). The mean over all
    documents is one product of the vectors set one behind the other, so a second pass
    sees every document, whatever the first put on its list; a query without two hits keeps the first pass.
    """
    from quern.operators.hits import margins

    rows = docs.withColumn("bias", F.lit(0.0))
    first = ranked(scored(queries, rows, k + 1, floor, skip_self=skip_self), max(k, 2))
    unsure = margins(first.where("rank_no <= 2")).where(F.col("margin") < low).select("query_id")
    kept = first.where(F.col("rank_no") <= k).join(unsure, "query_id", "left_anti").select("query_id", "id", "score", "rank_no")
    asked = queries.join(unsure, "query_id", "left_semi").select("query_id", F.concat(F.transform("vector", lambda x: x * 0.5), F.transform("second", lambda x: x * 0.5)).alias("vector"))
    both = rows.select("id", F.concat("vector", "second").alias("vector"), "bias")
    return kept.unionByName(ranked(scored(asked, both, k, floor, skip_self=skip_self), k))
