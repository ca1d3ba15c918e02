"""Term statistics and BM25 over postings (AGG-6, RET-5, 11)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.dense import Best, arrow_type, grid, ranked
from quern.session import checkpoint, spread

K1, B = 1.2, 0.75
MOST_TERMS = 64
#: Documents and queries weighed together.
BATCH_DOCS, CHUNK_QUERIES = 128, 512


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, text)."""
    return docs.select("id", F.explode(T.index_terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., term, n): the number of documents that hold a term."""
    by = by or []
    return docs.select(*by, F.explode(F.array_distinct(T.index_terms(F.col("text")))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(n_docs: Column, n: Column) -> Column:
    """max(0, ln(1 + (N - n + 0.5) / (n + 0.5)))."""
    return F.greatest(F.lit(0.0), F.ln(1 + (n_docs - n + 0.5) / (n + 0.5)))


def _weigh(k: int, avgdl: float, digits: int, id_type: pa.DataType, query_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        best = Best(k, queries.num_rows)
        names, ids = queries["query_id"].to_pylist(), docs["id"].to_pylist()
        if len(names) and len(ids):
            asked = queries["terms"].combine_chunks()
            of = np.repeat(np.arange(len(asked)), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            coded = pc.dictionary_encode(asked.flatten())
            known = {t: j for j, t in enumerate(coded.dictionary.to_pylist())}
            term, weight = coded.indices.to_numpy(), queries["idf"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(term, kind="stable")
            term, weight, of = term[order], weight[order], of[order]
            first = np.searchsorted(term, np.arange(len(known) + 1))
            for lo in range(0, len(ids), BATCH_DOCS):
                held = docs["terms"].slice(lo, BATCH_DOCS).combine_chunks()
                length = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                words = pc.dictionary_encode(held.flatten())
                code = np.array([known.get(t, -1) for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(length)), length)[code >= 0]
                pair, tf = np.unique(doc * (len(known) + 1) + code[code >= 0], return_counts=True)
                doc, code = pair // (len(known) + 1), pair % (len(known) + 1)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / avgdl))
                used, at = np.unique(code, return_inverse=True)
                by_doc = np.zeros((len(length), len(used)))
                by_doc[doc, at] = part
                for qs in range(0, len(names), CHUNK_QUERIES):
                    by_query = np.zeros((len(used), min(CHUNK_QUERIES, len(names) - qs)))
                    for row, t in enumerate(used):
                        at_term = slice(first[t], first[t + 1])
                        mine = (of[at_term] >= qs) & (of[at_term] < qs + CHUNK_QUERIES)
                        by_query[row, of[at_term][mine] - qs] = weight[at_term][mine]
                    s = np.round(by_doc @ by_query, digits)
                    s[s <= 0] = -np.inf
                    best.add(s, lo, qs)
        return best.table(names, ids, query_type, id_type)

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, searched: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank_no): BM25 of docs (id, text) for queries (query_id, text).

    Statistics cover all documents; ``searched`` (id) may name those that can be
    hits. A query is the set of its first 64 search terms; a document that holds
    none of them is no hit. The inverse frequencies of the queries' terms are
    joined to the queries; blocks of queries and of documents, tokenised once, meet
    in a grid, and of each pair of blocks only what may be among the k best leaves it.
    """
    from quern.functions import queries as Q

    asked = queries.select("query_id", F.slice(Q.search_terms(T.content_tokens(F.col("text"))), 1, MOST_TERMS).alias("terms"))
    words = checkpoint(spread(docs.select("id", "text"), "id").select("id", T.index_terms(F.col("text")).alias("terms")))  # three things are read from it
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()
    wanted = asked.select("query_id", F.explode("terms").alias("term"))
    held = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    frequency = held.join(wanted.select("term").distinct(), "term", "left_semi")
    idf = F.ln((stats["n"] - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    weighed = wanted.join(frequency, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("t"))  # at most 64 terms a query
    pool = words if searched is None else words.join(searched.select("id"), "id", "left_semi")
    query_kind, id_kind = queries.schema["query_id"].dataType, docs.schema["id"].dataType
    run = _weigh(k, stats["avgdl"] or 1.0, digits, arrow_type(id_kind), arrow_type(query_kind))
    schema = f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, score double"
    return ranked(grid(weighed.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), pool, run, schema), k)
