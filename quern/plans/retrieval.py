"""Registered queries over vectors, rankings and their evaluation.

Queries are the rows of ``embeddings`` whose id is divisible by 20, held against
all rows; a row with the same label is a right answer. Question texts are the
held-out items, held against all documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import dense, fuse, hits, hub, metrics, rerank, sparse, stats
from quern.plans import sql
from quern.session import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _docs(spark, d):
    return _vectors(spark, d).select("id", "vector")


def _run(spark, d, k=10):
    return dense.dense_topk(_queries(spark, d), _docs(spark, d), k, skip_self=True)


def _qrels(spark, d):
    v = _vectors(spark, d).select("id", "label")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label")
    return q.join(v, "label").where("id <> query_id").select("query_id", "id", F.lit(1).alias("rel"))


def dense_topk(spark, d):
    return _run(spark, d)


def dense_views(spark, d):
    """Two views: the vectors as they are, and their first half alone."""
    v = _docs(spark, d)
    half = v.select("id", F.transform("vector", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0))).alias("vector"), F.lit("half").alias("view_name"))
    both = v.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.lit("whole").alias("view_name")).unionByName(half)
    return dense.multi_view_topk(_queries(spark, d), both, {"whole": 1.0, "half": 1.5, "none": 0.0})


def eval_per_query(spark, d):
    return metrics.per_query(_run(spark, d), _qrels(spark, d))


def eval_mean(spark, d):
    return metrics.means(metrics.per_query(_run(spark, d), _qrels(spark, d)))


def confidence_labels(spark, d):
    c = hits.confidence(_run(spark, d))
    return c.select("query_id", F.round("margin", 6).alias("margin"), "label")


def _answer_ranks(spark, d):
    run = _run(spark, d, 100).join(_qrels(spark, d), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank_no").alias("rank_no"))
    return _queries(spark, d).select("query_id").join(run, "query_id", "left")


def confidence_summary(spark, d):
    return metrics.label_summary(hits.confidence(_run(spark, d)).join(_answer_ranks(spark, d), "query_id"))


def rank_summary(spark, d):
    return metrics.rank_summary(_answer_ranks(spark, d))


def rank_buckets(spark, d):
    return _answer_ranks(spark, d).groupBy(metrics.rank_bucket(F.col("rank_no")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def confidence_deciles(spark, d):
    rows = hits.margins(_run(spark, d)).join(_answer_ranks(spark, d), "query_id").select("query_id", F.round("margin", 6).alias("margin"), F.coalesce(F.col("rank_no") == 1, F.lit(False)).alias("hit"))
    return metrics.deciles(rows, "margin", "hit")


def hub_scores(spark, d):
    return hub.hub_scores(_docs(spark, d), _queries(spark, d), 5)


def hub_scores_excluding(spark, d):
    own = _qrels(spark, d).select("id", "query_id")
    return hub.hub_scores(_docs(spark, d), _queries(spark, d), 3, own)


def doc_doc_hub(spark, d):
    return hub.document_hubs(_docs(spark, d), 5)


def hub_penalised_topk(spark, d):
    return hub.penalised_topk(_queries(spark, d), _docs(spark, d), hub_scores(spark, d), 0.75)


def hub_extended_topk(spark, d):
    """The same ranking by one more component of the vectors."""
    docs = hub.extended_documents(_docs(spark, d), hub_scores(spark, d), 0.75)
    return dense.dense_topk(hub.extended_queries(_queries(spark, d)), docs, 10, None)


def hub_sweep(spark, d):
    return hub.sweep(_queries(spark, d), _docs(spark, d), _queries(spark, d), [1, 5], [0.5, 1.0], 5)


def rknn_counts(spark, d):
    return hub.reverse_neighbour_counts(_docs(spark, d), 5)


def centroid_z(spark, d):
    z = hub.zscores(hub.centroid_similarity(_docs(spark, d)), "similarity")
    return z.select("id", "similarity", "z")


def separation_auc(spark, d):
    rows = hub.centroid_similarity(_docs(spark, d)).join(_vectors(spark, d), "id").select(F.col("similarity").alias("score"), (F.col("label") < 5).alias("group"))
    return hub.separation_auc(rows)


def hub_share(spark, d):
    first = _run(spark, d, 1).join(_qrels(spark, d), ["query_id", "id"], "left_anti")
    s = hub.hub_share(first.select("id"), 2)
    return s.select(F.round("share", 6).alias("share"), "top_hub")


def hub_table(spark, d):
    """Documents and vectors are paired by number: the hubs of the vectors by the text they are paired with."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    return hub.hub_table(docs, hub_scores(spark, d))


def _halves(spark, d):
    """Rankings by the first and by the second half of the components."""
    def half(c, first):
        return F.transform(c, lambda x, i: F.when((i < 32) == F.lit(first), x.cast("double")).otherwise(F.lit(0.0)))

    q, v = _queries(spark, d), _docs(spark, d)
    return [dense.dense_topk(q.select("query_id", half("vector", f).alias("vector")), v.select("id", half("vector", f).alias("vector")), 20, skip_self=True) for f in (True, False)]


def rrf_fuse(spark, d):
    return fuse.fused(_halves(spark, d), 60, [1.0, 0.5], 10)


def adaptive_second_pass(spark, d):
    """The first half of the components, and the mean with the second half where the first leaves little margin."""
    def halves(rows, key):
        part = lambda a, n: F.transform(F.slice("vector", a, n), lambda x: x.cast("double"))
        return rows.select(key, part(1, 32).alias("vector"), part(33, 32).alias("second"))

    return dense.adaptive(halves(_queries(spark, d), "query_id"), halves(_docs(spark, d), "id"), 0.02, skip_self=True)


def optimistic_rank(spark, d):
    first = _qrels(spark, d).groupBy("query_id").agg(F.min("id").alias("id"))
    return dense.optimistic_ranks(_queries(spark, d), _docs(spark, d), first)


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")


def _statements(spark, d):
    return table(spark, d, "eval_items").groupBy(F.col("item_id").alias("query_id")).agg(F.max("text").alias("text")).where("text IS NOT NULL")


def doc_freq(spark, d):
    return sparse.document_frequency(_texts(spark, d))


def idf(spark, d):
    docs = _texts(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rerank.term_weights(sparse.document_frequency(docs), n)


def bm25_topk(spark, d):
    return sparse.bm25(_texts(spark, d), _statements(spark, d), 10)


def _features(spark, d):
    docs, q = _texts(spark, d), _statements(spark, d)
    terms = q.select("query_id", T.content_tokens(F.col("text")).alias("terms"))
    return rerank.features(sparse.bm25(docs, q, 20).select("query_id", "id", "rank_no"), docs, terms, idf(spark, d))


def rerank_features(spark, d):
    return _features(spark, d).select("query_id", "id", "coverage", F.round("idf_coverage", 4).alias("idf_coverage"), "phrase", "proximity", "head", "interaction")


def rerank_topk(spark, d):
    return rerank.reranked(_features(spark, d))


def rankings_csv(spark, d):
    from quern.sources.records import ranking_rows

    return ranking_rows(_run(spark, d)).select(F.col("query_id").cast("string").alias("query_id"), F.col("corpus_id").cast("string").alias("corpus_id"), "rank", "score")


def prediction_ranks(spark, d):
    """Rankings of stored predictions, ties from the end of the alphabet."""
    from quern.sources.records import prediction_ranks as ranks

    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    return ranks(rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score")), 10)


def file_ranks(spark, d):
    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    best = rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score"))
    return hits.file_ranks(dense.ranked(best, 100))


def hits_without_tests(spark, d):
    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    best = rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score"))
    return hits.without_tests(dense.ranked(best, 40), 10)


def normalised_vectors(spark, d):
    rows = table(spark, d, "vectors").where("vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)")
    return rows.select("hash", "view_name", F.round(V.norm(F.col("vector")), 4).alias("size"), F.round(V.norm(V.normalised(F.col("vector"))), 4).alias("after"))


def percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    return metrics.nearest_rank(e, "value", [0.5, 0.95, 0.99], ["event_type"])


def quartiles(spark, d):
    return metrics.quartiles(table(spark, d, "events"), "value", ["event_type"])


def terciles(spark, d):
    e = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("double").alias("size"))
    return metrics.terciles(e, [F.col("size"), F.col("doc_id")], "size")


def bands(spark, d):
    e = table(spark, d, "documents").where("text IS NOT NULL").select(F.length("text").alias("size"), F.size(T.words(F.col("text"))).cast("double").alias("n_words"))
    return metrics.bands(e, "size", [0, 200, 500, 1000, 2000, 100000], "n_words")


def _systems(spark, d):
    """NDCG of three rankings: whole vectors and either half."""
    q = _qrels(spark, d)
    out = metrics.per_query(_run(spark, d), q).select(F.lit("whole").alias("system"), "query_id", F.col("ndcg").alias("score"))
    for name, run in zip(("first", "second"), _halves(spark, d), strict=True):
        out = out.unionByName(metrics.per_query(run, q).select(F.lit(name).alias("system"), "query_id", F.col("ndcg").alias("score")))
    return out


def _numbers(spark, d):
    """Scores that both engines have to the last digit: a document's length by a system of two shapes."""
    e = table(spark, d, "eval_items").groupBy("item_id").agg(F.max("text").alias("text")).where("text IS NOT NULL")
    a = e.select(F.lit("length").alias("system"), F.col("item_id").alias("query_id"), F.length("text").cast("double").alias("score"))
    b = e.select(F.lit("words").alias("system"), F.col("item_id").alias("query_id"), (F.size(T.words(F.col("text"))) * 6.0).alias("score"))
    return a.unionByName(b)


def bootstrap_ci(spark, d):
    return stats.bootstrap(_numbers(spark, d), 100)


def paired_bootstrap(spark, d):
    return stats.paired(_numbers(spark, d), "length", "words", 100)


def compare_systems(spark, d):
    from quern.session import checkpoint

    return stats.compare_all(checkpoint(_systems(spark, d)), ["whole", "first", "second"], 100)


def bootstrap_generator(spark, d):
    return stats.bootstrap_generator(_systems(spark, d), 200)


def kendall_tau(spark, d):
    from pyspark.sql import Window as W

    g = table(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return stats.kendall_tau(g.select("id", F.row_number().over(W.orderBy("n", "id")).alias("a"), F.row_number().over(W.orderBy("v", "id")).alias("b")))


def stratified_sample(spark, d):
    return stats.stratified_sample(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), "text"), 100)


def hashed_sample(spark, d):
    return stats.hashed_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


def validated_sample(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(F.round(F.avg("value"), 6).alias("score"))
    s = table(spark, d, "events").where("event_id % 2 = 0").groupBy(F.col("event_type").alias("system")).agg(F.round(F.avg("value"), 6).alias("score"))
    return stats.validated(e, s, 5.0)


def watch_heads(spark, d):
    from quern.streaming.watch import head_changes

    e = table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("ts").alias("at"), F.col("event_type").alias("head"))
    return head_changes(e)


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_views, eval_per_query, eval_mean, confidence_labels, confidence_summary, rank_summary, rank_buckets, confidence_deciles, hub_scores,
        hub_scores_excluding, doc_doc_hub, hub_penalised_topk, hub_extended_topk, hub_sweep, rknn_counts, centroid_z, separation_auc, hub_share, hub_table, rrf_fuse,
        adaptive_second_pass, optimistic_rank, doc_freq, idf, bm25_topk, rerank_features, rerank_topk, rankings_csv, prediction_ranks, file_ranks, hits_without_tests,
        normalised_vectors, percentiles, quartiles, terciles, bands, bootstrap_ci, paired_bootstrap, compare_systems, bootstrap_generator, kendall_tau, stratified_sample,
        hashed_sample, validated_sample, watch_heads,
    )
}

_DOT = sql.dot("q.embedding", "v.embedding")
_PAIRS = f"pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 6) AS score, q.label = v.label AS good FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"


def _top(source: str, k: int, by: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id) AS rank_no FROM {source}) WHERE rank_no <= {k})"


_RUN = f"WITH {_PAIRS}, run AS {_top('(SELECT * FROM pairs WHERE score > 0)', 10)}, run100 AS {_top('(SELECT * FROM pairs WHERE score > 0)', 100)}"
_RANKS = (
    _RUN
    + """, ranks AS (SELECT q.query_id, r.rank_no FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0) q
      LEFT JOIN (SELECT query_id, min(rank_no) AS rank_no FROM run100 WHERE good GROUP BY 1) r USING (query_id)),
      margins AS (SELECT query_id, max(score) FILTER (rank_no = 1) - max(score) FILTER (rank_no > 1) AS m FROM run GROUP BY 1),
      labels AS (SELECT query_id, round(coalesce(m, 0), 6) AS margin, CASE WHEN m IS NULL THEN 'medium' WHEN m >= 0.03 THEN 'high' WHEN m < 0.01 THEN 'low' ELSE 'medium' END AS label FROM margins)"""
)
_METRICS = (
    _RUN
    + """, rel AS (SELECT query_id, count(*) FILTER (good) AS n FROM pairs GROUP BY 1),
      ideal AS (SELECT query_id, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM rel),
      got AS (SELECT query_id, sum(CASE WHEN good THEN 1 / log2(rank_no + 1) ELSE 0 END) AS dcg, min(rank_no) FILTER (good) AS first, count(*) FILTER (good) AS found FROM run GROUP BY 1),
      m AS (SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(1.0 / first, 0), 6) AS rr_at_k, round(coalesce(found / n, 0), 6) AS recall FROM ideal LEFT JOIN got USING (query_id) WHERE n > 0)"""
)
_HUB = f"""WITH near AS (SELECT v.vec_id AS id, round({_DOT}, 6) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_DOT}, 6) DESC, q.vec_id) AS r
      FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0), hubs AS (SELECT id, round(avg(s), 6) AS hub FROM near WHERE r <= 5 GROUP BY 1)"""
_NEAR = f"""WITH near AS (SELECT v.vec_id AS doc, q.vec_id AS other, round({_DOT}, 6) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_DOT}, 6) DESC, q.vec_id) AS r
      FROM embeddings v JOIN embeddings q ON q.vec_id <> v.vec_id)"""
_PENALISED = _HUB + f""", pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT} - 0.75 * hub, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 JOIN hubs ON hubs.id = v.vec_id)
      SELECT query_id, id, score, rank_no FROM {_top("pairs", 10)}"""
_CENTRE = """WITH e AS (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS pos FROM embeddings),
      c AS (SELECT pos, avg(x) AS m FROM e GROUP BY 1), s AS (SELECT sqrt(sum(m * m)) AS size FROM c),
      sim AS (SELECT id, any_value(label) AS label, round(sum(x * m) / any_value(size), 6) AS similarity FROM e JOIN c USING (pos), s GROUP BY 1)"""


def _half(side: str) -> str:
    a, b = ("embedding[1:32]", "embedding[1:32]") if side == "first" else ("embedding[33:64]", "embedding[33:64]")
    inner = f"(SELECT q.vec_id AS query_id, v.vec_id AS id, round({sql.dot('q.' + a, 'v.' + b)}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"
    return _top(f"(SELECT * FROM {inner} WHERE score > 0)", 20)


_BEST = "best AS (SELECT query_id, h.id AS id, max(h.score) AS score FROM (SELECT query_id, unnest(hits) AS h FROM search_results) WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY 1, 2)"
_TERMS = f"""d AS (SELECT doc_id AS id, {sql.index_terms('text')} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT id, unnest(t) AS term FROM d)"""
_BM25 = f"""WITH {_TERMS}, tf AS (SELECT id, term, count(*) AS tf FROM p GROUP BY 1, 2), n AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
      s AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
      q0 AS (SELECT item_id AS query_id, list_filter(list_transform({sql.content_tokens('text')}, lambda y: regexp_replace(y, '[^a-z0-9_]', '', 'g')), lambda y: length(y) > 1) AS t FROM {sql.ITEMS} WHERE text IS NOT NULL),
      q AS (SELECT query_id, unnest(list_filter(t, lambda y, i: list_position(t, y) = i)[1:64]) AS term FROM q0),
      scores AS (SELECT query_id, id, round(sum(ln((n_docs - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.t) / avgdl))), 6) AS score
        FROM q JOIN tf USING (term) JOIN n USING (term) JOIN d USING (id), s GROUP BY 1, 2)"""
_NUMBERS = f"""v AS (SELECT 'length' AS system, item_id AS query_id, CAST(length(text) AS DOUBLE) AS score FROM {sql.ITEMS} WHERE text IS NOT NULL
      UNION ALL SELECT 'words', item_id, len({sql.words('text')}) * 6.0 FROM {sql.ITEMS} WHERE text IS NOT NULL)"""
_DRAWS = """p AS (SELECT system, score, row_number() OVER (PARTITION BY system ORDER BY query_id) - 1 AS place, count(*) OVER (PARTITION BY system) AS n FROM v),
      k AS (SELECT system, draw, n, CAST('0x' || substr(md5('0|' || draw || '|' || place), 1, 8) AS BIGINT) % n AS place FROM p, range(0, 100) r(draw)),
      means AS (SELECT k.system, draw, avg(score) AS mean FROM k JOIN p ON p.system = k.system AND p.place = k.place GROUP BY 1, 2),
      o AS (SELECT system, mean, row_number() OVER (PARTITION BY system ORDER BY mean, draw) - 1 AS place FROM means),
      ci AS (SELECT w.system, n, round(m, 6) AS mean, round(lo, 6) AS low, round(hi, 6) AS high FROM (SELECT system, count(*) AS n, avg(score) AS m FROM v GROUP BY 1) w
        JOIN (SELECT system, max(mean) FILTER (place = 2) AS lo, max(mean) FILTER (place = 97) AS hi FROM o GROUP BY 1) USING (system))"""

_FEATURES = _BM25 + f""", short AS {_top('scores', 20)},
      w AS (SELECT term, round(greatest(0, ln(1 + (n_docs - n + 0.5) / (n + 0.5))), 6) AS idf FROM n, s),
      q1 AS (SELECT item_id AS query_id, list_filter(c, lambda y, i: length(y) > 1 AND list_position(c, y) = i) AS q FROM (SELECT item_id, {sql.content_tokens('text')} AS c FROM {sql.ITEMS} WHERE text IS NOT NULL)),
      qt AS (SELECT query_id, unnest(q) AS term FROM q1), total AS (SELECT query_id, sum(coalesce(idf, 0)) AS total_t FROM qt LEFT JOIN w USING (term) GROUP BY 1),
      hit AS (SELECT s.query_id, s.id, sum(coalesce(idf, 0)) AS m, count(*) AS k FROM short s JOIN qt USING (query_id) JOIN tf ON tf.id = s.id AND tf.term = qt.term LEFT JOIN w ON w.term = qt.term GROUP BY 1, 2),
      grams AS (SELECT query_id, list_distinct(list_transform(range(1, len(q)), lambda i: q[i] || '_' || q[i + 1])) AS g FROM q1),
      heads AS (SELECT doc_id AS id, {sql.index_terms("array_to_string(regexp_split_to_array(text, chr(13) || chr(10) || '|[' || chr(10) || chr(11) || chr(12) || chr(13) || '" + chr(92) + "x{85}" + chr(92) + "x{2028}" + chr(92) + "x{2029}]')[1:6], chr(10))")} AS h FROM documents WHERE text IS NOT NULL),
      places AS (SELECT s.query_id, s.id, i, t[i] AS term FROM (SELECT s.query_id, s.id, d.t, unnest(range(1, len(d.t) + 1)) AS i FROM short s JOIN d ON d.id = s.id) s JOIN qt ON qt.query_id = s.query_id AND qt.term = s.t[s.i]),
      reach AS (SELECT query_id, id, i, min(last) AS oldest, count(*) AS terms FROM (SELECT a.query_id, a.id, a.i, b.term, max(b.i) AS last FROM places a JOIN places b ON a.query_id = b.query_id AND a.id = b.id AND b.i <= a.i GROUP BY ALL) GROUP BY ALL),
      near AS (SELECT r.query_id, r.id, count(*) AS n_places, min(i - oldest + 1) FILTER (terms = k) AS best, any_value(k) AS k FROM reach r JOIN hit USING (query_id, id) GROUP BY 1, 2),
      parts AS (SELECT s.query_id, s.id, s.rank_no, round(hit.k / len(q), 6) AS coverage, round(hit.m / CASE WHEN total_t = 0 THEN 1 ELSE total_t END, 6) AS idf_coverage,
        round(least(1.0, len(list_filter(list_transform(range(1, len(d.t)), lambda i: d.t[i] || '_' || d.t[i + 1]), lambda x: list_contains(g, x))) / 3.0), 6) AS phrase,
        round(CASE WHEN n_places = 1 THEN 1.0 WHEN near.k < 2 THEN 0.5 ELSE near.k / greatest(near.k, best) END, 6) AS proximity, round(len(list_intersect(q, h)) / len(q), 6) AS head
        FROM short s JOIN hit USING (query_id, id) JOIN near USING (query_id, id) JOIN q1 USING (query_id) JOIN total USING (query_id) JOIN d ON d.id = s.id JOIN grams USING (query_id) JOIN heads ON heads.id = s.id),
      feats AS (SELECT *, CAST(round(CAST(round(0.5 * coverage + idf_coverage + 0.35 * phrase + 0.25 * proximity + 0.3 * head, 9) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS interaction FROM parts)"""

ORACLES = {
    "dense_topk": _RUN + " SELECT query_id, id, score, rank_no FROM run",
    "dense_views": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 6) AS a, round(1.5 * {sql.dot('q.embedding[1:32]', 'v.embedding[1:32]')}, 6) AS b FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0),
      w AS (SELECT query_id, id, a AS score, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS r, 'whole' AS view FROM s WHERE a > 0),
      h AS (SELECT query_id, id, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS r, 'half' AS view FROM s WHERE b > 0),
      u AS (SELECT * FROM w WHERE r <= 10 UNION ALL SELECT * FROM h WHERE r <= 10), m AS (SELECT query_id, id, max(score) AS score, arg_max(view, (score, view)) AS best_view FROM u GROUP BY 1, 2)
      SELECT query_id, id, score, best_view, rank_no FROM {_top("m", 10)}""",
    "eval_per_query": _METRICS + " SELECT * FROM m",
    "eval_mean": _METRICS + " SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(avg(rr_at_k), 6) AS mrr_at_k, round(avg(recall), 6) AS recall FROM m",
    "confidence_labels": _RANKS + " SELECT * FROM labels",
    "confidence_summary": _RANKS + """ SELECT label, round(count(*) / (SELECT count(*) FROM labels), 6) AS share, round(avg(CASE WHEN rank_no = 1 THEN 1.0 ELSE 0 END), 6) AS top1,
      round(avg(CASE WHEN rank_no <= 10 THEN 1.0 ELSE 0 END), 6) AS top10 FROM labels JOIN ranks USING (query_id) GROUP BY 1""",
    "rank_summary": _RANKS + """ SELECT count(*) AS queries, round(avg(CASE WHEN rank_no <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank_no <= 3 THEN 1.0 ELSE 0 END), 6) AS top3,
      round(avg(CASE WHEN rank_no <= 10 THEN 1.0 ELSE 0 END), 6) AS top10, round(avg(coalesce(1.0 / rank_no, 0)), 6) AS mrr FROM ranks""",
    "rank_buckets": _RANKS + " SELECT CASE WHEN rank_no = 1 THEN '1' WHEN rank_no <= 10 THEN '2-10' WHEN rank_no <= 100 THEN '11-100' ELSE 'beyond' END AS bucket, count(*) AS n FROM ranks GROUP BY 1",
    "confidence_deciles": _RANKS + """, o AS (SELECT coalesce(rank_no = 1, false) AS hit, (row_number() OVER (ORDER BY margin DESC, query_id) - 1) // greatest(count(*) OVER () // 10, 1) AS decile FROM labels JOIN ranks USING (query_id))
      SELECT decile, count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM o WHERE decile < 10 GROUP BY 1""",
    "hub_scores": _HUB + " SELECT id, hub FROM hubs",
    "hub_scores_excluding": f"""WITH near AS (SELECT v.vec_id AS id, round({_DOT}, 6) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_DOT}, 6) DESC, q.vec_id) AS r
      FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND (q.label <> v.label OR q.vec_id = v.vec_id)) SELECT id, round(avg(s), 6) AS hub FROM near WHERE r <= 3 GROUP BY 1""",
    "doc_doc_hub": _NEAR + " SELECT doc AS id, round(avg(s), 6) AS hub FROM near WHERE r <= 5 GROUP BY 1",
    "hub_penalised_topk": _PENALISED,
    "hub_extended_topk": _PENALISED,
    "rknn_counts": _NEAR + " SELECT vec_id AS id, count(n.other) AS n FROM embeddings LEFT JOIN (SELECT other FROM near WHERE r <= 5) n ON n.other = vec_id GROUP BY 1",
    "centroid_z": _CENTRE + " SELECT id, similarity, round((similarity - avg(similarity) OVER ()) / stddev_pop(similarity) OVER (), 6) AS z FROM sim",
    "separation_auc": _CENTRE + """ SELECT round(sum(CASE WHEN a.similarity > b.similarity THEN 1.0 WHEN a.similarity = b.similarity THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
      FROM sim a JOIN sim b ON a.label < 5 AND b.label >= 5""",
    "hub_share": _RUN + """, c AS (SELECT id, count(*) AS n FROM run WHERE rank_no = 1 AND NOT good GROUP BY 1)
      SELECT round(coalesce(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 0), 6) AS share, arg_max(id, (n, id)) AS top_hub FROM c""",
    "hub_table": _HUB + """ SELECT sha256(text) AS text_hash, round(avg(hub), 6) AS hub, count(*) AS ids, max(hub) - min(hub) > 1e-6 AS conflicting FROM documents JOIN hubs ON doc_id = id WHERE text IS NOT NULL GROUP BY 1""",
    "hub_sweep": f"""WITH near AS (SELECT v.vec_id AS id, round({_DOT}, 6) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_DOT}, 6) DESC, q.vec_id) AS r FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0),
      hubs AS (SELECT k, id, round(avg(s), 6) AS hub FROM near, (VALUES (1), (5)) t(k) WHERE r <= k GROUP BY 1, 2),
      pairs AS (SELECT k, CAST(beta AS DOUBLE) AS beta, q.vec_id AS query_id, v.vec_id AS id, round({_DOT} - CAST(beta AS DOUBLE) * hub, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 JOIN hubs ON hubs.id = v.vec_id, (VALUES (0.5), (1.0)) b(beta))
      SELECT k, beta, query_id, id, score, rank_no FROM {_top("pairs", 5, "k, beta, query_id")}""",
    "adaptive_second_pass": f"""WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {sql.dot('q.embedding[1:32]', 'v.embedding[1:32]')} AS a, {sql.dot('q.embedding[33:64]', 'v.embedding[33:64]')} AS b FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
      r AS (SELECT query_id, round(a, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 6) DESC, id) AS n FROM pairs WHERE round(a, 6) > 0),
      m AS (SELECT query_id, max(s) FILTER (n = 1) - max(s) FILTER (n = 2) AS margin FROM r WHERE n <= 2 GROUP BY 1),
      scores AS (SELECT query_id, id, round(CASE WHEN margin < 0.02 THEN (a + b) / 2 ELSE a END, 6) AS score FROM pairs LEFT JOIN m USING (query_id))
      SELECT query_id, id, score, rank_no FROM {_top("(SELECT * FROM scores WHERE score > 0)", 10)}""",
    "validated_sample": """WITH f AS (SELECT event_type AS system, round(avg(value), 6) AS f FROM events GROUP BY 1), s AS (SELECT event_type AS system, round(avg(value), 6) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1),
      p AS (SELECT system, f, coalesce(s, 0) AS s, row_number() OVER (ORDER BY f DESC, system) AS a, row_number() OVER (ORDER BY coalesce(s, 0) DESC, system) AS b FROM f LEFT JOIN s USING (system)),
      t AS (SELECT count(*) FILTER (x.b < y.b) AS c, count(*) FILTER (x.b > y.b) AS d FROM p x JOIN p y ON x.a < y.a)
      SELECT bool_and(a = b) AND max(abs(f - s)) <= 5 AS preserved, round(max(abs(f - s)), 6) AS max_delta, (SELECT round(coalesce((c - d) / nullif(c + d, 0), 1.0), 6) FROM t) AS tau FROM p""",
    "rrf_fuse": f"""WITH u AS (SELECT query_id, id, 1.0 / (60 + rank_no) AS p FROM {_half('first')} UNION ALL SELECT query_id, id, 0.5 / (60 + rank_no) FROM {_half('second')}),
      s AS (SELECT query_id, id, round(sum(CAST(p AS DOUBLE)), 9) AS score FROM u GROUP BY 1, 2) SELECT query_id, id, score, rank_no FROM {_top("s", 10)}""",
    "optimistic_rank": f"""WITH {_PAIRS}, own AS (SELECT query_id, min(id) AS id FROM pairs WHERE good GROUP BY 1)
      SELECT o.query_id, o.id, 1 + count(*) FILTER (p.score > s.score) AS best_rank FROM own o JOIN pairs s ON s.query_id = o.query_id AND s.id = o.id JOIN pairs p ON p.query_id = o.query_id GROUP BY 1, 2""",
    "doc_freq": f"WITH {_TERMS} SELECT term, count(DISTINCT id) AS n FROM p GROUP BY 1",
    "idf": f"WITH {_TERMS} SELECT term, round(greatest(0, ln(1 + ((SELECT count(*) FROM d) - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5))), 6) AS idf FROM p GROUP BY 1",
    "bm25_topk": _BM25 + f" SELECT query_id, id, score, rank_no FROM {_top('scores', 10)}",
    "rerank_features": _FEATURES + " SELECT query_id, id, coverage, round(idf_coverage, 4) AS idf_coverage, phrase, proximity, head, interaction FROM feats",
    "rerank_topk": _FEATURES + f", scores1 AS (SELECT query_id, id, round(1.0 / (1.0 + (rank_no - 1) / 10.0) + interaction, 6) AS score FROM feats) SELECT query_id, id, score, rank_no FROM {_top('scores1', 10)}",
    "rankings_csv": _RUN + " SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS corpus_id, rank_no AS rank, printf('%.6f', score) AS score FROM run",
    "prediction_ranks": f"WITH {_BEST} SELECT query_id, id, score, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank_no FROM best) WHERE rank_no <= 10",
    "file_ranks": f"""WITH {_BEST}, f AS (SELECT query_id, split_part(id, '::', 1) AS path, min(rank_no) AS first_rank FROM {_top("best", 100)} GROUP BY 1, 2)
      SELECT query_id, path, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS file_rank FROM f""",
    "hits_without_tests": rf"""WITH {_BEST}, k AS (SELECT query_id, id, score FROM {_top("best", 40)} WHERE NOT regexp_matches(split_part(id, '::', 1), '(^|/)(tests?|__tests__|spec|specs)/|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[cm]?[jt]sx?$'))
      SELECT query_id, id, score, rank_no FROM {_top("k", 10)}""",
    "percentiles": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
      SELECT event_type, n, """ + ", ".join(f"max(value) FILTER (place = CAST(round_even({s} * (n - 1), 0) AS BIGINT)) AS p{p}" for s, p in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM o GROUP BY 1, 2",
    "quartiles": "SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1",
    "terciles": """WITH o AS (SELECT CAST(length(text) AS DOUBLE) AS size, least((row_number() OVER (ORDER BY length(text), doc_id) - 1) // greatest(count(*) OVER () // 3, 1), 2) AS tercile FROM documents WHERE text IS NOT NULL)
      SELECT tercile, count(*) AS n, round(avg(size), 6) AS mean FROM o GROUP BY 1""",
    "bands": f"""WITH o AS (SELECT length(text) AS s, len({sql.words('text')}) AS w FROM documents WHERE text IS NOT NULL),
      b AS (SELECT w, CASE WHEN s < 200 THEN 0 WHEN s < 500 THEN 1 WHEN s < 1000 THEN 2 WHEN s < 2000 THEN 3 WHEN s < 100000 THEN 4 END AS band FROM o)
      SELECT band, count(*) AS n, round(avg(w), 6) AS mean FROM b WHERE band IS NOT NULL GROUP BY 1""",
    "bootstrap_ci": f"WITH {_NUMBERS}, {_DRAWS} SELECT system, n, mean, low, high FROM ci",
    "paired_bootstrap": f"""WITH {_NUMBERS.replace("v AS (", "v0 AS (", 1)}, v AS (SELECT 'length-words' AS system, a.query_id, a.score - b.score AS score FROM v0 a JOIN v0 b USING (query_id) WHERE a.system = 'length' AND b.system = 'words'), {_DRAWS},
      x AS (SELECT count(*) FILTER ((mean <= 0) = ((SELECT avg(score) FROM v) > 0)) AS c FROM means)
      SELECT 'length' AS system_a, 'words' AS system_b, n, mean AS diff, low, high, least(1.0, 2.0 * c / 100) AS p, low > 0 OR high < 0 AS significant FROM ci, x""",
    "kendall_tau": """WITH g AS (SELECT event_type AS id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1),
      r AS (SELECT id, row_number() OVER (ORDER BY n, id) AS a, row_number() OVER (ORDER BY v, id) AS b FROM g),
      p AS (SELECT count(*) FILTER (x.b < y.b) AS c, count(*) FILTER (x.b > y.b) AS d FROM r x JOIN r y ON x.a < y.a)
      SELECT round(coalesce((c - d) / nullif(c + d, 0), 1.0), 6) AS tau FROM p""",
    "stratified_sample": """WITH o AS (SELECT doc_id AS query_id, count(*) OVER () AS n, least((row_number() OVER (ORDER BY length(text), doc_id) - 1) // greatest(count(*) OVER () // 10, 1), 9) AS stratum FROM documents WHERE text IS NOT NULL),
      l AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0|' || query_id), query_id) AS lot, round_even(100.0 * count(*) OVER (PARTITION BY stratum) / n, 0) AS take FROM o)
      SELECT query_id, stratum FROM l WHERE lot <= take""",
    "hashed_sample": "SELECT doc_id FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 50",
    "watch_heads": """SELECT repo, "at", head FROM (SELECT user_id AS repo, ts AS "at", event_type AS head, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events WHERE event_type IS NOT NULL)
      WHERE head IS DISTINCT FROM before""",
    "normalised_vectors": """SELECT hash, view_name, round(s, 4) AS size, CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END AS after FROM (SELECT hash, view_name, sqrt(coalesce(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x)), 0)) AS s
      FROM vectors WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0)""",
}


def config_grid(spark, d):
    """Three rankings as configurations: whole vectors, and either half; the halves against the whole."""
    from quern.operators import evaluate

    runs = _run(spark, d).select(F.lit("whole").alias("config"), "query_id", "id", "rank_no")
    for name, run in zip(("first", "second"), _halves(spark, d), strict=True):
        runs = runs.unionByName(run.select(F.lit(name).alias("config"), "query_id", "id", "rank_no"))
    from quern.session import checkpoint

    return evaluate.evaluated(checkpoint(runs), _qrels(spark, d), "whole", 100).select("config", "queries", "ndcg", "mrr", "recall", F.round("diff", 4).alias("diff"))


QUERIES["config_grid"] = config_grid
ORACLES["config_grid"] = _RUN + f""", runs AS (SELECT 'whole' AS config, query_id, id, rank_no FROM run UNION ALL SELECT 'first', query_id, id, rank_no FROM {_half('first')} UNION ALL SELECT 'second', query_id, id, rank_no FROM {_half('second')}),
      rel AS (SELECT query_id, count(*) FILTER (good) AS n FROM pairs GROUP BY 1), ideal AS (SELECT query_id, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM rel WHERE n > 0),
      got AS (SELECT config, query_id, sum(CASE WHEN good AND rank_no <= 10 THEN 1 / log2(rank_no + 1) ELSE 0 END) AS dcg, min(rank_no) FILTER (good) AS first, count(*) FILTER (good) AS found FROM runs JOIN pairs USING (query_id, id) GROUP BY 1, 2),
      m AS (SELECT config, query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(found / n, 0), 6) AS recall FROM ((SELECT DISTINCT config FROM runs) CROSS JOIN ideal) LEFT JOIN got USING (config, query_id)),
      a AS (SELECT config, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall FROM m GROUP BY 1)
      SELECT a.*, CASE WHEN config <> 'whole' THEN round((SELECT avg(x.ndcg - y.ndcg) FROM m x JOIN m y USING (query_id) WHERE x.config = a.config AND y.config = 'whole'), 4) END AS diff FROM a"""


def watch_heads_stream(spark, d):
    """The events as a stream: head changes by state, written and read again."""
    import uuid

    from quern.session import shared_folder
    from quern.streaming import watch

    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    heads = events.select(F.col("user_id").alias("repo"), F.col("ts").alias("at"), F.col("event_type").alias("head"))
    folder = f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    watch.taken_in(watch.head_changes_stream(heads), f"{folder}/out", f"{folder}/progress")
    return spark.read.schema(heads.schema).parquet(f"{folder}/out")


QUERIES["watch_heads_stream"] = watch_heads_stream
ORACLES["watch_heads_stream"] = ORACLES["watch_heads"]


def hub_cross_fitted(spark, d):
    return hub.cross_fitted(_queries(spark, d), _docs(spark, d), _queries(spark, d), _qrels(spark, d), [1, 5], [0.5, 1.0], 10, 100)


QUERIES["hub_cross_fitted"] = hub_cross_fitted
