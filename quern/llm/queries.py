"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import encoding, handwritten, leakage, neighbours, personal, splitting, term_counts, top_items
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    marked = term_counts.marked_terms(table(spark, d, "df"), table(spark, d, "snippets"))
    return marked.where("mark is not null").select("term", "mark")


def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "df"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items.top_items(table(spark, d, "search_results")).select("query_id", "hit_id", "rank_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found_pairs(table(spark, d, "vectors"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_written_by_hand(table(spark, d, "snippets"))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.file_evidence(table(spark, d, "snippets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "snippets"), table(spark, d, "chunk_configs"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "snippets"), table(spark, d, "chunk_configs"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    return splitting.soundness(table(spark, d, "snippets"), table(spark, d, "chunk_configs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.distinct_items(table(spark, d, "documents")).select("doc_id", "kind", "found")


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.masked(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_term_counts, p2_found, p4_found, p4_neighbours, p5_found, p5_evidence, p6_found, p6_pieces, p6_sound, p7_ids, p8_found, p8_leaks, p9_found, p9_masked)}

_SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORDS = _SPACES.replace("[", "[^", 1) + "+"
_COUNTS = rf"""
  WITH good AS (SELECT version, shard, term, n, loaded_at FROM df WHERE regexp_matches(term, '[^\s\x{{85}}\p{{Z}}]') AND n >= 1),
  held AS (SELECT version, shard, term, max(n) AS n FROM good g WHERE loaded_at = (SELECT max(loaded_at) FROM good h
      WHERE h.version IS NOT DISTINCT FROM g.version AND h.shard IS NOT DISTINCT FROM g.shard AND h.term = g.term) GROUP BY 1, 2, 3),
  named AS (SELECT lower(nfc_normalize(regexp_replace(term, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g'))) AS term, version, shard, n FROM held),
  counted AS (SELECT term, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT (version, shard)) AS records FROM named GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p1_found": _COUNTS
    + """, current AS (SELECT count(DISTINCT (id, version)) AS rows FROM snippets)
      SELECT term, CASE WHEN total < 10 THEN 'rare' ELSE 'common' END AS mark FROM counted, current WHERE total < 10 OR total * 20 > rows""",
    "p1_term_counts": _COUNTS + " SELECT term, total, records FROM counted",
    "p2_found": """
      WITH hits AS (SELECT query_id, unnest(hits) AS h FROM search_results),
      items AS (SELECT query_id, h.id AS hit_id, max(h.score) AS score FROM hits WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY 1, 2),
      ranked AS (SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id ASC) AS rank_no FROM items)
      SELECT query_id, hit_id, rank_no FROM ranked WHERE rank_no <= 10""",
    "p6_found": rf"""
      WITH current AS (SELECT id, version, content FROM snippets QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY loaded_at DESC, content DESC NULLS LAST) = 1),
      counted AS (SELECT id, version, len(regexp_extract_all(content, '{_WORDS}')) AS words FROM current)
      SELECT config_name, id, version FROM counted JOIN (SELECT DISTINCT config_name, budget_tokens FROM chunk_configs) c ON budget_tokens > 0 AND words > budget_tokens""",
    "p6_sound": rf"""
      WITH current AS (SELECT id, version, content FROM snippets QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY loaded_at DESC, content DESC NULLS LAST) = 1),
      counted AS (SELECT id, version, len(regexp_extract_all(content, '{_WORDS}')) AS words FROM current)
      SELECT config_name, id, version, CAST(words AS BIGINT) AS n_words, true AS within, true AS covering
      FROM counted JOIN (SELECT DISTINCT config_name, budget_tokens FROM chunk_configs) c ON budget_tokens > 0 AND words > budget_tokens""",
}
