"""Registered queries over code snippets, their files, lines, names and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import code as C
from quern.functions import text as T
from quern.operators import encode, hits, lexical, lineage, metrics, stats
from quern.plans import sql
from quern.session import checkpoint, table, tasks
from quern.sources import files, records, store


def _current(spark, d):
    return lineage.current_rows(table(spark, d, "snippets"))


def _latest(spark, d):
    return _current(spark, d).join(lineage.latest_version(table(spark, d, "versions")), "version", "left_semi")


def _parsed(spark, d):
    return _current(spark, d).where("content IS NOT NULL").withColumn("p", C.parsed(F.col("content")))


def current_snippets(spark, d):
    return _current(spark, d).select("id", "version", T.content_hash(F.col("content")).alias("content_hash"), "loaded_at")


def language_detect(spark, d):
    return _current(spark, d).where("content IS NOT NULL").select("id", "version", C.language(F.col("content")).alias("language"))


def parse_fields(spark, d):
    p = _parsed(spark, d)
    cols = {k: F.array_join(F.col(f"p.{k}"), "|") for k in ("names", "class_names", "signatures", "imports")}
    return p.select("id", "version", *[v.alias(k) for k, v in cols.items()])


def parse_docs(spark, d):
    return _parsed(spark, d).select("id", "version", F.array_join("p.docstrings", "|").alias("docstrings"), F.array_join("p.strings", "|").alias("strings"))


def parse_calls(spark, d):
    return _parsed(spark, d).select("id", "version", F.array_join("p.calls", " ").alias("calls"))


def control_flow(spark, d):
    return _parsed(spark, d).select("id", "version", F.array_join("p.control", ", ").alias("control"))


def snippet_category(spark, d):
    return _parsed(spark, d).select("id", "version", C.category(F.col("p")).alias("category"))


def enriched(spark, d):
    p = _parsed(spark, d)
    return p.select("id", "version", C.enriched(F.col("content"), F.col("p")).alias("enriched"), F.array_join(C.identifiers(F.col("p")), " ").alias("identifiers"))


def views(spark, d):
    p = _parsed(spark, d).withColumn("kind", C.category(F.col("p")))
    built = C.views(F.col("content"), F.col("p"), F.col("kind"), C.enriched(F.col("content"), F.col("p")), ("nl", "code", "raw"))
    return p.select("id", "version", F.explode(built).alias("view_name", "view"))


def summaries(spark, d):
    return _current(spark, d).where("content IS NOT NULL").select("id", "version", T.chunks(F.col("content"), T.Chunking("summary", 128))[0].alias("summary"))


def secret_snippets(spark, d):
    return _current(spark, d).select("id", "version", files.contains_secret(F.col("content")).alias("secret"))


def describe_hits(spark, d):
    rows = hits.described(_current(spark, d).where("content IS NOT NULL").select("id", "version", "content"))
    return rows.select("id", "version", "unit_path", "name", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"), "language")


def _files(rows):
    """The files behind snippets, of each version: their snippets one after the other."""
    rows = rows.where("content IS NOT NULL").select("version", F.split_part("id", F.lit("::"), F.lit(1)).alias("path"), "start_line", "id", "content")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), "id", "content")))
    return rows.groupBy("version", "path").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"))


def scan_files(spark, d):
    return files.classified(_files(_current(spark, d)), all_languages=True, by=("version",)).select("version", "path", "reason", "language")


def scan_report(spark, d):
    return files.scan(_files(_current(spark, d)), all_languages=True, by=("version",))[1]


def extract_snippets(spark, d):
    return files.extract(_files(_current(spark, d)), by=("version",))


def line_windows(spark, d):
    rows = files.line_windows(_files(_current(spark, d)), by=("version",))
    return rows.select("version", "path", F.col("start_line").cast("bigint").alias("start_line"), "text")


def _mentioning(spark, d, *terms):
    """The current rows of the ids that some row of theirs makes candidates; contents without the terms are not shuffled."""
    rows = table(spark, d, "snippets")
    holds = F.lit(True)
    for t in terms:
        holds = holds & F.contains("content", F.lit(t))
    return lineage.current_rows(rows.join(rows.where(holds).select("id", "version").distinct(), ["id", "version"], "left_semi"))


USED, CALLED, DEFINED, BEFORE = "config", "append", "table", ("append", "write")


def uses_lines(spark, d):
    return lexical.uses(_mentioning(spark, d, USED), USED).select("unit", F.col("line").cast("bigint").alias("line"), "text")


def callers_lines(spark, d):
    return lexical.callers(_mentioning(spark, d, CALLED), CALLED).select("unit", F.col("line").cast("bigint").alias("line"), "text")


def definitions_lines(spark, d):
    return lexical.definitions(_mentioning(spark, d, DEFINED), DEFINED).select("unit", F.col("line").cast("bigint").alias("line"), "text")


def calls_before(spark, d):
    rows = lexical.calls_before(_mentioning(spark, d, *BEFORE), *BEFORE)
    return rows.select("unit", F.col("first_line").cast("bigint").alias("first_line"), F.col("second_line").cast("bigint").alias("second_line"))


def vocabulary(spark, d):
    return lexical.vocabulary(_current(spark, d))


def identifier_counts(spark, d):
    return lexical.vocabulary(_current(spark, d)).where("kind = 'identifier'").select("name", "n", "norm")


def most_called(spark, d):
    return lexical.most_called(_current(spark, d).select(F.concat("id", F.lit("@"), "version").alias("id"), "content"))


def resolve_names(spark, d):
    phrases = spark.createDataFrame([("load config",), ("append",), ("'quoted thing'",), ("keyeror",), ("log warn",), ("no such name at all",)], "phrase string")
    return lexical.resolve(lexical.vocabulary(_current(spark, d)), phrases)


def latest_version(spark, d):
    return lineage.latest_version(table(spark, d, "versions"))


def _history(spark, d):
    return lineage.history(table(spark, d, "snippets"), table(spark, d, "versions"))


def lineages(spark, d):
    rows = lineage.lineage_keys(_current(spark, d).select("id", "version"))
    return rows.select("id", "version", "lineage")


def evolution(spark, d):
    return _history(spark, d).select("lineage", F.col("ord").cast("bigint").alias("ord"), "version", "id", "h", "changed")


def evolution_labels(spark, d):
    return lineage.history_labels(_history(spark, d))


def history_diffs(spark, d):
    return lineage.history_diffs(_history(spark, d))


def changed_fractions(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("lineage").orderBy("ord", "id")
    rows = _history(spark, d).withColumn("old", F.lag("content").over(w)).where("changed")
    return rows.select("lineage", "version", F.round(T.changed_fraction(F.col("old"), F.col("content")), 6).alias("fraction"))


def release_diff(spark, d):
    return lineage.release_diff(table(spark, d, "snippets"), table(spark, d, "versions"))


def reuse_stats(spark, d):
    return lineage.reuse_report(table(spark, d, "snippets"), table(spark, d, "versions"))


def collapse_versions(spark, d):
    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    best = rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score"))
    members = _history(spark, d).select("lineage", "id", "version", "ord", "h")
    found = lineage.collapsed(best.join(members.select("id", "version"), "id"), members)
    return found.select("query_id", "lineage", "id", "version", "score", "versions", "rank_no")


def cache_misses(spark, d):
    """Contents of the latest version that no earlier version holds: what a cache filled so far lacks."""
    held = _current(spark, d).join(lineage.latest_version(table(spark, d, "versions")), "version", "left_anti")
    cache = held.where("content IS NOT NULL").select(F.lit("s").alias("sig"), T.content_hash(F.col("content")).alias("key")).distinct()
    return encode.cache_misses(_latest(spark, d).select(F.col("content").alias("text")), cache, "s").select("key")


def encoded(spark, d):
    rows = encode.encode(_current(spark, d).select("id", "version", F.col("content").alias("text")), encode.HashingEncoder(32))
    return rows.select("id", "version", F.posexplode("vector").alias("pos", "x")).where("x <> 0").select("id", "version", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def referenced_vectors(spark, d):
    kept = store.referenced_vectors(_current(spark, d), table(spark, d, "vectors"))
    return kept.select("hash", "view_name").distinct()


def table_digest(spark, d):
    return store.digest(_current(spark, d).select("id", "version", "content"))


def docs_per_term(spark, d):
    from quern.operators.sparse import document_frequency

    return document_frequency(_current(spark, d).select("version", F.col("enriched").alias("text")), ["version"])


def leak_filter(spark, d):
    return stats.pseudo_queries(_current(spark, d).select("id", "version", "content"))


def qrels_formats(spark, d):
    lines = spark.createDataFrame([("q1 0 s1 1",), ("q2 0 s2 1.0",), ("  q3\t0 s3 2 ",), ("too few columns",)], "value string")
    return records.parse_qrels(lines.where("value <> 'too few columns'"))


def reuse_percentages(spark, d):
    r = lineage.reuse_report(table(spark, d, "snippets"), table(spark, d, "versions"))
    return r.select("version", metrics.reuse_percentage(F.col("reused_texts"), F.col("new_texts")).alias("reused"))


QUERIES = {
    f.__name__: f
    for f in (
        current_snippets, language_detect, parse_fields, parse_docs, parse_calls, control_flow, snippet_category, enriched, views, summaries, secret_snippets, describe_hits,
        scan_files, scan_report, extract_snippets, line_windows, uses_lines, callers_lines, definitions_lines, calls_before, vocabulary, identifier_counts, most_called,
        resolve_names, latest_version, lineages, evolution, evolution_labels, history_diffs, changed_fractions, release_diff, reuse_stats, collapse_versions, cache_misses,
        encoded, referenced_vectors, table_digest, docs_per_term, leak_filter, qrels_formats, reuse_percentages,
    )
}

_CUR = sql.CURRENT
_LATEST = f"(SELECT * FROM {_CUR} WHERE version = (SELECT version FROM versions ORDER BY built_at DESC, version DESC LIMIT 1))"
_BARE = r"""regexp_replace(content, '"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''', '""', 'g')"""
_PY = r"""(CAST(regexp_matches(content, '(?m)^\s*def\s+\w+\s*\(') AS INT) + CAST(regexp_matches(content, '(?m)^\s*import\s+\w') AS INT) + CAST(regexp_matches(content, '(?m)^\s*from\s+[\w.]+\s+import') AS INT) + CAST(regexp_matches(content, '(?m):\s*$') AS INT))"""
_JS = r"""(CAST(regexp_matches(content, '\bfunction\s+\w*\s*\(') AS INT) + CAST(regexp_matches(content, '=>') AS INT) + CAST(regexp_matches(content, '\b(?:const|let|var)\s+\w+\s*=') AS INT) + CAST(regexp_matches(content, '(?m);\s*$') AS INT))"""
_LANG = f"CASE WHEN {_PY} > {_JS} THEN 'python' WHEN {_JS} > {_PY} THEN 'javascript' WHEN contains(content, 'def ') THEN 'python' ELSE 'unknown' END"
_FIELDS = rf"""f AS (SELECT id, version, content, {_LANG} AS l FROM {_CUR} WHERE content IS NOT NULL),
      n AS (SELECT id, version, content, l,
        CASE l WHEN 'python' THEN regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1)
          WHEN 'javascript' THEN list_concat(regexp_extract_all(content, '\bfunction\s+([A-Za-z_$][\w$]*)\s*\(', 1), regexp_extract_all(content, '\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>', 1)) ELSE [] END AS names,
        CASE l WHEN 'python' THEN regexp_extract_all(content, '(?m)^\s*class\s+([A-Za-z_]\w*)', 1) WHEN 'javascript' THEN regexp_extract_all(content, '\bclass\s+([A-Za-z_$][\w$]*)', 1) ELSE [] END AS class_names FROM f)"""
_CALLS = rf"""{_FIELDS}, c AS (SELECT *, list_filter(regexp_extract_all({_BARE}, '\b([A-Za-z_$][\w$]*)\s*\(', 1), lambda x: NOT list_contains({sql.texts(C.NOT_CALLS)}, x) AND NOT list_contains(list_concat(names, class_names), x)) AS calls FROM n)"""
_FILES = f"""files AS (SELECT version, split_part(id, '::', 1) AS path, string_agg(content, chr(10) ORDER BY coalesce(start_line, 0), id) AS content FROM {_CUR} WHERE content IS NOT NULL GROUP BY 1, 2)"""
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = rf"""l0 AS (SELECT id, version, split_part(id, '::', 1) AS unit, coalesce(TRY_CAST(split_part(id, '#', -1) AS INT), 1) AS start, regexp_split_to_array(content, '{_BREAK}') AS a FROM {_CUR} WHERE content IS NOT NULL),
      l1 AS (SELECT id, unit, start, CASE WHEN a[-1] = '' AND len(a) > 1 THEN a[1:len(a) - 1] ELSE a END AS a FROM l0),
      lines AS (SELECT id, unit, len(a) AS n_lines, start + unnest(range(0, len(a))) AS line, unnest(a) AS text FROM l1)"""
_INNER = "SELECT unit, line, trim(arg_min(text, (n_lines, id, text)), ' ') AS text FROM lines WHERE {} GROUP BY 1, 2"
_HIST = f"""cur AS (SELECT id, version, content, {sql.HASH} AS h, regexp_replace(id, '#[^#]*$', '') AS base FROM {_CUR}),
      twice AS (SELECT DISTINCT base FROM (SELECT version, base FROM cur GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)),
      lin AS (SELECT c.*, CASE WHEN t.base IS NULL THEN c.base ELSE c.id END AS lineage FROM cur c LEFT JOIN twice t USING (base)),
      hist AS (SELECT l.*, ord, coalesce(lag(h) OVER w <> h, false) AS changed FROM lin l JOIN {sql.ORDERED} USING (version) WINDOW w AS (PARTITION BY lineage ORDER BY ord, id))"""


def _once(items: str) -> str:
    """A list's first occurrences, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _kind() -> str:
    def names(x: str) -> str:
        return f"list_distinct(list_concat(list_transform({x}, lambda y: lower(y)), flatten(list_transform({x}, lambda x: {sql.parts('x')}))))"

    called, named, classes = names("calls"), names("list_concat(names, class_names)"), names("class_names")

    def common(a: str, marks: list[str]) -> str:
        return f"len(list_intersect({a}, {sql.texts(marks)}))"

    algorithm = f"({common(called, C.ALGORITHM_WORDS)} + {common(named, C.ALGORITHM_WORDS)})"
    io = common(called, C.IO_WORDS)
    return (
        f"CASE WHEN len(class_names) > 0 THEN CASE WHEN {common(classes, C.STRUCTURE_WORDS)} > 0 THEN 'data_structure' ELSE 'class_method' END WHEN {io} > 0 AND {io} >= {algorithm} THEN 'io' "
        f"WHEN {algorithm} > 0 THEN 'algorithm' WHEN {common(called, C.STRUCTURE_WORDS)} + {common(named, C.STRUCTURE_WORDS)} > 0 THEN 'data_structure' ELSE 'utility' END"
    )


def _control() -> str:
    def shown(marks: str) -> str:
        words = marks.split()
        end = r"\s*\(" if words[0].endswith("(") else r"\b"
        return r"\b(?:" + "|".join(w.rstrip("(").replace(".", r"\.") for w in words) + ")" + end

    found = [f"CASE WHEN regexp_matches(body, '{shown(marks)}') THEN '{phrase}' END" for phrase, marks in C.CONTROL_WORDS.items()]
    found.append("CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(body, '(?m)^( +)', 1), lambda s: length(s) // 4)), 0) >= 3 THEN 'deeply nested' END")
    found.append(r"CASE WHEN l = 'python' AND regexp_matches(body, '(?m)^\s*class\s+\w') THEN 'defines class' END")
    return f"array_to_string(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), ', ')"


ORACLES = {
    "current_snippets": f"SELECT id, version, sha256(content) AS content_hash, loaded_at FROM {_CUR}",
    "language_detect": f"SELECT id, version, {_LANG} AS language FROM {_CUR} WHERE content IS NOT NULL",
    "parse_fields": rf"""WITH {_FIELDS} SELECT id, version, array_to_string(names, '|') AS names, array_to_string(class_names, '|') AS class_names,
      array_to_string(CASE l WHEN 'python' THEN list_transform(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\([^)]*\)[^:]*:'), lambda s: regexp_replace(s, '^\s+|:+$', '', 'g'))
        WHEN 'javascript' THEN list_transform(regexp_extract_all(content, '\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]*\)'), lambda s: trim(s)) ELSE [] END, '|') AS signatures,
      array_to_string(CASE l WHEN 'python' THEN list_transform(regexp_extract_all(content, '(?m)^\s*(?:from\s+[\w.]+\s+import|import\s+[\w.]+)'), lambda s: regexp_extract(s, '(?:from|import)\s+([\w.]+)', 1))
        WHEN 'javascript' THEN list_concat(regexp_extract_all(content, 'require\s*\(\s*["'']([^"'']+)["'']\s*\)', 1), regexp_extract_all(content, '\bfrom\s+["'']([^"'']+)["'']', 1)) ELSE [] END, '|') AS imports FROM n""",
    "parse_calls": f"WITH {_CALLS} SELECT id, version, array_to_string(calls, ' ') AS calls FROM c",
    "control_flow": f"SELECT id, version, {_control()} AS control FROM (SELECT id, version, {_LANG} AS l, {_BARE} AS body FROM {_CUR} WHERE content IS NOT NULL)",
    "snippet_category": f"WITH {_CALLS} SELECT id, version, {_kind()} AS category FROM c",
    "secret_snippets": f"SELECT id, version, regexp_matches(coalesce(content, ''), '{files.SECRET_CONTENT.replace(chr(39), chr(39) * 2)}') AS secret FROM {_CUR}",
    "describe_hits": rf"""SELECT id, version, split_part(id, '::', 1) AS unit_path, split_part(split_part(id, '::', 2), '#', 1) AS name, TRY_CAST(split_part(id, '#', -1) AS BIGINT) AS first_line,
      TRY_CAST(split_part(id, '#', -1) AS BIGINT) + len(regexp_split_to_array(regexp_replace(content, '(?:\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}])\z', ''), '\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]')) - 1 AS last_line,
      coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in hits.ENDINGS.items())}}}[lower(regexp_extract(split_part(id, '::', 1), '\.([A-Za-z0-9]+)$', 1))], 'unknown') AS language FROM {_CUR} WHERE content IS NOT NULL""",
    "line_windows": rf"""WITH {_FILES}, a AS (SELECT version, path, regexp_split_to_array(content, '\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM files), k AS (SELECT version, path, l, unnest(range(0, (len(l) - 1) // 60 + 1)) AS k FROM a),
      w AS (SELECT version, path, k * 60 + 1 AS start_line, trim(array_to_string(l[k * 60 + 1 : k * 60 + 60], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM k)
      SELECT version, path, start_line, text FROM w WHERE length(text) >= 40""",
    "uses_lines": f"WITH {_LINES} " + _INNER.format(rf"regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){USED}($|[^\p{{L}}\p{{N}}_])')"),
    "callers_lines": f"WITH {_LINES} " + _INNER.format(rf"regexp_matches(text, '(^|[^\w$]){CALLED}\s*\(') AND NOT regexp_matches(text, '^\s*(?:async\s+)?def\s+{CALLED}\b|^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{CALLED}\b|^\s*(?:static\s+)?(?:async\s+)?\*?{CALLED}\s*\([^)]*\)\s*\{{')"),
    "definitions_lines": f"WITH {_LINES} " + _INNER.format(rf"regexp_matches(text, '^\s*(?:async\s+)?def\s+{DEFINED}\b|^\s*class\s+{DEFINED}\b|^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{DEFINED}\b|^\s*(?:export\s+)?(?:const|let|var)\s+{DEFINED}\s*=|^\s*(?:static\s+)?(?:async\s+)?\*?{DEFINED}\s*\([^)]*\)\s*\{{|^\s*{DEFINED}\s*[:=]\s*(?:async\s+)?(?:function\b|\()|^{DEFINED}\s*=')"),
    "calls_before": rf"""WITH {_LINES}, g AS (SELECT unit, id, n_lines, min(line) FILTER (regexp_matches(text, '(^|[^\w$]){BEFORE[0]}\s*\(')) AS first_line, min(line) FILTER (regexp_matches(text, '(^|[^\w$]){BEFORE[1]}\s*\(')) AS second_line FROM lines GROUP BY 1, 2, 3)
      SELECT DISTINCT unit, first_line, second_line FROM g WHERE first_line < second_line""",
    "identifier_counts": rf"""SELECT name, count(*) AS n, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*')) AS name FROM {_CUR}) GROUP BY 1""",
    "most_called": rf"""SELECT name, count(*) AS snippets FROM (SELECT DISTINCT id, version, unnest(list_filter(regexp_extract_all({_BARE}, '\b([A-Za-z_$][\w$]*)\s*\(', 1), lambda x: NOT list_contains({sql.texts(C.NOT_CALLS)}, x))) AS name FROM {_CUR}) GROUP BY 1""",
    "latest_version": "SELECT version FROM versions ORDER BY built_at DESC, version DESC LIMIT 1",
    "lineages": f"WITH {_HIST} SELECT id, version, lineage FROM lin",
    "evolution": f"WITH {_HIST} SELECT lineage, ord, version, id, h, changed FROM hist",
    "evolution_labels": f"WITH {_HIST}, n AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY ord, id) AS r FROM hist) SELECT lineage, string_agg(CASE WHEN r = 1 THEN '' WHEN changed THEN '!= ' ELSE '= ' END || version, ' ' ORDER BY r) AS label FROM n GROUP BY 1",
    "release_diff": f"""WITH c AS (SELECT id, ord, {sql.HASH} AS h FROM {_CUR} JOIN {sql.ORDERED} USING (version)),
      e AS (SELECT coalesce(a.ord + 1, b.ord) AS ord, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change FROM c a FULL JOIN c b ON a.id = b.id AND b.ord = a.ord + 1),
      n AS (SELECT ord, count(DISTINCT h) AS new_texts FROM c b WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.ord = b.ord - 1 AND a.h = b.h) GROUP BY 1)
      SELECT version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, coalesce(any_value(new_texts), 0) AS new_texts
      FROM e JOIN {sql.ORDERED} USING (ord) LEFT JOIN n USING (ord) WHERE ord > 1 AND change IS NOT NULL GROUP BY 1""",
    "reuse_stats": f"""WITH c AS (SELECT id, version, ord, {sql.HASH} AS h FROM {_CUR} JOIN {sql.ORDERED} USING (version)), f AS (SELECT h, min(ord) AS first_ord FROM c GROUP BY 1)
      SELECT version, count(*) AS snippets, count(DISTINCT h) FILTER (ord = first_ord) AS new_texts, count(DISTINCT h) FILTER (ord > first_ord) AS reused_texts FROM c JOIN f USING (h) GROUP BY 1""",
    "reuse_percentages": f"""WITH c AS (SELECT id, version, ord, {sql.HASH} AS h FROM {_CUR} JOIN {sql.ORDERED} USING (version)), f AS (SELECT h, min(ord) AS first_ord FROM c GROUP BY 1)
      SELECT version, round(100.0 * count(DISTINCT h) FILTER (ord > first_ord) / greatest(1, count(DISTINCT h)), 1) AS reused FROM c JOIN f USING (h) GROUP BY 1""",
    "collapse_versions": f"""WITH {_HIST}, best AS (SELECT query_id, h.id AS id, max(h.score) AS score FROM (SELECT query_id, unnest(hits) AS h FROM search_results) WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY 1, 2),
      p AS (SELECT query_id, lineage, b.id, version, score, row_number() OVER (PARTITION BY query_id, lineage ORDER BY score DESC, b.id, ord) AS n FROM best b JOIN hist USING (id)),
      v AS (SELECT lineage, string_agg(version, ' ' ORDER BY ord) AS versions FROM (SELECT DISTINCT lineage, version, ord FROM hist) GROUP BY 1),
      r AS (SELECT query_id, lineage, id, version, score, versions, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, version) AS rank_no FROM p JOIN v USING (lineage) WHERE n = 1) SELECT * FROM r WHERE rank_no <= 10""",
    "cache_misses": f"""SELECT DISTINCT sha256(content) AS key FROM {_LATEST} WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM {_CUR} WHERE content IS NOT NULL AND version <> (SELECT version FROM versions ORDER BY built_at DESC, version DESC LIMIT 1))""",
    "encoded": f"""WITH w AS (SELECT id, version, unnest(regexp_extract_all(lower(coalesce(content, '')), '[a-z]+')) AS t FROM {_CUR}), c AS (SELECT id, version, CAST(('0x' || right(md5(t), 2)) AS BIGINT) % 32 AS pos, count(*) AS n FROM w GROUP BY 1, 2, 3)
      SELECT id, version, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY id, version)), 6) AS x FROM c""",
    "referenced_vectors": f"""SELECT DISTINCT hash, view_name FROM vectors WHERE (view_name, hash) IN (SELECT (e.key, e.value) FROM (SELECT unnest(map_entries(vkeys)) AS e FROM {_CUR}))""",
    "table_digest": f"""SELECT count(*) AS rows, CAST(sum(CAST(('0x' || left(sha256(concat_ws('|', coalesce(length(content) || ':' || content, '-'), coalesce(length(id) || ':' || id, '-'), coalesce(length(version) || ':' || version, '-'))), 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM {_CUR}""",
    "docs_per_term": f"SELECT version, term, count(*) AS n FROM (SELECT version, unnest(list_distinct({sql.index_terms('enriched')})) AS term FROM {_CUR}) GROUP BY 1, 2",
    "qrels_formats": "SELECT * FROM (VALUES ('q1', 's1', 1), ('q2', 's2', 1), ('q3', 's3', 2)) AS t(query_id, id, rel)",
}

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIPLE = r'(?s)"{3}.*?"{3}|' + "(?:''){3}.*?(?:''){3}"
_QUOTED = "|".join(rf"{q}(?:[^{q}\\\n]|\\.){{2,200}}{q}" for q in ("''", '"', "`"))
_LIT = r'"(?:[^"\\\n]|\\.)*"|' + r"''(?:[^''\\\n]|\\.)*''"


def _clean(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"


def _parts(names: str) -> str:
    return f"flatten(list_transform({names}, lambda x: {sql.parts('x')}))"


def _line(items: str, by: str = " ") -> str:
    return f"array_to_string({items}, '{by}')"


_EVERY = rf"""{_CALLS}, b AS (SELECT c.*, {_BARE} AS body FROM c),
      fields AS (SELECT id, version, content, l, names, class_names, calls, {_control()} AS control,
        CASE l WHEN 'python' THEN list_transform(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\([^)]*\)[^:]*:'), lambda s: regexp_replace(s, '^\s+|:+$', '', 'g'))
          WHEN 'javascript' THEN list_transform(regexp_extract_all(content, '\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]*\)'), lambda s: trim(s)) ELSE [] END AS signatures,
        CASE l WHEN 'python' THEN list_transform(regexp_extract_all(content, '(?m)^\s*(?:from\s+[\w.]+\s+import|import\s+[\w.]+)'), lambda s: regexp_extract(s, '(?:from|import)\s+([\w.]+)', 1))
          WHEN 'javascript' THEN list_concat(regexp_extract_all(content, 'require\s*\(\s*["'']([^"'']+)["'']\s*\)', 1), regexp_extract_all(content, '\bfrom\s+["'']([^"'']+)["'']', 1)) ELSE [] END AS imports,
        CASE l WHEN 'python' THEN list_concat({_clean(f"list_transform(regexp_extract_all(content, '{_TRIPLE}'), lambda x: x[4:-4])")}, {_clean(r"regexp_extract_all(content, '(?m)^\s*#\s?(.+)$', 1)")})
          WHEN 'javascript' THEN list_concat({_clean(r"regexp_extract_all(content, '(?m)^\s*//\s?(.+)$', 1)")},
            {_clean(r"list_transform(flatten(list_transform(regexp_extract_all(content, '(?s)/\*\*(.*?)\*/', 1), lambda b: regexp_split_to_array(b, '" + _BREAK.replace(r"\x1c-\x1e", "") + r"'))), lambda x: regexp_replace(x, '^\s*\*\s?', ''))")}) ELSE [] END AS docstrings,
        list_filter(list_transform(regexp_extract_all(CASE l WHEN 'python' THEN regexp_replace(content, '{_TRIPLE}', '""', 'g') ELSE content END, '{_LIT}'), lambda x: trim(x[2:-2], ' ')), lambda x: length(x) BETWEEN 2 AND 199) AS strings
        FROM b)"""
_KIND = f"kinds AS (SELECT *, {_kind()} AS kind FROM fields)"


def _joined(parts: list[str], by: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: trim(x, ' ') <> ''), {by})"


_TEXT = _joined(
    [_line("names"), _line(_parts("list_concat(names, class_names)")), _line("signatures"), _line("docstrings"), _line(f"list_concat({_once('calls')}, {_parts(_once('calls'))})"), _line("strings[1:40]"), "control", _line("imports"), "content"], "chr(10)",
)
_NL = _joined(
    [
        _line("names"), _line(_once(_parts("list_concat(names, class_names)"))), _line("signatures[1:4]"), _line("docstrings[1:6]"), "control",
        f"CASE WHEN len({_once('calls')}) > 0 AND len({_parts(_once('calls') + '[1:25]')}) > 0 THEN 'uses ' || {_line(_once(_parts(_once('calls') + '[1:25]')))} ELSE '' END", _line("strings[1:10]"), "'a ' || replace(kind, '_', ' ') || ' routine'",
    ], "'. '",
)
_STRIP = r"regexp_replace({}, '^[\s\x{{0b}}]+|[\s\x{{0b}}]+$', '', 'g')"
_FOLDER = "CASE " + " ".join(f"WHEN list_contains({sql.texts(names)}, x) THEN '{why}'" for why, names in sorted(files.SKIPPED_FOLDERS.items(), key=lambda kv: kv[0] != "virtual environment")) + " WHEN starts_with(x, '.') THEN 'hidden directory' END"
_SECRET = f"list_contains({sql.texts(files.SECRET_ENDINGS)}, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1))) OR regexp_matches(name, '{files.SECRET_NAME}') OR contains(lower(name), '.pem.') OR contains(lower(name), '.key.')"
ORACLES |= {
    "scan_files": rf"""WITH {_FILES}, p AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM files),
      env AS (SELECT version, regexp_replace(path, '/pyvenv.cfg$', '') AS folder FROM files WHERE ends_with(path, '/pyvenv.cfg')),
      f AS (SELECT *, list_filter(list_transform(parts[1:-2], lambda x: {_FOLDER}), lambda x: x IS NOT NULL)[1] AS folder_reason, EXISTS (SELECT 1 FROM env e WHERE e.version = p.version AND starts_with(p.path, e.folder || '/')) AS env,
        CASE WHEN {_SECRET} THEN 'secret file'
          WHEN NOT list_contains({sql.texts(files.SOURCE_ENDINGS + files.WINDOW_ENDINGS)}, regexp_extract(name, '\.([A-Za-z0-9]+)$', 1)) THEN 'not source code (docs, data, lockfiles, notebooks)'
          WHEN regexp_matches(name, '{files.MINIFIED_NAME}') THEN 'minified or generated' WHEN strlen(content) > {files.MOST_BYTES} THEN 'too large (generated)'
          WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > {files.LONGEST_LINE} THEN 'minified or generated' END AS file_reason FROM p),
      r AS (SELECT version, path, coalesce(CASE WHEN env THEN 'virtual environment' END, folder_reason, file_reason) AS reason FROM f)
      SELECT version, path, reason, CASE WHEN reason IS NULL THEN coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in hits.ENDINGS.items())}}}[lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))], 'unknown') END AS language FROM r""",
    "changed_fractions": f"""WITH {_HIST}, o AS (SELECT lineage, version, content, changed, lag(content) OVER (PARTITION BY lineage ORDER BY ord, id) AS old FROM hist),
      t AS (SELECT lineage, version, {sql.tokens('old', False)} AS a, {sql.tokens('content', False)} AS b FROM o WHERE changed)
      SELECT lineage, version, CASE WHEN len(a) = len(b) AND len(a) > 0 THEN round(len(list_filter(list_zip(a, b), lambda x: x[1] <> x[2])) / len(a), 6) END AS fraction FROM t""",
    "leading_comments": rf"""WITH c AS (SELECT id, version, regexp_extract(content, '(?s)^\s*/\*+(.*?)\*/', 1) AS block, regexp_extract(content, '^((?:\s*(?://|#)[^\n]*\n?)+)', 1) AS run FROM {_CUR} WHERE content IS NOT NULL)
      SELECT id, version, nullif(trim(regexp_replace(regexp_replace(CASE WHEN block <> '' THEN block ELSE run END, '(?m)^\s*(?://+|#+|\*+)\s?', '', 'g'), '[\s\x{{0b}}]+', ' ', 'g'), ' '), '') AS comment FROM c""",
    "parse_docs": f"WITH {_EVERY} SELECT id, version, array_to_string(docstrings, '|') AS docstrings, array_to_string(strings, '|') AS strings FROM fields",
    "enriched": f"WITH {_EVERY} SELECT id, version, coalesce(nullif({_TEXT}, ''), content) AS enriched, array_to_string({_once('list_concat(list_concat(names, class_names), calls)')}, ' ') AS identifiers FROM fields",
    "views": f"""WITH {_EVERY}, {_KIND}, v AS (SELECT id, version, 'nl' AS view_name, {_NL} AS "view" FROM kinds UNION ALL
        SELECT id, version, 'code', coalesce(nullif({_STRIP.format("array_to_string(signatures[1:4], ' ') || chr(10) || content")}, ''), content) FROM kinds UNION ALL SELECT id, version, 'raw', {_STRIP.format('content')} FROM kinds)
      SELECT * FROM v WHERE trim("view", ' ') <> ''""",
    "vocabulary": rf"""WITH n AS (SELECT unnest(regexp_extract_all(content, '[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*')) AS name, 'identifier' AS kind FROM {_CUR} UNION ALL
        SELECT unnest(list_transform(regexp_extract_all(content, '{_QUOTED}'), lambda x: x[2:-2])), 'string' FROM {_CUR})
      SELECT name, kind, count(*) AS n, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm FROM n GROUP BY 1, 2""",
    "summaries": f"""WITH {_EVERY}, s AS (SELECT id, version, list_filter(list_concat(list_concat(list_concat(names, {_parts('list_concat(names, class_names)')}), list_concat(signatures, docstrings[1:4])), list_concat(list_concat({_once('calls')}[1:30], strings[1:15]), list_filter(string_split(control, ', '), lambda x: x <> ''))), lambda x: x <> '') AS a FROM fields),
      w AS (SELECT id, version, array_to_string(a, ' ') AS t, {sql.words("array_to_string(a, ' ')")} AS w FROM s) SELECT id, version, array_to_string(w[1:128], ' ') AS summary FROM w""",
}


def _worked(spark, d, name, work, only=None):
    """(id, version, name) of all versions; work makes a column of content and lang, once for each distinct pair of them."""
    lang = hits.language_of(F.split_part("id", F.lit("::"), F.lit(1)))
    rows = _current(spark, d).where("content IS NOT NULL").select("id", "version", "content", T.content_hash(F.col("content")).alias("key"), lang.alias("lang"))
    rows = rows if only is None else rows.where(F.col("lang") == only)
    distinct = rows.groupBy("key", "lang").agg(F.first("content").alias("content")).repartition(tasks(spark), "key")
    return rows.select("id", "version", "key", "lang").join(distinct.select("key", "lang", work(F.col("content"), F.col("lang")).alias(name)), ["key", "lang"]).select("id", "version", name)


def renamed_code(spark, d):
    from quern.functions import transforms

    return _worked(spark, d, "renamed", transforms.renamed)


def reordered_code(spark, d):
    from quern.functions import transforms

    return _worked(spark, d, "reordered", lambda content, _: transforms.reordered(content), "python")


def leading_comments(spark, d):
    from quern.functions import transforms

    return _current(spark, d).where("content IS NOT NULL").select("id", "version", transforms.leading_comment(F.col("content")).alias("comment"))


def search_hybrid(spark, d):
    """The held-out items against the snippets of all versions: both arms, fusion, reranking, collapse by lineage."""
    from quern.operators import search
    from quern.operators.snapshots import canonical_hash, version_order

    docs = _current(spark, d).where("content IS NOT NULL").select("id", "version", canonical_hash().alias("h"), F.col("enriched").alias("text"), "category", "identifiers").where("text IS NOT NULL")
    asked = table(spark, d, "eval_items").groupBy(F.col("item_id").alias("query_id")).agg(F.max("text").alias("text")).where("text IS NOT NULL")
    return search.search_versions(checkpoint(docs), asked, version_order(table(spark, d, "versions")))


QUERIES |= {f.__name__: f for f in (renamed_code, reordered_code, leading_comments, search_hybrid)}


def call_pairs(spark, d):
    from quern.operators import evaluate

    return evaluate.call_pairs(_current(spark, d).select(F.concat("id", F.lit("@"), "version").alias("id"), "content"))


def docstring_queries(spark, d):
    from quern.operators import evaluate

    return evaluate.docstring_queries(_current(spark, d).select("id", "version", "content")).select("query_id", "version", "text", "answer")


def handwritten_queries(spark, d):
    """The best hit of each stored question, without its line, as the name a hand-written question would give."""
    from quern.operators import evaluate

    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("query_id IS NOT NULL AND h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    best = rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score")).groupBy("query_id").agg(F.max_by("id", F.struct("score", "id")).alias("id"))
    spec = best.select("query_id", F.lit("").alias("text"), F.regexp_replace("id", "#[^#]*$", "").alias("answer"))
    found, missing = evaluate.handwritten_queries(spec, table(spark, d, "snippets").where("id IS NOT NULL").select("id"))
    return found.select("query_id", "answer", F.lit(True).alias("resolved")).unionByName(missing.select("query_id", "answer", F.lit(False).alias("resolved")))


QUERIES |= {f.__name__: f for f in (call_pairs, docstring_queries, handwritten_queries)}
ORACLES |= {
    "call_pairs": rf"""WITH s AS (SELECT id || '@' || version AS id, content FROM {_CUR}), d AS (SELECT DISTINCT split_part(split_part(id, '::', 2), '#', 1) AS name FROM s WHERE length(split_part(split_part(id, '::', 2), '#', 1)) > 3 AND split_part(split_part(id, '::', 2), '#', 1) NOT IN ('window', 'main', '__init__')),
      r AS (SELECT id, list_transform(regexp_extract_all(content, '[\w$.]+\s*\('), lambda x: regexp_replace(x, '\s*\($', '')) AS a FROM s),
      c AS (SELECT id, name, min(i) AS i FROM (SELECT id, unnest(a) AS name, unnest(range(0, len(a))) AS i FROM r) WHERE regexp_matches(name, '^[A-Za-z_$][\w$]*$') AND name IN (SELECT name FROM d) GROUP BY 1, 2)
      SELECT x.name AS first, y.name AS second, count(*) AS snippets FROM c x JOIN c y ON x.id = y.id AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 2""",
    "handwritten_queries": """WITH h AS (SELECT query_id, unnest(hits) AS h FROM search_results WHERE query_id IS NOT NULL), b AS (SELECT query_id, h.id AS id, max(h.score) AS score FROM h WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY 1, 2),
      q AS (SELECT query_id, regexp_replace(arg_max(id, (score, id)), '#[^#]*$', '') AS answer FROM b GROUP BY 1), s AS (SELECT regexp_replace(id, '#[^#]*$', '') AS answer, min(id) AS id FROM snippets WHERE id IS NOT NULL GROUP BY 1)
      SELECT query_id, coalesce(id, answer) AS answer, id IS NOT NULL AS resolved FROM q LEFT JOIN s USING (answer)""",
}


def _norm(text: str) -> str:
    return f"lower(array_to_string({sql.words(text)}, ' '))"


ORACLES["leak_filter"] = rf"""WITH {_HIST.split("hist AS (")[0].rstrip().rstrip(",")},
      f AS (SELECT DISTINCT lineage, content, trim(regexp_extract(content, '^\s*(?:/\*\*?|//|#)\s*(.+?)(?:\*/)?\s*(?:\n|$)', 1), ' ') AS text, {_norm(r"regexp_replace(content, '(?m)^\s*(?:/\*\*?|//|#|\*)', '', 'g')")} AS body FROM lin WHERE content IS NOT NULL),
      t AS (SELECT *, {_norm('text')} AS norm FROM f), c AS (SELECT norm, min(lineage) AS owner FROM t WHERE len(string_split(norm, ' ')) >= 5 GROUP BY 1 HAVING count(DISTINCT lineage) = 1),
      leaked AS (SELECT DISTINCT c.norm FROM c JOIN t ON t.lineage <> c.owner AND contains(t.body, c.norm)),
      kept AS (SELECT DISTINCT content, text FROM t WHERE norm IN (SELECT norm FROM c) AND norm NOT IN (SELECT norm FROM leaked))
      SELECT id AS query_id, version, text, id AS answer FROM lin JOIN kept USING (content)"""


def rank_probes(spark, d):
    """Of each stored question the lineage of its best hit, probed in the oldest version among the hits of the newest."""
    from quern.operators.snapshots import version_order
    from quern.session import checkpoint

    rows = table(spark, d, "search_results").select("query_id", F.explode("hits").alias("h")).where("query_id IS NOT NULL AND h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score)")
    best = rows.groupBy("query_id", F.col("h.id").alias("id")).agg(F.max("h.score").alias("score"))
    found = checkpoint(best.join(_history(spark, d).select("lineage", "id", "version"), "id"))
    golds = found.groupBy("query_id").agg(F.max_by("lineage", F.struct("score", "id", "lineage")).alias("lineage"))
    ends = version_order(table(spark, d, "versions")).agg(F.min_by("version", "ord").alias("first"), F.max_by("version", "ord").alias("last")).first()
    return lineage.rank_probes(found, golds, ends["last"], ends["first"])


QUERIES["rank_probes"] = rank_probes
ORACLES["rank_probes"] = f"""WITH {_HIST}, best AS (SELECT query_id, h.id AS id, max(h.score) AS score FROM (SELECT query_id, unnest(hits) AS h FROM search_results WHERE query_id IS NOT NULL) WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY 1, 2),
      f AS (SELECT query_id, lineage, b.id, version, score, ord FROM best b JOIN hist USING (id)), g AS (SELECT query_id, arg_max(lineage, (score, id, lineage)) AS gold FROM f GROUP BY 1),
      e AS (SELECT min(ord) AS a, max(ord) AS z FROM {sql.ORDERED}), k AS (SELECT f.*, gold FROM f JOIN g USING (query_id), e WHERE (lineage = gold AND ord = a) OR (lineage <> gold AND ord = z)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM k), p AS (SELECT query_id, min(n) AS rank_no FROM r WHERE n <= 10 AND lineage = gold GROUP BY 1)
      SELECT query_id, gold AS lineage, rank_no FROM g LEFT JOIN p USING (query_id)"""
