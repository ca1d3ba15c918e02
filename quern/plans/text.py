"""Registered queries over texts and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import queries as Q
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import metrics
from quern.operators.lineage import current_rows
from quern.plans import sql
from quern.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").groupBy("item_id").agg(F.max("text").alias("text"))


def _line(items, by: str = " "):
    return F.array_join(items, by)


def tokens(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", _line(t).alias("toks"), F.size(t).cast("bigint").alias("n"))


def content_tokens(spark, d):
    return _docs(spark, d).select("doc_id", _line(T.content_tokens(F.col("text"))).alias("toks"))


def bigrams(spark, d):
    return _docs(spark, d).select("doc_id", _line(T.bigrams(T.content_tokens(F.col("text")))).alias("grams"))


def identifier_split(spark, d):
    names = table(spark, d, "snippets").select(F.explode("identifiers").alias("name")).distinct()
    return names.select("name", _line(T.subwords(F.col("name"))).alias("parts"))


def stable_hash(spark, d):
    names = table(spark, d, "snippets").select("unit_name").distinct()
    return names.select("unit_name", T.fnv1a(F.col("unit_name")).alias("h"))


def chunk_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.truncated(F.col("text"), 64).alias("chunk"))


def chunk_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.windows(F.col("text"), 64, 0.25)).alias("no", "chunk")).select("doc_id", F.col("no").cast("bigint").alias("no"), "chunk")


def vector_keys(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select(
        "doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.vector_key(T.windows(F.col("text"), 64, 0.25)).alias("vector_key")
    )


def word_overlap(spark, d):
    rows = current_rows(table(spark, d, "snippets"))
    return rows.select("id", "version", F.round(T.overlap(F.col("content"), F.col("enriched")), 6).alias("overlap"))


def query_process(spark, d):
    p = Q.processed(F.col("text"))
    rows = _items(spark, d).where("text IS NOT NULL").select("item_id", p.alias("p"))
    return rows.select(
        "item_id", "p.category", _line(F.col("p.tokens")).alias("toks"), _line(F.col("p.expansions")).alias("more"), _line(F.col("p.identifiers")).alias("idents"),
        _line(Q.search_terms(F.col("p.tokens"))).alias("terms"),
    )


def query_category(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", Q.category(F.col("text")).alias("category"))


def sections_cut(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.length(T.without_sections(F.col("text"))).cast("bigint").alias("n"))


def escaped(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.escaped(F.col("text")).alias("shown"))


def hashed_vectors(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(V.hashed_vector(F.col("text"), 32)).alias("pos", "x")).where("x <> 0")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def test_paths(spark, d):
    paths = table(spark, d, "snippets").select(F.split_part("id", F.lit("::"), F.lit(1)).alias("path")).distinct()
    return paths.select("path", T.is_test_path(F.col("path")).alias("is_test"))


def collection_sizes(spark, d):
    g = metrics.describe(table(spark, d, "documents"))
    return g.select("lang", "n", F.col("shortest").cast("bigint").alias("shortest"), "median", F.col("longest").cast("bigint").alias("longest"))


def name_variants(spark, d):
    names = table(spark, d, "snippets").select("unit_name").where("unit_name IS NOT NULL").distinct()
    return names.select("unit_name", _line(Q.variants(F.regexp_extract_all("unit_name", F.lit("[A-Za-z0-9]+"), F.lit(0))), "|").alias("styles"))


QUESTIONS = [
    ("where is the settings url used?", "usage", "settings url", None, None),
    ("who calls validateSession", "callers", "validateSession", None, None),
    ("which functions call validateSession before logEvent", "order", "validateSession", "logEvent", "before"),
    ("where is parseConfig defined", "definition", "parseConfig", None, None),
    ("find all usages of MAX_RETRIES", "usage", "MAX_RETRIES", None, None),
    ("callers of sendMail", "callers", "sendMail", None, None),
    ("is openFile called after closeFile?", "order", "openFile", "closeFile", "after"),
    ("sort a list of numbers by their digits", None, None, None, None),
    ("where does the retry helper live", "definition", "retry", None, None),
]


def route_questions(spark, d):
    from quern.operators.lexical import routed

    return routed(spark.createDataFrame([(q[0],) for q in QUESTIONS], "question string"))


def routed_statements(spark, d):
    """How many of the held-out statements would be taken away from ranked search."""
    rows = _items(spark, d).where("text IS NOT NULL").select(F.col("text").alias("question"))
    return rows.select(Q.route(F.col("question")).alias("r")).agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("r").isNotNull()).alias("routed"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens, content_tokens, bigrams, identifier_split, stable_hash, chunk_truncate, chunk_windows, vector_keys, word_overlap, query_process, query_category,
        sections_cut, escaped, hashed_vectors, test_paths, collection_sizes, name_variants, route_questions, routed_statements,
    )
}

_S = sql
_BIG = "list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])"
_SYN = "MAP {" + ", ".join(f"'{k}': {_S.texts(v.split())}" for k, v in Q.SYNONYMS.items()) + "}"
_IDENT = r"\b(?:[a-z]+[A-Z]\w*|\w+_\w+|[A-Z]{2,}(?:_\w+)*)\b"
_WINDOWS = f"""list_transform(range(0, CAST(ceil(greatest(len(w) - 64, 0) / 48.0) AS BIGINT) + 1), lambda i: array_to_string(w[i * 48 + 1 : i * 48 + 64], ' '))"""


def _category(t: str) -> str:
    def common(v: list[str]) -> str:
        return f"len(list_intersect(list_distinct({_S.tokens(t, False)}), {_S.texts(v)}))"

    s, a, b = common(Q.STRUCTURAL), common(Q.ALGORITHMIC), common(Q.BEHAVIOURAL)
    return (
        rf"CASE WHEN regexp_matches({t}, '{_IDENT}') OR regexp_matches({t}, '\b(\w+)\s*\(') THEN 'identifier_led' WHEN {s} > 0 AND {s} >= {a} AND {s} >= {b} THEN 'structural' "
        f"WHEN {a} > 0 AND {a} >= {b} THEN 'algorithmic' ELSE 'behavioural' END"
    )


ORACLES = {
    "tokens": f"SELECT doc_id, array_to_string(t, ' ') AS toks, len(t) AS n FROM (SELECT doc_id, {_S.tokens('text')} AS t FROM documents)",
    "content_tokens": f"SELECT doc_id, array_to_string({_S.content_tokens('text')}, ' ') AS toks FROM documents",
    "bigrams": f"SELECT doc_id, CASE WHEN len(t) > 1 THEN array_to_string({_BIG}, ' ') ELSE '' END AS grams FROM (SELECT doc_id, {_S.content_tokens('text')} AS t FROM documents)",
    "identifier_split": f"SELECT name, array_to_string({_S.parts('name')}, ' ') AS parts FROM (SELECT DISTINCT unnest(identifiers) AS name FROM snippets)",
    "stable_hash": "SELECT unit_name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split(coalesce(unit_name, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), "
    "lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT unit_name FROM snippets)",
    "chunk_truncate": f"SELECT doc_id, array_to_string({_S.words('text')}[1:64], ' ') AS chunk FROM documents",
    "chunk_windows": f"""SELECT doc_id, unnest(range(0, len(c))) AS no, unnest(c) AS chunk FROM (SELECT doc_id, {_WINDOWS} AS c FROM (SELECT doc_id, {_S.words('text')} AS w FROM documents))""",
    "vector_keys": f"""SELECT doc_id, sha256(text) AS content_hash, sha256(array_to_string({_WINDOWS}, chr(30))) AS vector_key FROM (SELECT doc_id, text, {_S.words('text')} AS w FROM documents WHERE text IS NOT NULL)""",
    "word_overlap": f"""SELECT id, version, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS overlap FROM (
      SELECT id, version, list_distinct(list_filter({_S.tokens('content', False)}, lambda y: NOT list_contains({_S.texts(T.STOP_WORDS)}, y))) AS a,
             list_distinct(list_filter({_S.tokens('enriched', False)}, lambda y: NOT list_contains({_S.texts(T.STOP_WORDS)}, y))) AS b FROM {_S.CURRENT})""",
    "query_category": f"SELECT doc_id, {_category('text')} AS category FROM documents WHERE text IS NOT NULL",
    "sections_cut": r"""SELECT doc_id, length(CASE WHEN pos > 40 THEN trim(substr(text, 1, pos - 1)) ELSE text END) AS n FROM (SELECT doc_id, text,
      CASE WHEN regexp_matches(text, '(?i)-{3,}\s*(?:Input|Output|Examples?|Note|Constraints|Sample)') THEN strpos(text, regexp_extract(text, '(?i)-{3,}\s*(?:Input|Output|Examples?|Note|Constraints|Sample)')) ELSE 0 END AS pos
      FROM documents WHERE text IS NOT NULL)""",
    "escaped": r"SELECT doc_id, regexp_replace(replace(replace(replace(text, chr(13), '\r'), chr(10), '\n'), chr(9), '\t'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '?', 'g') AS shown FROM documents WHERE text IS NOT NULL",
    "hashed_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS t FROM documents),
      c AS (SELECT doc_id, CAST(('0x' || right(md5(t), 2)) AS BIGINT) % 32 AS pos, count(*) AS n FROM w GROUP BY 1, 2)
      SELECT doc_id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM c""",
    "test_paths": r"""SELECT path, regexp_matches(replace(path, '\', '/'), '(^|/)(tests?|__tests__|spec|specs)/|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[cm]?[jt]sx?$') AS is_test
      FROM (SELECT DISTINCT split_part(id, '::', 1) AS path FROM snippets)""",
    "collection_sizes": "SELECT lang, count(*) AS n, min(length(text)) AS shortest, quantile_cont(length(text), 0.5) AS median, max(length(text)) AS longest FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "name_variants": """WITH n AS (SELECT DISTINCT unit_name, regexp_extract_all(unit_name, '[A-Za-z0-9]+') AS w FROM snippets WHERE unit_name IS NOT NULL),
      s AS (SELECT unit_name, w, list_transform(w, lambda x: lower(x)) AS l, list_transform(w, lambda x: upper(lower(x)[1]) || substr(lower(x), 2)) AS b FROM n),
      v AS (SELECT unit_name, [l[1] || array_to_string(b[2:], ''), array_to_string(b, ''), array_to_string(l, '_'), upper(array_to_string(l, '_')), array_to_string(l, '-'), array_to_string(l, ''), array_to_string(w, ' ')] AS v FROM s)
      SELECT unit_name, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS styles FROM v""",
    "route_questions": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in q) + ")" for q in QUESTIONS) + ') AS t(question, kind, phrase, second, "order")',
    "query_process": rf"""WITH b AS (SELECT item_id, text, {_S.content_tokens('text')} AS t FROM {_S.ITEMS} WHERE text IS NOT NULL),
      x AS (SELECT *, flatten(list_transform(t, lambda y: coalesce({_SYN}[y], []))) AS raw FROM b),
      e AS (SELECT *, list_filter(raw, lambda y, i: list_position(raw, y) = i AND NOT list_contains(t, y)) AS more FROM x),
      f AS (SELECT *, list_concat(list_concat(t, more), CASE WHEN len(t) > 1 THEN {_BIG} ELSE [] END) AS every,
            list_concat(regexp_extract_all(text, '{_IDENT}'), regexp_extract_all(text, '\b(\w+)\s*\(', 1)) AS ids FROM e),
      g AS (SELECT *, list_filter(list_transform(every, lambda y: regexp_replace(y, '[^a-z0-9_]', '', 'g')), lambda y: length(y) > 1) AS tm FROM f)
      SELECT item_id, {_category('text')} AS category, array_to_string(every, ' ') AS toks, array_to_string(more, ' ') AS more,
        array_to_string(list_filter(ids, lambda y, i: list_position(list_transform(ids, lambda z: lower(z)), lower(y)) = i), ' ') AS idents,
        array_to_string(list_filter(tm, lambda y, i: list_position(tm, y) = i), ' ') AS terms FROM g""",
}


def token_windows(spark, d, tokenizer="/opt/tokenizers/byte_bpe_50k.json"):
    """Windows of 256 token ids of every document."""
    from quern.operators import evaluate

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluate.token_windows(docs, tokenizer, 256, 192).groupBy("id").agg(F.count(F.lit(1)).alias("windows"))


QUERIES["token_windows"] = token_windows
