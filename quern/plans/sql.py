"""Pieces of DuckDB SQL the registered queries are held against."""

from __future__ import annotations

from quern.functions.text import LOW_SIGNAL, STOP_WORDS

#: The current rows of snippets.
CURRENT = "(SELECT * FROM snippets QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY loaded_at DESC NULLS LAST, content DESC NULLS LAST) = 1)"
ORDERED = "(SELECT version, row_number() OVER (ORDER BY built_at, version) AS ord FROM (SELECT version, max(built_at) AS built_at FROM versions WHERE version IS NOT NULL GROUP BY 1))"
HASH = "coalesce(nullif(lower(trim(hash, ' ' || chr(9) || chr(10) || chr(13))), ''), sha256(content), 'null content')"
ITEMS = "(SELECT item_id, max(text) AS text FROM eval_items GROUP BY 1)"


def texts(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def parts(x: str) -> str:
    """Lower-cased parts of an identifier, without look-ahead."""
    return rf"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), lambda pp: lower(pp))"


def tokens(t: str, split: bool = True) -> str:
    w = rf"regexp_extract_all(coalesce({t}, ''), '[A-Za-z_$][\p{{L}}\p{{N}}_$]*|\p{{Nd}}+')"
    if not split:
        return f"list_transform({w}, lambda x: lower(x))"
    p = parts("x")
    return f"flatten(list_transform({w}, lambda x: CASE WHEN len({p}) > 1 OR (len({p}) = 1 AND {p}[1] <> lower(x)) THEN list_prepend(lower(x), {p}) ELSE [lower(x)] END))"


def content_tokens(t: str) -> str:
    kept = f"list_filter({tokens(t)}, lambda y: NOT list_contains({texts(STOP_WORDS + LOW_SIGNAL)}, y) AND length(y) > 1)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(t)} END"


def index_terms(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda y: length(y) > 1)"


def words(t: str) -> str:
    space = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '{space}'), lambda y: y <> '')"


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
