"""Feature reranking of a shortlist (RET-10, 12..16) and the search pipeline (RET-8)."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.text import strings
from quern.operators.dense import ranked
from quern.operators.sparse import inverse_frequency

# The snippet categories each kind of question favours.
AFFINITY = {
    "algorithmic": ["algorithm", "data_structure"],
    "identifier_led": ["utility", "class_method", "algorithm", "io", "data_structure"],
    "structural": ["class_method", "utility"],
    "behavioural": ["utility", "io", "algorithm"],
}


@dataclass(frozen=True)
class Weights:
    """Weights of the features; ``off`` leaves the shortlist as it is."""

    enabled: bool = True
    coverage: float = 0.50
    idf_coverage: float = 1.00
    phrase: float = 0.35
    proximity: float = 0.25
    head: float = 0.30
    structural: bool = True
    category: float = 0.15
    identifier: float = 0.10
    length_cap: float = 0.10
    length_scale: float = 2000.0
    base: float = 1.0

    @classmethod
    def off(cls) -> Weights:
        return cls(enabled=False, structural=False)


def phrase_hits(doc: Column, query: Column) -> Column:
    """Neighbouring document tokens that are neighbours in the query."""
    return T.let(F.array_distinct(T.bigrams(query)), lambda pairs: F.size(F.filter(T.bigrams(doc), lambda p: F.array_contains(pairs, p))))


def proximity(doc: Column, matched: Column) -> Column:
    """Matched terms over the smallest window that holds all of them: 1 for a single place, 0.5 for a single term, 0 for none.

    One fold over the places of matched terms keeps the last place of each term;
    at each place the window reaches back to the oldest of these.
    """
    places = F.filter(F.transform(doc, lambda t, i: F.struct(i.alias("i"), F.array_position(matched, t).cast("int").alias("m"))), lambda p: p["m"] > 0)
    n = F.size(F.array_intersect(matched, doc))
    start = F.struct(F.array_repeat(F.lit(-1), n.cast("int")).alias("last"), F.lit(2**31 - 1).alias("best"))

    def step(s: Column, p: Column) -> Column:
        last = F.transform(s["last"], lambda x, k: F.when(k + 1 == p["m"], p["i"]).otherwise(x))
        oldest = F.array_min(last)
        return F.struct(last.alias("last"), F.when(oldest >= 0, F.least(s["best"], p["i"] - oldest + 1)).otherwise(s["best"]).alias("best"))

    best = F.aggregate(places, start, step)["best"]
    return (
        F.when(F.size(places) == 0, 0.0).when(F.size(places) == 1, 1.0).when(n < 2, 0.5)
        .otherwise(n / F.greatest(n, best))
    )


def features(shortlist: DataFrame, docs: DataFrame, queries: DataFrame, idf: DataFrame, w: Weights = Weights()) -> DataFrame:
    """shortlist (query_id, id, rank_no) with coverage, idf_coverage, phrase, proximity, head and interaction.

    docs (id, text), queries (query_id, terms), idf (term, idf).
    """
    q = queries.select("query_id", F.array_distinct(F.filter("terms", lambda t: F.length(t) > 1)).alias("q"))
    weights = q.select("query_id", F.explode("q").alias("term")).join(idf, "term", "left").groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("idf", F.lit(0.0)).alias("w")))).alias("w")
    )
    head = T.index_terms(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\R"), 1, 6), "\n"))
    terms = docs.select("id", T.index_terms(F.col("text")).alias("d"), head.alias("h"))
    rows = shortlist.join(terms, "id", "left").join(q.join(weights, "query_id", "left"), "query_id", "left")
    kinds = {c: shortlist.schema[c].dataType.simpleString() for c in ("query_id", "id", "rank_no")}
    names = ("coverage", "idf_coverage", "phrase", "proximity", "head")
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", " + ", ".join(f"{c} double" for c in names)
    found = rows.select("query_id", "id", "rank_no", "d", "h", "q", F.map_keys("w").alias("wk"), F.map_values("w").alias("wv")).mapInPandas(_features, schema).withColumns({c: F.round(c, 6) for c in names})
    inter = w.coverage * F.col("coverage") + w.idf_coverage * F.col("idf_coverage") + w.phrase * F.col("phrase") + w.proximity * F.col("proximity") + w.head * F.col("head")
    return found.withColumn("interaction", F.round(F.round(inter, 9), 6))  # the noise of the sum goes first, so that ties are rounded alike everywhere


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of question and document terms in batches: sets and one pass over the places, where array functions would compare all with all."""
    for f in frames:
        if not len(f):
            continue
        out = []
        for d, h, q, keys, values in zip(f["d"], f["h"], f["q"], f["wk"], f["wv"], strict=True):
            if d is None or q is None or not len(d) or not len(q):
                out.append((0.0,) * 5)
                continue
            weight = dict(zip(keys, values, strict=True)) if keys is not None else {}
            terms, doc = dict.fromkeys(q), set(d)
            matched = [t for t in terms if t in doc]
            total = sum(weight.get(t, 0.0) for t in terms) or 1.0
            wanted = set(zip(q, q[1:], strict=False))
            pairs = sum(p in wanted for p in zip(d, d[1:], strict=False))
            heads = set(h)
            out.append((
                len(matched) / len(terms), sum(weight.get(t, 0.0) for t in matched) / total, min(1.0, pairs / 3.0), _nearest(d, set(matched)),
                sum(t in heads for t in terms) / len(terms),
            ))
        values = pd.DataFrame(out, columns=["coverage", "idf_coverage", "phrase", "proximity", "head"], dtype="float64")
        for at, c in enumerate(("query_id", "id", "rank_no")):
            values.insert(at, c, f[c].tolist())
        yield values


def _nearest(doc: Iterable[str], matched: set[str]) -> float:
    """As ``proximity``: the last place of each term, and at each place how far the oldest of these lies back."""
    last: OrderedDict[str, int] = OrderedDict()
    best, places = None, 0
    for i, t in enumerate(doc):
        if t in matched:
            places += 1
            last[t] = i
            last.move_to_end(t)
            if len(last) == len(matched):
                span = i - next(iter(last.values())) + 1
                best = span if best is None or span < best else best
    if places < 2:
        return float(places)
    return 0.5 if len(matched) < 2 else len(matched) / max(len(matched), best)


def structural(kind: Column, category: Column, idents: Column, query_idents: Column, query_terms: Column, length: Column, corpus_kind: str = "", w: Weights = Weights()) -> Column:
    """Adjustment by category, identifiers and length."""
    if not w.structural:
        return F.lit(0.0)
    expected = F.create_map(*[x for k, v in AFFINITY.items() for x in (F.lit(k), strings(*v))])
    boost = F.lit(0.0) if corpus_kind == "repo" else F.when(F.array_contains(expected[kind], category), w.category).otherwise(0.0)
    lower = F.transform(query_idents, F.lower)
    parts = F.array_distinct(F.flatten(F.transform(idents, T.subwords)))
    named = F.when(F.arrays_overlap(idents, lower), w.identifier).when(F.size(F.array_intersect(parts, query_terms)) >= 2, w.identifier * 0.5).otherwise(0.0)
    penalty = F.least(F.coalesce(length, F.lit(0)) / w.length_scale, F.lit(1.0)) * w.length_cap
    return boost + F.when(F.size(idents) > 0, named).otherwise(0.0) - penalty


def reranked(feats: DataFrame, adjustment: Column | None = None, k: int = 10, w: Weights = Weights()) -> DataFrame:
    """(query_id, id, score, rank_no): base by first rank, interaction and adjustment."""
    if not w.enabled:
        return feats.where(F.col("rank_no") <= k)
    base = w.base / (1.0 + (F.col("rank_no") - 1) / 10.0)
    score = base + F.col("interaction") + (adjustment if adjustment is not None else F.lit(0.0))
    return ranked(feats.select("query_id", "id", F.round(score, 6).alias("score")), k)


def term_weights(df: DataFrame, n_docs: Column) -> DataFrame:
    """(term, idf) of document frequencies (term, n)."""
    return df.withColumn("n_docs", n_docs).select("term", F.round(inverse_frequency(F.col("n_docs"), F.col("n")), 6).alias("idf"))
