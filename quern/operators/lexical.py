"""Questions about code lines and names (LEX-1..8, QRY-9..11)."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions import queries as Q

LINE = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"


def code_lines(snippets: DataFrame) -> DataFrame:
    """(unit, line, id, n_lines, text) of every line of snippets (id, content); the unit is the path of path::name#line."""
    split = F.split("content", LINE)
    every = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(1)))).otherwise(split)
    start = F.coalesce(F.expr("CASE WHEN contains(id, '#') THEN try_cast(split_part(id, '#', -1) AS int) END"), F.lit(1))
    unit = F.when(F.col("id").contains("::"), F.split_part("id", F.lit("::"), F.lit(1))).otherwise(F.col("id"))
    rows = snippets.where(F.col("content").isNotNull()).select("id", unit.alias("unit"), start.alias("start"), every.alias("lines"))
    return rows.select("id", "unit", "start", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "text")).select(
        "unit", (F.col("start") + F.col("pos")).alias("line"), "id", "n_lines", "text"
    )


def _innermost(lines: DataFrame) -> DataFrame:
    """One row for each line of a unit: that of the shortest snippet, then the smallest id."""
    best = F.min(F.struct("n_lines", "id", "text")).alias("b")
    return lines.groupBy("unit", "line").agg(best).select("unit", "line", "b.id", F.trim("b.text").alias("text"))


def _whole(term: str) -> str:
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    return rf"(?U)\b{quoted}\b" if re.fullmatch(r"\w+", term) else quoted


def uses(snippets: DataFrame, term: str) -> DataFrame:
    """(unit, line, id, text) of the lines that mention a term; a word only as a whole."""
    return _innermost(code_lines(snippets.where(F.contains("content", F.lit(term)))).where(F.col("text").rlike(_whole(term))))


def _call(name: str) -> str:
    return rf"(?<![\w$]){re.escape(name.rsplit('.', 1)[-1])}\s*\("


#: Keywords that define the name behind them, the modifiers they may have before them, and what stands between them and the name.
_DEFINING = [("async", "def", r"\s+", r"\b"), ("", "class", r"\s+", r"\b"), ("export default async", "function", r"\s*\*?\s*", r"\b")]
_DEFINING += [("export", k, r"\s+", r"\s*=") for k in ("const", "let", "var")]


def _definition(name: str) -> str:
    """A line that defines a name: by a keyword, as a member with a body, or by giving it a function or, at the line's start, any value."""
    n = re.escape(name.rsplit(".", 1)[-1])

    def perhaps(words: str) -> str:
        return "".join(rf"(?:{w}\s+)?" for w in words.split())

    by_keyword = [rf"\s*{perhaps(before)}{keyword}{gap}{n}{end}" for before, keyword, gap, end in _DEFINING]
    member = rf"\s*{perhaps('static async')}\*?{n}\s*\([^)]*\)\s*\{{"
    given = rf"\s*{n}\s*[:=]\s*{perhaps('async')}(?:function\b|\()"
    return "^(?:" + "|".join([*by_keyword, member, given, rf"{n}\s*="]) + ")"


def callers(snippets: DataFrame, name: str) -> DataFrame:
    """(unit, line, id, text) of the lines that call a name and do not define it."""
    rows = code_lines(snippets.where(F.contains("content", F.lit(name.rsplit(".", 1)[-1]))))
    return _innermost(rows.where(F.col("text").rlike(_call(name)) & ~F.col("text").rlike(_definition(name))))


def definitions(snippets: DataFrame, name: str) -> DataFrame:
    """(unit, line, id, text) of the lines that define a name."""
    return _innermost(code_lines(snippets.where(F.contains("content", F.lit(name.rsplit(".", 1)[-1])))).where(F.col("text").rlike(_definition(name))))


def calls_before(snippets: DataFrame, first: str, second: str) -> DataFrame:
    """(unit, first_line, second_line, id) of snippets whose first call of one name stands before the first of another."""
    lines = code_lines(snippets.where(F.contains("content", F.lit(first)) & F.contains("content", F.lit(second))))
    g = lines.groupBy("unit", "id", "n_lines").agg(
        F.min(F.when(F.col("text").rlike(_call(first)), F.col("line"))).alias("first_line"),
        F.min(F.when(F.col("text").rlike(_call(second)), F.col("line"))).alias("second_line"),
    )
    hits = g.where(F.col("first_line") < F.col("second_line"))
    return hits.groupBy("unit", "first_line", "second_line").agg(F.min(F.struct("n_lines", "id")).alias("b")).select("unit", "first_line", "second_line", "b.id")


_NAME = r"[A-Za-z_$][\w$]*+"
#: Names with the members behind them, and literals of 2 to 200 characters on a line in any quotes; possessive, so that Java matches them in loops.
IDENTIFIERS = rf"{_NAME}(?:\.{_NAME})*+"
LITERALS = "|".join(rf"{q}(?:[^{q}\\\n]|\\.){{2,200}}+{q}" for q in "'\"`")


def vocabulary(snippets: DataFrame) -> DataFrame:
    """(name, kind, n, norm): how often identifiers and string literals stand in snippets (content)."""
    names = F.regexp_extract_all("content", F.lit(IDENTIFIERS), F.lit(0))
    quoted = F.transform(F.regexp_extract_all("content", F.lit(LITERALS), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    kinds = F.array(F.struct(F.lit("identifier").alias("kind"), names.alias("names")), F.struct(F.lit("string").alias("kind"), quoted.alias("names")))
    found = snippets.select(F.explode(kinds).alias("k")).select(F.explode("k.names").alias("name"), "k.kind")
    return found.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", Q.normal_form(F.col("name")))


def neighbours(vocab: DataFrame, name: str) -> DataFrame:
    """(name) of the other names with the same normal form."""
    return vocab.where((Q.normal_form(F.lit(name)) == F.col("norm")) & (F.col("name") != name)).select("name").distinct()


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def resolve(vocab: DataFrame, phrases: DataFrame, limit: int = 6) -> DataFrame:
    """(phrase, name, how, score, place): the names a phrase may mean, best first, by the first tier that has any.

    Tiers: quoted, exact, variant (equal normal form), contains (all words, at most
    three times as long), fuzzy (likeness 0.8 or more). Candidates of the last two
    share two neighbouring letters with the phrase, found by hash join: of names of a
    likeness of 0.8 the blocks that match are longer than a letter on average, so none
    is missed. Words of a single letter are no pieces; a phrase of such words alone has no name of the last two tiers.
    """
    names = vocab.groupBy("name", "norm").agg(F.sum("n").alias("freq"))
    p = phrases.select("phrase", F.trim("phrase").alias("p")).distinct()
    p = p.withColumn("words", F.regexp_extract_all("p", F.lit("[A-Za-z0-9]+"), F.lit(0))).withColumn("key", Q.normal_form(F.array_join("words", "")))
    quoted = p.where(F.col("p").rlike(r"""^(['"`]).*\1$""") & (F.length("p") >= 2)).select("phrase", F.expr("substring(p, 2, length(p) - 2)").alias("name"), F.lit("quoted").alias("how"), F.lit(5.0).alias("score"), F.lit(0).cast("bigint").alias("freq"))
    rest = p.join(quoted.select("phrase"), "phrase", "left_anti")
    exact = rest.join(names, rest.p == names.name).select("phrase", "name", F.lit("exact").alias("how"), F.lit(4.0).alias("score"), "freq")
    variant = rest.where("key <> ''").join(names, rest.key == names.norm).select("phrase", "name", F.lit("variant").alias("how"), F.lit(3.0).alias("score"), "freq")
    long = rest.where(F.length("key") >= 4)

    def pieces(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))

    left = long.select("phrase", "words", "key", F.explode(pieces(F.col("key"))).alias("piece"))
    right = names.where(F.length("norm") >= 2).select("name", "norm", "freq", F.explode(pieces(F.col("norm"))).alias("piece"))
    near = left.join(right, "piece").groupBy("phrase", "words", "key", "name", "norm", "freq").agg(F.count(F.lit(1)).alias("shared"))
    holds = F.forall("words", lambda w: F.contains(F.col("norm"), F.lower(w))) & (F.length("norm") <= 3 * F.length("key"))
    contains = near.where(holds).select("phrase", "name", F.lit("contains").alias("how"), (2.0 - (F.length("norm") - F.length("key")) / 100).alias("score"), "freq")
    # a likeness of 0.8 bounds the lengths and the edits, so most candidates need no comparison
    fit = near.where(~holds & (F.length("norm").between(F.length("key") * 0.66, F.length("key") * 1.5)) & (F.levenshtein("key", "norm") <= F.greatest(F.length("key"), F.length("norm")) * 0.4))
    fuzzy = fit.withColumn("like", _likeness(F.col("key"), F.col("norm"))).where("like >= 0.8").select("phrase", "name", F.lit("fuzzy").alias("how"), (1.0 + F.col("like") / 10).alias("score"), "freq")
    tier = F.when(F.col("how") == "quoted", 0).when(F.col("how") == "exact", 1).when(F.col("how") == "variant", 2).when(F.col("how") == "contains", 3).otherwise(4)
    every = quoted.unionByName(exact).unionByName(variant).unionByName(contains).unionByName(fuzzy).withColumn("tier", tier)
    first = every.withColumn("best", F.min("tier").over(W.partitionBy("phrase"))).where("tier = best")
    w = W.partitionBy("phrase").orderBy(F.col("score").desc(), F.col("freq").desc(), "name")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("phrase", "name", "how", F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place"))


def most_called(snippets: DataFrame) -> DataFrame:
    """(name, snippets): called names by the number of snippets that call them; snippets (id, content)."""
    from quern.functions.code import calls

    none = F.array().cast("array<string>")
    return snippets.select("id", F.explode(F.array_distinct(calls(F.col("content"), none))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("snippets"))


def routed(questions: DataFrame) -> DataFrame:
    """(question, kind, phrase, second, order): null kind for a ranked search."""
    r = Q.route(F.col("question"))
    return questions.select("question", r.alias("r")).select("question", "r.kind", "r.phrase", "r.second", "r.order")
