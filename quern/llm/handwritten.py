"""Which source files nobody of the project wrote by hand: generated, minified, third-party, data.

Method: Re-Pair grammars over token sequences (``grammars``).
  * generated, tables of data: names, numbers and strings are reduced to their kind, and a grammar is inferred
    for the whole text; it is generated if the grammar's size grows no faster than with the root of the number of
    tokens (``GENERATED``), which is what rules that are used again all over do at any distance. Checks that a test
    states one after the other do not count. So is what a leading comment declares to be.
  * blobs: long literals, also wrapped over lines, whose grammars over segments of their characters save nearly
    nothing, so hexadecimal counts as well.
  * third-party: the file says so (a folder of dependencies, a name with a release number, a licence banner), or most
    of its grammar's rules are shared with such a file wherever it lies, or stand in three projects or more, or nearly
    all of two files of two projects are the same rules. For this the rules of all texts are numbered by the tokens
    they stand for and joined; one function that two projects hold makes no copied file.
  * minified: a layout without line ends and white space. This leg has no grammar: what a minifier takes away is no token.
Banners that declare a generated file count only as a leading comment, so code
that writes, mentions or configures such files is no case.

A file is a case if any of its contents in any version shows it. Equal contents
are judged once; rows with a null id or content are ignored, a content without
tokens shows nothing; contents of any length are read whole. The path is the
part of the id before '::'; the path column is not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import grammars
from quern.session import checkpoint, tasks

#: A grammar of n tokens that is no larger than GENERATED * sqrt(100 / n) * n shows generated text; from LEAST_TOKENS on.
GENERATED, LEAST_TOKENS = 0.5, 100
#: Tokens a line, the most white space and the fewest signs among the tokens of minified text.
MINIFIED_LINE, MINIFIED_SPACE, MINIFIED_SIGNS, MINIFIED_TOKENS = 60, 0.1, 0.4, 40
#: Characters of a literal that may be data; of one in pieces between commas, which may be a list of hashes; of a segment; and what a grammar may leave.
BLOB, BLOB_LIST, SEGMENT, BLOB_RATIO = 200, 1000, 128, 0.9
#: Tokens of the rules that are compared; the share of a file's rules that makes it a copy: of declared files or of several projects, and of one other file.
RULE_TOKENS, SHARED_RULES, TWIN_RULES = 12, 0.5, 0.8
#: With fewer projects the one that wrote a function would come out with the one that copied it.
LEAST_PROJECTS = 3

_TOKEN = re.compile(r"""[A-Za-z_$][\w$]*|\d[\w.]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\S""")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_WRAPPED = re.compile(r"""[A-Za-z0-9+/=_-]{24,}+(?:[\s"'`+,.()\\]{1,40}+[A-Za-z0-9+/=_-]{16,}+)*+""")
_HEX_BYTES = re.compile(r"\\x([0-9a-fA-F]{2})")
_KEYWORDS = frozenset(
    "if else for while return def class import from try except catch function const let var new func go defer static public private "
    "void int throw in not and or with as export async await null nil None this self".split()
)
_EXPECTATION = re.compile(r"(?m)^[ \t]*(?:assert\b|(?:self\.)?assert\w+\(|expect\().*$")
_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|''')")
_DECLARED = re.compile(
    r"code generated by\b.*\bdo not edit|\bgenerated by\b.*\bdo not (?:edit|modify)|automatically generated by|<auto-?generated>|auto-?generated file"
    r"|@generated\b|(?:generated|created|produced|built) (?:with|from|by)\b.*\b(?:overwritten|will be lost|do not (?:edit|modify))",
    re.I | re.S,
)
_LICENSED = re.compile(r"released under the [\w.\- ]+ licen[cs]e|/\*!.{0,80}?\bv\d+\.\d+.{0,200}?\(c\)", re.I | re.S)
#: Folders that hold dependencies, and file or folder names that carry a package's release (Java regex).
THIRD_PARTY_PATH = (
    r"(?i)(^|/)(vendor|node_modules|bower_components|third[_-]party|site-packages|jspm_packages|Pods|Godeps)/"
    r"|(^|/)[a-z][a-z_-]*-v?\d+\.\d+\.\d+([.-][^/]*)?(/|$)"
)


def token_kinds(text: str) -> np.ndarray:
    """Symbols of the tokens: kinds of names, numbers and strings; keywords, signs and words of running text as they are."""
    out, after_name = [], False
    for m in _TOKEN.findall(text):
        c = m[0]
        if c.isalpha() or c in "_$":
            keyword = m in _KEYWORDS
            out.append(zlib.crc32(m.encode("utf-8", "surrogatepass")) + 70_000 if keyword or after_name else 1)
            after_name = not keyword
            continue
        after_name = False
        out.append(2 if c.isdigit() else 3 if c in "\"'" and len(m) > 1 else ord(c) % 60_000 + 4)
    return np.array(out, np.int64)


def _literals(text: str) -> list[str]:
    """Long literals of letters and digits, put together where they are wrapped over lines."""
    found = []
    for run in _WRAPPED.findall(_HEX_BYTES.sub(r"\1", text)):
        parts = ["".join(re.findall(r"[A-Za-z0-9/=_-]+", p)) for p in run.split(",")]
        whole = "".join(parts)
        found += [whole] if len(whole) >= BLOB_LIST else [p for p in parts if len(p) >= BLOB]
    return [x for x in found if sum(c.isdigit() for c in x) >= 0.05 * len(x)]


def _incompressible(literals: list[str]) -> list[bool]:
    """Whether the grammars over segments of the characters save nearly nothing."""
    segments, owner = [], []
    for k, x in enumerate(literals):
        for part in np.array_split(np.frombuffer(x.encode(), np.uint8), max(1, len(x) // SEGMENT)):
            segments.append(part)
            owner.append(k)
    g = grammars.infer(segments)
    ratio = pd.Series((g.left + 2 * g.rules) / np.maximum(g.tokens, 1)).groupby(np.array(owner, np.int64)).median()
    return (ratio >= BLOB_RATIO).tolist()


def _leading_comment(text: str) -> str:
    kept, block, doc = [], False, False
    for line in text.lstrip("\ufeff\r\n\t ").splitlines():
        if not (_COMMENT.match(line) or block or doc):
            break
        kept.append(line)
        if len(kept) == 1:
            block, doc = line.lstrip().startswith("/*") and "*/" not in line, line.count('"""') == 1
        else:
            block, doc = block and "*/" not in line, doc and '"""' not in line
    return "\n".join(kept)


def exact_tokens(text: str) -> np.ndarray:
    """The tokens of a text behind its leading comment, each as it is."""
    body = text.lstrip("\ufeff\r\n\t ")[len(_leading_comment(text)) :]
    return np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in _TOKEN.findall(body)], np.int64)


def evidence(texts: list[str]) -> pd.DataFrame:
    """One row for each text: tokens, size of its grammar to tokens, and what it shows."""
    kinds = [token_kinds(_EXPECTATION.sub("", t) if "assert" in t or "expect" in t else t) for t in texts]
    g = grammars.infer(kinds)
    ratio = (g.left + 2 * g.rules) / np.maximum(g.tokens, 1)
    generated = (g.tokens >= LEAST_TOKENS) & (ratio < GENERATED * np.sqrt(100 / np.maximum(g.tokens, 100)))
    literals = [(k, x) for k, t in enumerate(texts) for x in _literals(t)]
    blobs = {k for (k, _), dense in zip(literals, _incompressible([x for _, x in literals]), strict=True) if dense}
    rows = []
    for k, (t, r, n) in enumerate(zip(texts, ratio, g.tokens, strict=True)):
        lines = t.count("\n") + 1
        head = _leading_comment(t)
        tight = n >= MINIFIED_TOKENS and n / lines > MINIFIED_LINE and sum(map(t.count, " \t\r\n")) < MINIFIED_SPACE * len(t)
        tight = tight and ((kinds[k] >= 4) & (kinds[k] < 60_004)).sum() >= MINIFIED_SIGNS * n
        rows.append((float(r), int(n), bool(not tight and generated[k] or _DECLARED.search(head)), bool(tight), k in blobs, bool(_LICENSED.search(head))))
    return pd.DataFrame(rows, columns=["ratio", "tokens", "generated", "minified", "blob", "licensed"])


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for a in range(0, len(f), 1000):
            part = f.iloc[a : a + 1000].reset_index(drop=True)
            seen = evidence(part["content"].tolist())
            seen.insert(0, "digest", part["digest"])
            byhand = ~(seen["generated"] | seen["minified"] | seen["blob"])
            seen["rules"] = [np.unique(r) for r in grammars.shared_rules([exact_tokens(t) if ok else _NOTHING for t, ok in zip(part["content"], byhand, strict=True)], RULE_TOKENS)]
            yield seen


_NOTHING = np.zeros(0, np.int64)


def _several(held: DataFrame) -> DataFrame:
    """(path) of files most of whose rules stand in three projects or more, or that have a twin in another project; held has (path, project, rule), distinct.

    All pairs of files of two projects count. Twins differ in few rules, so the first rule both have, counted from the one that fewest projects
    hold, is among the first few of either. Of a file that three projects alone do not give away, that rule is in two projects only, so such rules
    find the pairs, whose sets of rules are then compared whole; files of equal rules go through this once.
    """
    spread = held.groupBy("rule").agg(F.count_distinct("project").alias("projects"), F.count(F.lit(1)).alias("files"))
    ruled = held.join(spread, "rule").groupBy("path", "project").agg(
        F.sort_array(F.collect_list(F.struct("projects", "files", "rule"))).alias("ordered"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("projects") >= LEAST_PROJECTS).alias("many")
    )
    first = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(TWIN_RULES * F.col("n")) + 1).cast("int"))
    lead = F.transform(F.filter(first, lambda x: x["projects"] == 2), lambda x: x["rule"])
    # one function that several projects hold makes no copied file: most rules of the file must be theirs
    known = ruled.select(
        "path", "project", "n", ((F.col("many") >= 2) & (F.col("many") >= SHARED_RULES * F.col("n"))).alias("several"),
        F.when(F.col("n") >= 2, lead).otherwise(F.array().cast("array<bigint>")).alias("lead"), F.col("ordered.rule").alias("rules"),
    ).where(F.col("several") | (F.size("lead") > 0))
    known = checkpoint(known.withColumn("rules", F.when(F.size("lead") > 0, F.col("rules"))).withColumn("set", F.sha2(F.array_join(F.col("rules").cast("array<string>"), ","), 256)))
    # in two projects alone: nearly all rules of either file must be those of the other
    sets = known.where(F.size("lead") > 0).groupBy("set").agg(
        F.first("n").alias("n"), F.min("project").alias("low"), F.max("project").alias("high"), F.first("lead").alias("lead"), F.first("rules").alias("rules")
    )
    keyed = sets.select("set", "n", "low", "high", F.explode("lead").alias("rule"))
    same = (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    pairs = (
        keyed.alias("a").join(keyed.alias("b"), F.col("a.rule") == F.col("b.rule"))
        .where((F.col("a.set") < F.col("b.set")) & ~same & (F.least("a.n", "b.n") >= TWIN_RULES * F.greatest("a.n", "b.n")))
        .select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct()
    )
    sized = pairs.join(sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("rules").alias("rules_a")), "a")
    sized = sized.join(sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("rules").alias("rules_b")), "b")
    sized = sized.withColumn("shared", F.size(F.array_intersect("rules_a", "rules_b")))
    alike = sized.where((F.col("shared") >= 2) & (F.col("shared") >= TWIN_RULES * F.greatest("n_a", "n_b"))).select(F.explode(F.array("a", "b")).alias("set"))
    twins = known.select("path", "set").join(alike.unionByName(sets.where("low <> high").select("set")).distinct(), "set", "left_semi")
    return known.where("several").select("path").unionByName(twins.select("path")).distinct()


def file_evidence(snippets: DataFrame) -> DataFrame:
    """(path, generated, minified, blob, third_party): what the contents of each file show."""
    rows = snippets.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select(
        F.split_part("id", F.lit("::"), F.lit(1)).alias("path"), "content", F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest")
    )
    files = rows.select("path", "digest").distinct().withColumn("declared", F.col("path").rlike(THIRD_PARTY_PATH))
    judged = (
        rows.groupBy("digest").agg(F.first("content").alias("content")).repartition(tasks(snippets.sparkSession), "digest")
        .mapInPandas(_judge, "digest binary, ratio double, tokens bigint, generated boolean, minified boolean, blob boolean, licensed boolean, rules array<bigint>")
    )
    declared = files.groupBy("digest").agg(F.max("declared").alias("declared"))
    known = checkpoint(judged.join(declared, "digest").select("digest", "generated", "minified", "blob", (F.col("declared") | F.col("licensed")).alias("origin"), "rules"))
    rules = known.select("digest", "origin", F.size("rules").alias("n"), F.explode("rules").alias("rule"))
    held = files.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), "digest").join(rules.select("digest", "rule"), "digest").select("path", "project", "rule").distinct()
    shared = rules.where("origin").select("rule").distinct()
    copied = (
        rules.where(~F.col("origin")).join(shared, "rule", "left_semi")
        .groupBy("digest").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
        .where((F.col("shared") >= 2) & (F.col("shared") >= SHARED_RULES * F.col("n")))
        .select("digest", F.lit(True).alias("copy"))
    )
    several = _several(held).withColumn("several", F.lit(True))
    shows = known.select("digest", "generated", "minified", "blob", "origin").join(copied, "digest", "left")
    return (
        files.join(shows, "digest").join(several, "path", "left").groupBy("path")
        .agg(
            F.max("generated").alias("generated"), F.max("minified").alias("minified"), F.max("blob").alias("blob"),
            F.max(F.col("declared") | F.col("origin") | F.coalesce("copy", "several", F.lit(False))).alias("third_party"),
        )
    )


def not_written_by_hand(snippets: DataFrame) -> DataFrame:
    """(path) of the files that are generated, minified, data or of third parties."""
    return file_evidence(snippets).where("generated OR minified OR blob OR third_party").select("path")
