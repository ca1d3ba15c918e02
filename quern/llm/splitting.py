"""Items above a size limit, cut into pieces at natural boundaries with a stated overlap.

Method: lexical cohesion. Line ends, blank lines, sentence ends and brace lines
are the natural seams of a text. At every seam the words of a block before and
of a block behind it are compared (cosine of hashed word counts), which gives the
depth of the similarity valley there. Within the size window of each piece the
deepest valley is taken, of valleys as deep (to a tenth) the stronger seam; where
no seam is in reach the piece is cut between words at the limit. A text takes
some 30 bytes a word beside itself; the blocks are counted a stretch of seams at a time.

Words are the longest runs without Unicode white space. Equal contents are cut
once, whatever number of ids and versions holds them. A piece never exceeds the
budget, pieces cover all words, and consecutive pieces share exactly
int(budget * overlap) words (at most budget - 1).

Defined cases
  * current rows only: per (id, version) the greatest loaded_at; equal copies once,
    different rows of the same load time: the greatest content.
  * null or empty contents have no words and give no pieces, as do configurations
    with a null or non-positive budget; a null overlap or one below 0 counts as 0.
  * texts of a single line, or a single line longer than any budget, are cut between words.
  * empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import tasks

#: White space by the Unicode property, as a character class both regex dialects read alike.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(rf"[^{SPACE}]+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
BLOCK = 24
BUCKETS = 64
SLOPE = 6
#: A piece is at least this share of the budget where a seam allows a choice.
LEAST_FILL = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0))


#: Seams whose blocks are counted at once.
STRETCH = 4_096


def seams(text: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Strength of the seam before each word: 0 none, 1 end of a sentence, 2 line, 3 line after a closing brace or before a definition, 4 blank line."""
    strength = np.zeros(len(begin), np.int8)
    for k, (x, y) in enumerate(zip(end[:-1].tolist(), begin[1:].tolist(), strict=True), 1):
        gap = text[x:y]
        breaks = len(_BREAK.findall(gap)) if gap != " " else 0
        if breaks >= 2:
            strength[k] = 4
        elif breaks:
            flush = not gap[-1:].isspace() or _BREAK.fullmatch(gap[-1:]) is not None
            strength[k] = 3 if flush or text[x - 1] in "};" and text[y] != "}" else 2
        elif text[x - 1] in ".!?。！？":
            strength[k] = 1
    return strength


def _blocks(bucket: np.ndarray, at: np.ndarray, first: int, block: int) -> np.ndarray:
    """Word counts by bucket of the block of words from each gap plus ``first`` on."""
    place = at[:, None] + np.arange(first, first + block)
    inside = (place >= 0) & (place < len(bucket))
    row = np.repeat(np.arange(len(at)), block).reshape(place.shape)
    return np.bincount(row[inside] * BUCKETS + bucket[place[inside]], minlength=len(at) * BUCKETS).reshape(len(at), BUCKETS)


def valley_depths(bucket: np.ndarray, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the lexical similarity valley at each of the word gaps ``at``; bucket has the hashed words."""
    if not len(at):
        return np.zeros(0)
    sim = np.empty(len(at))
    for a in range(0, len(at), STRETCH):
        some = at[a : a + STRETCH]
        left, right = _blocks(bucket, some, -block, block), _blocks(bucket, some, 0, block)
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sim[a : a + STRETCH] = (left * right).sum(1) / np.maximum(norm, 1e-9)
    # the valley's height over the nearer slopes: the greatest similarity among a few seams on either side
    padded = np.pad(sim, SLOPE, constant_values=-1.0)
    near = np.lib.stride_tricks.sliding_window_view(padded, SLOPE)
    return np.maximum(near[: len(at)].max(1), sim) + np.maximum(near[SLOPE + 1 :].max(1), sim) - 2 * sim


def cut_points(text: str, budget: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first word, end word, first character, end character) of each piece; ends are exclusive."""
    begin, end = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2).T
    n = len(begin)
    if not n:
        return []
    overlap = max(0, min(overlap, budget - 1))
    pieces, start = [], 0
    if n > budget:
        strength = seams(text, begin, end)
        at = np.flatnonzero(strength)
        bucket = np.fromiter((zlib.crc32(m.group().lower().encode("utf-8", "surrogatepass")) % BUCKETS for m in _WORD.finditer(text)), np.uint8, n)
        score = np.round(valley_depths(bucket, at), 1) + 0.01 * strength[at]
    while n - start > budget:
        limit = start + budget
        least = max(start + overlap + 1, start + int(budget * LEAST_FILL))
        lo, hi = np.searchsorted(at, [least, limit + 1])
        if lo == hi:
            lo = np.searchsorted(at, start + overlap + 1)
        cut = int(at[lo + int(np.argmax(score[lo:hi]))]) if lo < hi else limit
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, n))
    return [(a, b, int(begin[a]), int(end[b - 1])) for a, b in pieces]


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for digest, content, configs in zip(f["digest"], f["content"], f["configs"], strict=True):
            for c in configs:
                budget, share = int(c["budget_tokens"]), c["window_overlap"]
                overlap = int(budget * share) if share is not None and share > 0 else 0
                for no, (a, b, x, y) in enumerate(cut_points(content, budget, overlap)):
                    out.append((digest, c["config_name"], no, a, b, content[x:y]))
        if out:
            yield pd.DataFrame(out, columns=["digest", "config_name", "piece_no", "first_word", "end_word", "piece"])


def pieces(snippets: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_name, id, version, piece_no, first_word, end_word, piece) of every current content above a budget."""
    usable = configs.where(F.col("budget_tokens") > 0).select(F.struct("config_name", "budget_tokens", "window_overlap").alias("c"))
    every = usable.agg(F.sort_array(F.collect_set("c")).alias("all")).scalar()
    least = usable.agg(F.min("c.budget_tokens")).scalar()
    rows = snippets.select("id", "version", "loaded_at", "content", word_count(F.col("content")).alias("n_words"))
    # short contents only take part in deciding which row is current; their text stays behind
    slim = rows.select("id", "version", "loaded_at", "n_words", F.when(F.col("n_words") > least, F.col("content")).alias("content"))
    current = (
        slim.groupBy("id", "version").agg(F.max(F.struct("loaded_at", "content", "n_words")).alias("r"))
        .where(F.col("r.content").isNotNull())
        .select("id", "version", "r.content", "r.n_words", F.sha2(F.col("r.content").cast("binary"), 256).alias("digest"))
    )
    texts = (
        current.groupBy("digest").agg(F.first("content").alias("content"), F.first("n_words").alias("n_words"))
        .withColumn("configs", every)
        .withColumn("configs", F.filter("configs", lambda c: c["budget_tokens"] < F.col("n_words")))
        .where(F.size("configs") > 0)
    )
    cut = texts.select("digest", "content", "configs").repartition(tasks(snippets.sparkSession), "digest").mapInPandas(
        _cut, "digest string, config_name string, piece_no int, first_word int, end_word int, piece string"
    )
    return current.select("id", "version", "digest").join(cut, "digest").select("config_name", "id", "version", "piece_no", "first_word", "end_word", "piece")


def oversized(snippets: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_name, id, version) of what ``pieces`` had to cut: its first pieces."""
    return pieces(snippets, configs).where(F.col("piece_no") == 0).select("config_name", "id", "version")


def soundness(snippets: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_name, id, version, n_words, within, covering): whether no piece is over the budget, and whether pieces and overlaps add up to all words."""
    rule = configs.where(F.col("budget_tokens") > 0).select(
        "config_name", "budget_tokens", F.least(F.floor(F.col("budget_tokens") * F.greatest(F.coalesce("window_overlap", F.lit(0.0)), F.lit(0.0))), F.col("budget_tokens") - 1).alias("overlap")
    ).distinct()
    length = F.col("end_word") - F.col("first_word")
    return (
        pieces(snippets, configs).join(F.broadcast(rule), "config_name").groupBy("config_name", "id", "version")
        .agg(
            F.max("end_word").cast("bigint").alias("n_words"), (F.max(length - F.col("budget_tokens")) <= 0).alias("within"),
            (F.sum(length) - F.max("overlap") * (F.count(F.lit(1)) - 1) == F.max("end_word")).alias("covering"),
        )
    )
