"""Evaluation texts that stand, wholly or partly, in a corpus.

Method: template canonicalisation. Every word has a plain form and, where it is
a number, a unit or a name (by its build and case alone), a typed placeholder.
Windows of four words are hashed in both forms, on both sides, and joined by
hash: slim keys of the documents against slim keys of the held-out texts. Hits
are counted per document, text and diagonal; where they suffice, the words of
both sides are aligned along the diagonal and the slots are checked: a number,
or a word no other held-out text has, that stands differently in the document
counts against the match far more than a light edit does, which is what parts a
copied passage from a re-parameterised question.

Everything is a join; nothing of the corpus is collected, and the plan and the
number of reads of the corpus (once for its windows, once for the texts of the
candidates) do not depend on the number of items. The windows of the items are
broadcast if their counted number allows it, and joined by shuffle beyond; so
are the words of the items for the alignment.

A window leads to every text that has it, however many these are: a passage that
many held-out texts share is one of each of them. Stock sentences are no cases
because they are shorter than ``least_words``, which the alignment counts.

Defined cases
  * null, empty and blank texts match nothing; so do items of fewer than
    ``least_words`` words. Repeated item rows count once; several texts under one
    item_id are all searched; equal texts under several item_ids give a case each.
  * case, white space, punctuation, escaped line breaks, format characters,
    look-alike letters of another script and words broken by a stray space do not matter.
  * an item whose passages stand in several places of a document, or in another
    order, is one case if together they make up ``least_words``.
  * documents of any length are read whole; the alignment is a band along the diagonal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.session import spread, tasks

WINDOW = 4
LEAST_WORDS = 20
#: What the passages must score: for each word, or in all; and what a single piece must score.
WORD_SCORE, LEAST_SCORE, PIECE_SCORE = 0.5, 13.0, 8.0
#: Places at which a document must have windows of a text (20 words of which one in six is edited keep at least five windows wherever the edits stand).
LEAST_HITS = 5
#: Diagonals that count together; document words after which hits count anew (one bit each); words a passage may drift from its diagonal.
LANE, STRETCH, DRIFT = 8, 64, 12
EDIT, GAP, SLOT = 2.0, 1.5, 4.0
#: Words beside the hits that are aligned with them; farther ones would have hits of their own.
MARGIN = 14
#: Windows, and words, of all items that tasks are given at once; candidate texts of a document that are aligned in one row.
MOST_BROADCAST, TOGETHER = 2_000_000, 256

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнοαερνικτυ", "aeopcyxijsdhkmtbhoaepviktu")
_WORDS = re.compile(r"\w+")
_ESCAPES = re.compile(r"\\[nrt]")
#: Units of measure (fixed values).
_UNITS = frozenset("mm cm m km mg g kg t ml l s ms us ns sec min h hr b kb mb gb tb kib mib gib hz khz mhz ghz px pt em v kv w kw mw kwh usd eur gbp percent".split())
_NUMBER, _NAME, _UNIT = "#", "@", "%"


def raw_words(text: str) -> list[str]:
    """Words in their own case: NFKC, without format characters, look-alikes folded."""
    t = _ESCAPES.sub(" ", text) if "\\" in text else text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in t if unicodedata.category(c) != "Cf").translate(_LOOKALIKES)
    return _WORDS.findall(t)


def words_of(text: str) -> list[str]:
    """Words as they are compared."""
    return [w.lower().translate(_LOOKALIKES) for w in raw_words(text)]


def placeholder(word: str) -> str | None:
    """The typed placeholder a word of a text stands for, if any."""
    if word[0].isdigit():
        return _NUMBER
    if word.lower() in _UNITS:
        return _UNIT
    return _NAME if word[0].isupper() and not word.isupper() else None


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class _Codes(dict):
    """Word to (code of its plain form, code of its template form); forgets everything when it grows too large."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        plain = _hash(word.lower().translate(_LOOKALIKES))
        sign = placeholder(word)
        self[word] = plain, plain if sign is None else _hash(sign + "\0")
        return self[word]


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def windows(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the plain windows, keys of the template windows, number of windows of each text), texts one after the other.

    The template key is 0 where it would be the plain one, or has fewer than two words beside its placeholders.
    """
    found = [raw_words(t) for t in texts]
    size = np.array([len(w) for w in found], np.int64)
    pairs = np.array([codes[w] for words in found for w in words], np.uint64).reshape(-1, 2)
    n = max(0, len(pairs) - WINDOW + 1)
    plain, template, slots = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(WINDOW):
        part = pairs[k : k + n]
        plain += (part[:, 0] ^ (part[:, 0] >> np.uint64(29))) * _STEP[k]
        template += (part[:, 1] ^ (part[:, 1] >> np.uint64(29))) * _STEP[k]
        slots += part[:, 0] != part[:, 1]
    plain, template = plain ^ (plain >> np.uint64(32)), template ^ (template >> np.uint64(32))
    template[(slots == 0) | (slots > WINDOW - 2)] = 0
    # windows do not reach from one text into the next
    at = np.arange(len(pairs))
    end = np.repeat(np.cumsum(size), size)
    keep = (at + WINDOW <= end)[:n]
    return plain[keep].view(np.int64), template[keep].view(np.int64), np.maximum(size - WINDOW + 1, 0)


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, text -> key, the keys of its windows: plain ones, then template ones."""
    codes = _Codes()
    for f in frames:
        for lo in range(0, len(f), 500):
            part = f.iloc[lo : lo + 500]
            plain, template, n = windows([t if isinstance(t, str) else "" for t in part["text"]], codes)
            cut = np.cumsum(n)[:-1]
            keys = [np.concatenate(x) for x in zip(np.split(plain, cut), np.split(template, cut), strict=True)]
            yield pd.DataFrame({"key": part["key"], "windows": keys})


def _window_rows(rows: DataFrame) -> DataFrame:
    """(key, at, window) of rows (key, text)."""
    kind = rows.schema["key"].dataType.simpleString()
    keyed = rows.mapInPandas(_keys, f"key {kind}, windows array<bigint>").where(F.size("windows") > 0)
    places = keyed.select("key", F.size("windows").alias("n"), F.posexplode("windows").alias("at", "window")).where("window <> 0")
    return places.select("key", F.expr("at % (n div 2)").alias("at"), "window")


# alignment


def _mended(words: list[str], known: set[str]) -> tuple[list[str], np.ndarray]:
    """The words, and the new place of each: those a stray space or escape broke are joined where only the whole is a word of the items."""
    out, place, k = [], np.zeros(len(words) + 1, np.int64), 0
    while k < len(words):
        w = words[k]
        place[k] = len(out)
        if k + 1 < len(words) and w + words[k + 1] in known and not (w in known and words[k + 1] in known):
            place[k + 1] = len(out)
            out.append(w + words[k + 1])
            k += 2
            continue
        out.append(w)
        k += 1
    place[len(words)] = len(out)
    return out, place


def _align(jobs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> list[tuple[float, int, int, int, int]]:
    """Best local alignment of each job, within DRIFT of its diagonal: (score, first and end item word, first and end document word).

    A job has the item's codes, which are its own, which are numbers, the document's codes, which are numbers, and the diagonal (document minus item place).
    """
    out: list[tuple[float, int, int, int, int]] = [(0.0, 0, 0, 0, 0)] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda k: len(jobs[k][0]))
    width = 2 * DRIFT + 1
    slope = (GAP * np.arange(width)).astype(np.float32)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * len(jobs[order[hi]][0]) <= 60_000:
            hi += 1
        some = order[lo:hi]
        lo = hi
        long = max(len(jobs[k][0]) for k in some)
        a = np.full((long, len(some)), -1, np.int64)
        own, number = np.zeros((long, len(some)), bool), np.zeros((long, len(some)), bool)
        b, digit = np.full((len(some), long + width), -2, np.int64), np.zeros((len(some), long + width), bool)
        for c, k in enumerate(some):
            x, o, n, y, d, diagonal = jobs[k]
            a[: len(x), c], own[: len(x), c], number[: len(x), c] = x, o, n
            first = diagonal - DRIFT  # the document word at the left edge of the item's first row
            u, v = max(0, -first), max(0, first)
            m = min(b.shape[1] - u, len(y) - v)
            if m > 0:
                b[c, u : u + m], digit[c, u : u + m] = y[v : v + m], d[v : v + m]
        drop = np.where(own | number, SLOT - 1, GAP).astype(np.float32)
        s = np.zeros((long + 1, len(some), width + 1), np.float32)
        gains = np.empty((long, len(some), width), np.float32)
        for i in range(long):
            y, d = b[:, i : i + width], digit[:, i : i + width]
            gain = np.where(y == a[i][:, None], 1.0, -np.where((number[i][:, None] & d) | own[i][:, None], SLOT, EDIT)).astype(np.float32)
            gain[(y == -2) | (a[i] == -1)[:, None]] = -1e3
            gains[i] = gain
            row = np.maximum(s[i][:, 1:] - drop[i][:, None], 0)
            np.maximum(row, s[i][:, :-1] + gain, out=row)
            s[i + 1][:, :-1] = np.maximum.accumulate(row + slope, axis=1) - slope
            s[i + 1][a[i] == -1] = 0
        for c, k in enumerate(some):
            i, j = np.unravel_index(int(np.argmax(s[:, c])), (long + 1, width + 1))
            score, end = float(s[i, c, j]), (int(i), int(j))
            while i and s[i, c, j] > 1e-4:
                if abs(s[i, c, j] - (s[i - 1, c, j] + gains[i - 1, c, j])) < 1e-3:
                    i -= 1
                elif abs(s[i, c, j] - (s[i - 1, c, j + 1] - drop[i - 1, c])) < 1e-3:
                    i, j = i - 1, j + 1
                elif j and abs(s[i, c, j] - (s[i, c, j - 1] - GAP)) < 1e-3:
                    j -= 1
                else:
                    break
            shift = jobs[k][5] - DRIFT
            out[k] = score, int(i), end[0], int(i + j + shift), int(end[0] + end[1] + shift)
    return out


def regions(hits: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first and last document word, diagonal) of hits (first word, last word, diagonal, number) that lie near each other."""
    out: list[list[int]] = []
    for first, last, diagonal, n in sorted(hits):
        for r in out:
            if abs(diagonal - r[2]) <= LANE and first <= r[1] + STRETCH // 2:
                if n > r[3]:
                    r[2], r[3] = diagonal, n
                r[1] = max(r[1], last)
                break
        else:
            out.append([first, last, diagonal, n])
    return [(a, b, d) for a, b, d, _ in out]


Candidate = tuple[list[str], set[str], list[tuple[int, int, int, int]]]


def leaked(pairs: list[tuple[list[str], list[Candidate]]], least_words: int = LEAST_WORDS) -> list[list[tuple[int, float]]]:
    """For each document's words and its candidates (words, own words, hits): (words carried, score) of each; (0, 0) for none."""
    jobs, place = [], []
    codes: dict[str, int] = {}
    read_items: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    for d, (doc, candidates) in enumerate(pairs):
        known = {w for item, _, _ in candidates for w in item}
        for w in known:
            codes.setdefault(w, len(codes))
        words, moved = _mended(doc, known)
        y = np.array([codes[w] if w in known else -1 for w in words], np.int64)
        present = np.zeros(len(codes) + 1, bool)  # the last place is that of words no item has
        digit = np.array([w[0].isdigit() for w in words], bool)
        for c, (item, own, hits) in enumerate(candidates):
            one = tuple(item)
            if one not in read_items:
                mine, number = np.array([w in own for w in item]), np.array([w[0].isdigit() for w in item])
                # the least that a word costs that is not in the document
                read_items[one] = np.array([codes[w] for w in item]), mine, number, np.where(mine, SLOT - 1, np.where(number, EDIT, GAP))
            x, mine, number, cost = read_items[one]
            mine_jobs, shared, bound = [], np.zeros(len(x), bool), 0.0
            for first, last, diagonal in regions(hits):
                shift = int(moved[min(first, len(doc))]) - first
                lo, hi = max(0, first + shift - MARGIN), min(len(words), int(moved[min(last + WINDOW, len(doc))]) + MARGIN)
                p = max(0, lo - shift - diagonal - 4)
                q = min(len(item), hi - shift - diagonal + 4)
                if p < q:
                    near = y[lo:hi]
                    present[near] = True
                    here = present[x[p:q]]
                    present[near] = False
                    # no alignment scores more than the best stretch of the item does if every word found here stands in its place
                    if np.count_nonzero(here) < PIECE_SCORE:
                        continue
                    worth = np.cumsum(np.where(here, 1.0, -cost[p:q]))
                    most = float((worth - np.minimum(np.minimum.accumulate(worth), 0)).max())
                    if most < PIECE_SCORE - 0.01:
                        continue
                    bound += most
                    shared[p:q] |= here
                    mine_jobs.append(((x[p:q], mine[p:q], number[p:q], near, digit[lo:hi], diagonal + shift - lo + p), (d, c, p, lo)))
            # a word that is left out costs as much as a word and a half, so a score of half a word each needs four words in five
            if shared.sum() >= 0.8 * least_words and bound >= min(LEAST_SCORE, WORD_SCORE * least_words) - 0.01:
                jobs += [j for j, _ in mine_jobs]
                place += [at for _, at in mine_jobs]
    passages: dict[tuple[int, int], list[tuple[float, int, int, int, int]]] = {}
    for (d, c, p, lo), (score, i0, i1, j0, j1) in zip(place, _align(jobs), strict=True):
        if score >= PIECE_SCORE:
            passages.setdefault((d, c), []).append((score, p + i0, p + i1, lo + j0, lo + j1))
    out = []
    for d, (doc, candidates) in enumerate(pairs):
        row = []
        for c, (item, _, _) in enumerate(candidates):
            if (d, c) not in passages:
                row.append((0, 0.0))
                continue
            taken, read, total = np.zeros(len(item), bool), np.zeros(len(doc) + 1, bool), 0.0
            for score, a, b, x, y in sorted(passages[d, c], reverse=True):
                fresh = min((~taken[a:b]).sum() / max(1, b - a), (~read[x:y]).sum() / max(1, y - x))
                if fresh >= 0.5:  # of passages that overlap, what the better ones leave counts
                    taken[a:b] = read[x:y] = True
                    total += score * fresh
            n = int(taken.sum())
            row.append((n, total) if n >= least_words and total >= min(LEAST_SCORE, WORD_SCORE * n) else (0, 0.0))
        out.append(row)
    return out


def _candidates(column: pa.ListArray, held: dict[int, tuple[list[str], set[str]]] | None) -> list[list[tuple[int, Candidate]]]:
    """The candidates of each document of a batch: the text's key, its words, its own words and the hits."""
    pairs = column.flatten()
    hits = pairs.field("hits")
    parts = hits.flatten()
    rows = list(zip(*(parts.field(c).to_pylist() for c in ("first", "last", "diagonal", "n")), strict=True)) if len(parts) else []
    end = np.cumsum(hits.value_lengths().to_numpy()).tolist() if len(pairs) else []
    keys = pairs.field("held").to_pylist()
    of = [held[k] for k in keys] if held is not None else [(w, set(o)) for w, o in zip(pairs.field("words").to_pylist(), pairs.field("own").to_pylist(), strict=True)]
    every = [(k, (*words, rows[x:y])) for k, words, x, y in zip(keys, of, [0, *end], end, strict=False)]
    cut = np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [every[x:y] for x, y in zip([0, *cut], cut, strict=False)]


def _check(held: dict[int, tuple[list[str], set[str]]] | None, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Aligns key, text, candidates; held has the words and own words of the texts, unless the candidates carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                candidates = _candidates(b.column("candidates"), held)
                found = leaked([(words_of(t), [c for _, c in cs]) for t, cs in zip(b.column("text").to_pylist(), candidates, strict=True)])
                rows = [(key, k, n, score) for key, cs, fs in zip(b.column("key").to_pylist(), candidates, found, strict=True) for (k, _), (n, score) in zip(cs, fs, strict=True) if n]
                if rows:
                    keys, texts, words, scores = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(texts, pa.int64()), pa.array(words, pa.int32()), pa.array(scores, pa.float64())], ["key", "held", "words", "score"])

    return run


def _held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        words = [words_of(t) for t in f["text"]]
        keys = [xxhash.xxh3_64_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) - 2**63 for w in words]
        yield pd.DataFrame({"item_id": f["item_id"], "held": np.array(keys, np.int64), "text": f["text"], "words": words})


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, words, score): every document with the held-out items it carries."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    held = rows.mapInPandas(_held, f"item_id {item_kind}, held bigint, text string, words array<string>").where(F.size("words") >= LEAST_WORDS)
    owners = held.select("held", "item_id").distinct()
    texts = held.groupBy("held").agg(F.max_by("words", "text").alias("words"), F.max("text").alias("text"))  # texts of the same words are one
    alone = texts.select("held", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("held")).where("n = 1")
    own = alone.groupBy("held").agg(F.collect_list("word").alias("own"))
    known = texts.join(own, "held", "left").select("held", "words", F.coalesce("own", F.array().cast("array<string>")).alias("own"))

    places = _window_rows(texts.select(F.col("held").alias("key"), "text")).select(F.col("key").alias("held"), F.col("at").alias("item_at"), "window")
    anchors = places.distinct()
    few = anchors.count() <= most_broadcast
    corpus = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("key").isNotNull())
    diagonal = F.col("at") - F.col("item_at")
    # one shuffle by document serves all that follows; a document's key is its own, so none is hot
    near = _window_rows(spread(corpus, "key"))
    if few:
        # a place is shuffled once, whatever number of texts share its window
        near = near.join(F.broadcast(anchors.select("window").distinct()), "window", "left_semi").repartition(tasks(spark), "key").join(F.broadcast(anchors), "window")
    else:
        near = near.join(anchors, "window").select("key", "held", "at", "item_at").repartition(tasks(spark), "key")
    hits = near.groupBy("key", "held", F.floor(diagonal / LANE).alias("lane"), F.floor(F.col("at") / STRETCH).alias("stretch")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.min(diagonal).alias("diagonal"), F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, at % {STRETCH})"))).alias("n")
    )
    pairs = (
        hits.groupBy("key", "held")
        .agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("first", "last", "diagonal", "n")])).alias("hits"), F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_HITS)
    )
    told = pairs.withColumn("among", F.count(F.lit(1)).over(W.partitionBy("key")))
    table = None
    if known.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= most_broadcast:
        # few enough: the tasks hold the texts of the items, and only their keys and hits are shuffled
        table = {r["held"]: (list(r["words"]), set(r["own"])) for r in known.toLocalIterator()}
        candidate = F.struct("held", "hits")
    else:
        told, candidate = told.join(known, "held"), F.struct("held", "hits", "words", "own")
    grouped = told.groupBy("key", F.expr(f"pmod(held, 1 + among div {TOGETHER})").alias("part")).agg(F.collect_list(candidate).alias("candidates"))
    checked = grouped.join(corpus, "key").select("key", "text", "candidates").mapInArrow(_check(table, to_arrow_type(docs.schema[key].dataType)), f"key {kind}, held bigint, words int, score double")
    # several texts of one item are one case
    return checked.join(owners, "held").groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.max("words").alias("words"), F.max("score").alias("score"))
