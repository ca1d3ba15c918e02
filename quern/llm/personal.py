"""Personal items in free text: found by a character-level tagger, replaced by typed placeholders.

Method: a bidirectional LSTM over characters with CRF transitions, trained in
numpy from labelled spans (``train_tagger``), reads every line of every text,
long lines in overlapping windows. Where windows overlap, their scores are
blended, the nearer to a window's middle the more weight; the tags of a whole
line are then decoded jointly under the transitions, whatever the number of its
windows. The decoded spans are the result: their ends are moved to the ends of
the words they cut, titles, labels and marks around them are left out
(``settled``), and spans that cannot be of their kind (a phone number of five
digits, a single name, a login on a machine) are dropped.

Windows are formed and tagged within a batch of rows; rows are only moved where the
input has fewer splits than there are tasks, and a text of any length is read whole, in as many windows as it needs.

Defined cases
  * null, empty and blank texts have no items; their text is returned as it is.
  * an item that stands several times in a text gives one row of ``found`` with its number of places.
  * items do not overlap: of two that would after their ends were moved, the one that begins first is kept.
  * items do not reach over line ends; offsets count characters (code points) from 0.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shapes import KINDS
from quern.llm.tagger import TAGS, Tagger, encode
from quern.session import spread

WEIGHTS = os.path.join(os.path.dirname(__file__), "tagger_weights.npz")
WINDOW, OVERLAP = 240, 96
#: Windows tagged at once; characters whose scores are held at once; lines from which on tags are decoded piece by piece.
TOGETHER, HELD, LONG = 1_024, 1_000_000, 50_000
#: Texts whose equal lines are read once.
GROUP = 2_000
_BREAK = encode("\n")


@functools.lru_cache(maxsize=2)
def tagger(path: str = WEIGHTS) -> Tagger:
    return Tagger.load(path)


_LINES = re.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")


def codes_of(line: str) -> np.ndarray:
    return np.concatenate([_BREAK, encode(line), _BREAK])


def starts(length: int) -> range:
    """Where the windows over so many characters begin."""
    return range(0, max(1, length - OVERLAP), WINDOW - OVERLAP)


def _weight(n: int, first: bool, last: bool) -> np.ndarray:
    """How much a window of n characters counts at each: less towards an end another window goes over."""
    up = (np.arange(n, dtype=np.float32) + 1) / OVERLAP
    w = np.ones(n, np.float32)
    if not first:
        w = np.minimum(w, up)
    return w if last else np.minimum(w, up[::-1])


def scores_of(codes: list[np.ndarray], model: Tagger) -> list[np.ndarray]:
    """Tag scores (characters, tags) of each line, blended over its windows."""
    place = [(k, s) for k, c in enumerate(codes) for s in starts(len(c))]
    place.sort(key=lambda p: min(WINDOW, len(codes[p[0]]) - p[1]))  # windows of like length share a batch
    out: list[np.ndarray | None] = [None if len(c) <= WINDOW else np.zeros((len(c), TAGS), np.float32) for c in codes]
    total = {k: np.zeros(len(c), np.float32) for k, c in enumerate(codes) if len(c) > WINDOW}
    for a in range(0, len(place), TOGETHER):
        some = place[a : a + TOGETHER]
        x = np.zeros((min(WINDOW, max(len(codes[k]) - s for k, s in some)), len(some)), np.int16)
        for col, (k, s) in enumerate(some):
            part = codes[k][s : s + WINDOW]
            x[: len(part), col] = part
        score = model.emissions(x)
        for col, (k, s) in enumerate(some):
            n = min(WINDOW, len(codes[k]) - s)
            if k not in total:
                out[k] = score[:n, col]
                continue
            w = _weight(n, s == 0, s + WINDOW >= len(codes[k]))
            out[k][s : s + n] += w[:, None] * score[:n, col]
            total[k][s : s + n] += w
    for k, w in total.items():
        out[k] /= w[:, None]
    return out


def _short(codes: list[np.ndarray], model: Tagger) -> list[np.ndarray]:
    """Tags of lines that fit one window, decoded batch by batch."""
    out = [np.zeros(len(c), np.int8) for c in codes]
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    for a in range(0, len(order), TOGETHER):
        some = order[a : a + TOGETHER]
        x = np.zeros((len(codes[some[-1]]), len(some)), np.int16)
        for col, k in enumerate(some):
            x[: len(codes[k]), col] = codes[k]
        y = model.tags(x)
        for col in np.flatnonzero(y.any(0)).tolist():
            out[some[col]] = y[: len(codes[some[col]]), col]
    return out


def _long(codes: list[np.ndarray], model: Tagger) -> list[np.ndarray]:
    """Tags of lines of several windows, decoded as whole lines."""
    score = scores_of(codes, model)
    out = [np.zeros(len(c), np.int8) for c in codes]
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    for a in range(0, len(order), 64):
        some = order[a : a + 64]
        padded = np.zeros((len(codes[some[-1]]), len(some), TAGS), np.float32)
        padded[:, :, 1:] = -1e4
        for col, k in enumerate(some):
            padded[: len(codes[k]), col] = score[k]
        read = np.flatnonzero(~model.blank(padded))
        if len(read):
            y = model.decode(padded[:, read])
            for col, c in enumerate(read.tolist()):
                out[some[c]] = y[: len(codes[some[c]]), col]
    return out


def _endless(code: np.ndarray, model: Tagger) -> np.ndarray:
    """Tags of a line of any length: scores of one stretch of windows at a time, decoded over all of it."""
    step = 400 * (WINDOW - OVERLAP)

    def stretches() -> Iterator[np.ndarray]:
        # a stretch is read with the windows before and behind it, so that its blended scores are those of the whole line
        for a in range(0, len(code), step):
            lo = max(0, a - 2 * (WINDOW - OVERLAP))
            yield scores_of([code[lo : a + step + 2 * WINDOW]], model)[0][a - lo : a - lo + step]

    return model.decode_pieces(stretches(), len(code))


def tag_lines(lines: list[str], model: Tagger) -> list[np.ndarray]:
    """Tags of each line's characters."""
    codes = [codes_of(t) for t in lines]
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(codes)

    def put(keys: list[int], run: Callable[[list[np.ndarray], Tagger], list[np.ndarray]]) -> None:
        held: list[int] = []
        size = 0
        for n, k in enumerate(keys):
            held.append(k)
            size += len(codes[k])
            if size >= HELD or n == len(keys) - 1:
                for j, y in zip(held, run([codes[j] for j in held], model), strict=True):
                    out[j] = y
                held, size = [], 0

    put([k for k, c in enumerate(codes) if len(c) <= WINDOW], _short)
    put([k for k, c in enumerate(codes) if WINDOW < len(c) <= LONG], _long)
    for k, c in enumerate(codes):
        if len(c) > LONG:
            out[k] = _endless(c, model)
    return [y[1:-1] for y in out]


def proposals(tags: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Spans of one kind; a new one begins at each B tag and at each change of kind."""
    at = np.flatnonzero(tags)
    if not len(at):
        return
    kind = (tags[at].astype(np.int64) + 1) // 2
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(kind) != 0) | (tags[at][1:] % 2 == 1)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(at)]
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        yield int(at[a]), int(at[b - 1]) + 1, KINDS[kind[a] - 1]


_LETTERS = re.compile(r"[^\W\d_]+")
_TITLE = re.compile(r"(?:(?:dr|mr|mrs|ms|prof|herr|frau|sr|sra|señora?|mme|m)\b\.? +)+", re.I)
_LOGIN = re.compile(r"(?:\bssh|\bscp|\brsync)\s+(?:-\w+\s+)*$")


def _joins(text: str, k: int, marks: str) -> bool:
    """Whether the characters before and at k belong to one word: letters and digits, or marks between them."""
    if not 0 < k < len(text):
        return False
    x, y = text[k - 1], text[k]
    if x.isalnum() and y.isalnum():
        return True
    if y in marks:
        return x.isalnum() and k + 1 < len(text) and text[k + 1].isalnum()
    return x in marks and y.isalnum() and (k < 2 or text[k - 2].isalnum())


_INSIDE = {"name": "'’-", "email": "._+-@＠", "phone": "-./", "id_number": "-.", "address": "'’-"}


def settled(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """A decoded span with its ends at word ends and without what stands around the item; None if it cannot be of its kind."""
    marks = _INSIDE[kind]
    while _joins(text, a, marks):
        a -= 1
    while _joins(text, b, marks):
        b += 1
    if kind == "phone":
        while a and (text[a - 1] == "+" or text[a - 1] == "(" and ")" in text[a:b]):
            a -= 1
    keep = "+(" if kind == "phone" else ""
    while a < b and not (text[a].isalnum() or text[a] in keep):
        a += 1
    while b > a and not text[b - 1].isalnum():
        if kind in ("name", "address") and text[b - 1] == "." and (b - a < 3 or not text[b - 2].isalnum() or text[b - 3] in " ." or kind == "address"):
            break
        if kind == "email" and text[b - 1] in ")]}":
            break
        b -= 1
    item = text[a:b]
    digits = sum(c.isdigit() for c in item)
    if kind == "name":
        t = _TITLE.match(item)
        if t:
            a, item = a + t.end(), item[t.end() :]
        words = [w for w in item.replace(",", " ").split() if _LETTERS.search(w)]
        return (a, b) if len(words) >= 2 and any(len(w) > 1 for w in words) and not digits and "@" not in item else None
    if kind == "email":
        if item.lower().startswith("mailto:"):
            a, item = a + 7, item[7:]
        if "@" in item or "＠" in item:
            part = next(m for m in re.finditer(r"\S+", item) if "@" in m.group() or "＠" in m.group())
            a, b, item = a + part.start(), a + part.end(), part.group()
            host = re.split("[@＠]", item)[-1]
            login = not any(c.isalpha() for c in host) or "." not in host or re.match(r":\S", text[b:]) or _LOGIN.search(text[max(0, a - 40) : a])
            return None if login else (a, b)
        return (a, b) if re.search(r"(?i)\bat\b", item) and re.search(r"(?i)\bdot\b|\.", item) else None
    if kind == "phone":
        return (a, b) if 7 <= digits <= 15 else None
    if kind == "id_number":
        # longer ones are hashes and the like; a full stop or comma with a space behind it ends a sentence
        fits = digits >= 5 and sum(c.isalnum() for c in item) <= 16 and all(len(w) <= 2 for w in _LETTERS.findall(item)) and not re.search(r"[.,;:]\s", item)
        return (a, b) if fits else None
    return (a, b) if digits and any(c.isalpha() for c in item) else None


def kept(text: str, spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The settled spans, none over another."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        span = settled(text, a, b, kind)
        if span and (not out or span[0] >= out[-1][1]):
            out.append((*span, kind))
    return out


def find(texts: list[str], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """The items of each text, in order; equal lines of the texts are read once."""
    places = [[m.span() for m in _LINES.finditer(t)] for t in texts]
    known: dict[str, int] = {}
    for t, found in zip(texts, places, strict=True):
        for a, b in found:
            known.setdefault(t[a:b], len(known))
    items = [kept(line, proposals(y)) if y.any() else [] for line, y in zip(known, tag_lines(list(known), model), strict=True)]
    return [[(a + x, a + y, kind) for a, b in found for x, y, kind in items[known[t[a:b]]]] for t, found in zip(texts, places, strict=True)]


def replaced(text: str, items: list[tuple[int, int, str]]) -> str:
    """The text with each item replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _items(path: str, key: str, text: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tagger(path)
        for f in frames:
            f = f[f[text].notna()]
            keys, texts = f[key].tolist(), f[text].tolist()
            for lo in range(0, len(texts), GROUP):
                part = texts[lo : lo + GROUP]
                rows = [(k, kind, t[a:b], a, b) for k, t, items in zip(keys[lo:], part, find(part, model), strict=False) for a, b, kind in items]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "kind", "found", "start", "end"])

    return run


def items(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, kind, found, start, end): every item with its place in the text."""
    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key).mapInPandas(_items(weights, key, text), f"doc_id {kind}, kind string, found string, start int, end int")


def distinct_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found, places): the distinct items of each text."""
    return items(docs, key, text).groupBy("doc_id", "kind", "found").agg(F.count(F.lit(1)).alias("places"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, text): every text with its items replaced by placeholders; null texts stay null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tagger(weights)
        for f in frames:
            texts = f[text].tolist()
            some = [t if isinstance(t, str) else "" for t in texts]
            clean = []
            for lo in range(0, len(some), GROUP):
                part = some[lo : lo + GROUP]
                clean += [replaced(t, found) for t, found in zip(part, find(part, model), strict=True)]
            yield pd.DataFrame({"doc_id": f[key], "text": [c if isinstance(t, str) else None for c, t in zip(clean, texts, strict=True)]})

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key).mapInPandas(run, f"doc_id {kind}, text string")
