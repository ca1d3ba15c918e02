"""python -m quern.llm.train_tagger DATA_DIR OUT [SECONDS] [WORKERS] [WEIGHTS TO GO ON FROM]: fit the tagger on a bounded sample of documents and on invented sentences.

Fixed bounds: the first ``MOST_DOCUMENTS`` documents by the hash of their text;
of their lines without items a share (``PLAIN_SHARE``, all of those with digits
or capitals), all with items, in windows as they are read later. Lines that may
hold names in a script of which the list of name parts has none are left out.
The last tenth of the documents, and all of ``HELD_FRAMES``, are held out and
measured. The stored weights were made by this module.
"""

from __future__ import annotations

import hashlib
import re
import sys
import time
from collections import Counter
from collections.abc import Iterator

import numpy as np

from quern.llm import labelled_spans as spans
from quern.llm import personal
from quern.llm.tagger import Tagger, encode, tag_array

MOST_DOCUMENTS = 20_000
COPIES = 3
#: Of the lines without items: the share that is kept, and the share into which an invented item is put.
PLAIN_SHARE, PLACED_SHARE = 1.0, 0.3
FRAME_COPIES, PLAIN_COPIES = 100, 120
Spans = list[tuple[int, int, str]]
_UNSURE = re.compile(r"[А-ЯЁ][а-яё]+,? [А-ЯЁ][а-яё]+")


def lines_of(text: str, found: Spans) -> Iterator[tuple[str, Spans]]:
    """The lines of a text with their spans."""
    for m in re.finditer(r"[^\n\r]+", text):
        a, b = m.span()
        yield text[a:b], [(x - a, y - a, k) for x, y, k in found if a <= x and y <= b]


def _unsure(line: str, found: Spans) -> bool:
    return any(all(m.end() <= a or m.start() >= b for a, b, _ in found) for m in _UNSURE.finditer(line))


def windows(line: str, found: Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and tags of a line between its breaks, cut as ``personal`` cuts it."""
    x = personal.codes_of(line)
    y = np.r_[0, tag_array(len(line), found), 0]
    for a in personal.starts(len(x)):
        yield x[a : a + personal.WINDOW], y[a : a + personal.WINDOW]


def framed(seed: int, parts: list[str], frames: str, plain: str, copies: int, plain_copies: int) -> list[tuple[str, Spans]]:
    invent = spans.Inventor(seed, parts)
    some = [(f, copies) for f in frames.strip().splitlines()] + [(f, plain_copies) for f in plain.strip().splitlines()]
    return [invent.framed(f) for f, n in some for _ in range(n)]


def training_data(texts: list[str], parts: set[str], seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    names = sorted(p.title() for p in parts)
    words = sorted({w for t in texts for w in re.findall(r"(?<![\w.])[a-z]{2,9}(?![\w.])", t)} - parts)
    invent = spans.Inventor(seed, names, words)
    samples: list[tuple[np.ndarray, np.ndarray]] = []
    for line, found in framed(seed, names, spans.FRAMES, spans.PLAIN, FRAME_COPIES, PLAIN_COPIES):
        samples += windows(line, found)
    seen = set()
    often = Counter(line for t in texts for line, _ in lines_of(t, []))
    for t in texts:
        for line, found in lines_of(t, spans.label(t, parts)):
            if line in seen or _unsure(line, found):
                continue
            seen.add(line)
            pairs = []
            if found:
                pairs = [(line, found)] * 2 + [spans.exchanged(line, found, invent) for _ in range(COPIES)]
            elif re.search(r"\d{3}|@|[A-Z]\w+,? [A-Z]\w+", line) or invent.r.random() < PLAIN_SHARE:
                pairs = [(line, [])] * min(4, often[line].bit_length())  # lines that stand often count somewhat more
            if not found and invent.r.random() < PLACED_SHARE:
                pairs.append(invent.placed(line))
            for p, f in pairs:
                samples += windows(p, f)
    return samples


def measured(model: Tagger, rows: list[tuple[str, Spans]]) -> dict[str, tuple[int, int, int]]:
    """(found and true, found, true) for each kind and in all."""
    out: dict[str, list[int]] = {}
    for (line, true), got in zip(rows, personal.find([t for t, _ in rows], model), strict=True):
        for kind in {k for _, _, k in true} | {k for _, _, k in got}:
            a, b = {(x, y) for x, y, k in got if k == kind}, {(x, y) for x, y, k in true if k == kind}
            for name in (kind, "all"):
                n = out.setdefault(name, [0, 0, 0])
                n[0], n[1], n[2] = n[0] + len(a & b), n[1] + len(a), n[2] + len(b)
    return {k: tuple(v) for k, v in out.items()}


def told(title: str, counts: dict[str, tuple[int, int, int]]) -> None:
    for kind, (both, found, true) in sorted(counts.items()):
        print(title, kind, "precision", round(both / max(1, found), 4), "recall", round(both / max(1, true), 4), "of", true, flush=True)


def read(data: str) -> tuple[list[str], set[str]]:
    """The bounded sample of distinct texts, and the name parts of list and texts in lower case."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{data}/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts = sorted({t for t in rows if t and t.strip()}, key=lambda t: hashlib.md5(t.encode()).digest())[:MOST_DOCUMENTS]
    listed = pq.read_table(f"{data}/name_parts.parquet").to_pylist()
    kinds = {k: {r["name_part"].strip() for r in listed if r["name_part"] and r["name_part"].strip() and r["kind"] == k} for k in ("given", "family")}
    given, family = spans.widened(texts, kinds["given"], kinds["family"])
    return texts, given | family


def main(data: str, out: str, seconds: float = 640, workers: int = 8, begin: str | None = None) -> None:
    texts, parts = read(data)
    cut = int(0.9 * len(texts))
    samples = training_data(texts[:cut], parts)
    print(len(samples), "samples", sum(len(x) for x, _ in samples), "characters", flush=True)
    began = time.time()
    tagger = Tagger.load(begin) if begin else Tagger.fresh(hidden=40)
    tagger.train(samples, epochs=40, batch=48, rate=2e-3 if begin else 4e-3, seconds=seconds, workers=workers, tell=lambda n, loss: print(n, round(loss, 4), round(time.time() - began), flush=True))
    tagger.save(out)
    tagger = Tagger.load(out)
    told("held-out documents", measured(tagger, [r for t in texts[cut:] for r in lines_of(t, spans.label(t, parts)) if not _unsure(*r)]))
    told("held-out frames", measured(tagger, framed(77, [], spans.HELD_FRAMES, "", 60, 0)))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(float, sys.argv[3:4]), *map(int, sys.argv[4:5]), *sys.argv[5:6])
