"""Encoding of whole texts with a byte-pair tokenizer, by forced boundaries.

Method: two bytes that are neighbours inside no token of the vocabulary can
never be merged, so every such place is a certain cut: the text is cut there,
fragments are encoded on their own (each distinct one once per worker) and the
ids are put together again. Places where a cut could change the tokenizer's
pre-splitting are left whole: a cut never stands behind white space (the split
looks ahead there), nor before an apostrophe that follows anything but a letter
or digit (it could begin a contraction), nor inside a character.

Defined cases
  * a null and an empty text give an empty list; nothing is trimmed or changed.
  * strings of special tokens in a text are ordinary text.
  * texts of any length are encoded whole; rows are independent, nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments a worker remembers before it starts over.
REMEMBERED = 500_000
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class ForcedBoundaryEncoder:
    """Token ids by certain cuts and remembered fragments."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.whole = tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.joined = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.known: dict[str, list[int]] = {}

    def cuts(self, text: str) -> np.ndarray:
        """Character positions of the certain cuts."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
        first = np.select([size == 1, size == 2, size == 3], [cp, 0xC0 | cp >> 6, 0xE0 | cp >> 12], 0xF0 | cp >> 18)
        last = np.where(size == 1, cp, 0x80 | cp & 0x3F)
        left, right = cp[:-1], cp[1:]
        alnum = (left - 48 < 10) | (left - 65 < 26) | (left - 97 < 26)  # unsigned: below the range wraps round
        safe = ~self.joined[last[:-1], first[1:]] & ~np.isin(left, _SPACES) & ((right != 39) | alnum)
        return np.flatnonzero(safe) + 1

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known, start = self.known, 0
        for end in [*self.cuts(text).tolist(), len(text)]:
            part = text[start:end]
            found = known.get(part)
            if found is None:
                found = self.whole.encode_ordinary(part)
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found
            ids += found
            start = end
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(read_ranks(path))


def _encode(path: str, key: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return run


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text."""
    path = vocabulary or os.environ.get("QUERN_VOCABULARY", VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key).mapInArrow(_encode(path, key, text), f"`{key}` {kind}, ids array<int>")
