import os
import random

import pytest

from quern.llm import encoding

PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary here")
TEXTS = ["", " ", "\n\nfoo", "a  b", "it's we'll I'M", "!'s", " x", "序空点。é", "<|endoftext|>", "x" * 5000, "tab\t\t\tend ", "🙂🙂"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_ids_as_the_library(whole):
    enc = encoding.encoder(encoding.VOCABULARY)
    r = random.Random(1)
    signs = "ab'sdtmlrve  \n\t é序空Яж0 9!?.-_<|>ſ　́🙂"
    for s in TEXTS + ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]:
        assert enc.encode(s) == whole(s), repr(s)


def test_cuts_are_certain():
    enc = encoding.encoder(encoding.VOCABULARY)
    s = "def parse(text): return text.split()"
    b = s.encode()
    assert len(enc.cuts(s)) > 3 and all(not enc.joined[b[c - 1], b[c]] for c in enc.cuts(s))


def test_frames(spark, whole):
    rows = [(k, t, "other") for k, t in enumerate(TEXTS)] + [(100, None, "x")]
    got = {r["doc_id"]: r["ids"] for r in encoding.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert got == {k: whole(t) if t else [] for k, t, _ in rows}
    assert encoding.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
