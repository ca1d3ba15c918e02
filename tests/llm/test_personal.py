import numpy as np
import pytest

from quern.llm import labelled_spans, personal, shapes, tagger

CASES = [
    ("Maintainer: Brelka Tamberlane", "name", "Brelka Tamberlane"),
    ("the page was last touched by Santarelho, Irsa on Tuesday", "name", "Santarelho, Irsa"),
    ("Reviewed with Dr. Sefira M. Halvorsted before the freeze", "name", "Sefira M. Halvorsted"),
    ("please mail kestra+node@mail.example, not the list", "email", "kestra+node@mail.example"),
    ("Contact ostin.yarborne at example dot net when it breaks", "email", "ostin.yarborne at example dot net"),
    ("[write to us](mailto:irsa@example.org)", "email", "irsa@example.org"),
    ("Call me at +44 (0)20 7946 0331 if the depot is striped again.", "phone", "+44 (0)20 7946 0331"),
    ("support_phone = '(02) 5550 6245'", "phone", "(02) 5550 6245"),
    ("the page failed for the customer with SSN 666-30-3811.", "id_number", "666-30-3811"),
    ("- passport no.: X00211234", "id_number", "X00211234"),
    ("they live at 36, rue du Larkspire, 00858 Norvik, next to the tree", "address", "36, rue du Larkspire, 00858 Norvik"),
    ("Visit us: Flat 20, 394 Larkspire Gardens, Kettlebury QQ9 4ZZ.", "address", "Flat 20, 394 Larkspire Gardens, Kettlebury QQ9 4ZZ"),
]
#: Surroundings the tagger was not trained on, and names with particles.
OTHER = [
    ("Maintainer: Ludwig van der Berg", "name", "Ludwig van der Berg"),
    ("Maintainer: Maria de la Cruz", "name", "Maria de la Cruz"),
    ("Thanks to Klaus von der Heide for the review", "name", "Klaus von der Heide"),
    ("Please contact Priya Raman about the outage.", "name", "Priya Raman"),
    ("Patient: John Smith, born 1971", "name", "John Smith"),
    ("Met Hannah Goldberg at the station", "name", "Hannah Goldberg"),
    ("Dear Yuki Tanaka,", "name", "Yuki Tanaka"),
    ("IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789", "id_number", "123-45-6789"),
    ("I live at 12 Elm Street, Springfield 12345.", "address", "12 Elm Street, Springfield 12345"),
    ("mail me at joe.doe@example.com today", "email", "joe.doe@example.com"),
]
NOTHING = [
    "git clone git@forge.example:lumen/beacon.git", "ssh deploy@10.1.64.3 -p 2264", "order number 8542-857-8531 is only a fixture", "build 5527-0127 failed on host 10.0.27.7",
    "Author: the Weighted Pool team", "Read The Stream Guide and the Nested Stream chapter first", "@quietrow78 can you look?", "Reported-by: quietbuffer93",
    "const MAX_CLOCK = 163296055;", "", "   ", "npm install @wagon/core@5.77.0",
]


@pytest.fixture(scope="module")
def model():
    return personal.tagger()


def test_items(model):
    for line, kind, item in CASES + OTHER:
        for text in (line, "Some text before.\n\n" + line + "\nand after"):
            (found,) = personal.find([text], model)
            assert [(text[a:b], k) for a, b, k in found] == [(item, kind)], text


def test_no_items(model):
    assert personal.find(NOTHING, model) == [[] for _ in NOTHING]


def test_long_lines_are_read_whole(model):
    text = "the quiet row stands beside the pool and " * 40 + "please mail kestra+node@mail.example, not the list " + "and so on with the rest of it " * 40
    (found,) = personal.find([text], model)
    assert [(text[a:b], k) for a, b, k in found] == [("kestra+node@mail.example", "email")]


def test_frames(spark):
    twice = "Maintainer: Brelka Tamberlane\n\nMaintainer: Brelka Tamberlane"
    docs = spark.createDataFrame([(1, twice, "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x")], "doc_id bigint, text string, found string")
    assert [tuple(r) for r in personal.distinct_items(docs).collect()] == [(1, "name", "Brelka Tamberlane", 2)]
    got = {r["doc_id"]: r["text"] for r in personal.masked(docs).collect()}
    assert got == {1: "Maintainer: <NAME>\n\nMaintainer: <NAME>", 2: None, 3: "", 4: "plain"}
    places = sorted((r["start"], r["end"]) for r in personal.items(docs).collect())
    assert places == [(12, 29), (43, 60)]
    assert personal.items(docs.where("false")).count() == 0


def test_blank_is_never_wrong(model):
    r = np.random.default_rng(3)
    t = tagger.Tagger.fresh(hidden=4, chars=3)
    for k in ("T", "S", "Z"):
        t.w[k] = r.normal(size=t.w[k].shape).astype(np.float32)
    for lean in (0.0, 1.0, 2.0, 4.0):
        score = r.normal(size=(12, 200, tagger.TAGS)).astype(np.float32)
        score[:, :, 0] += lean
        assert not t.decode(score)[:, t.blank(score)].any()


def test_pieces_are_decoded_as_a_whole(model, monkeypatch):
    line = "the pool keeps a row, " * 60 + "Maintainer: Brelka Tamberlane and so on " + "with rows, " * 90
    codes = personal.codes_of(line)
    whole = personal._long([codes], model)[0]
    assert whole.any() and (model.decode_pieces(np.array_split(personal.scores_of([codes], model)[0], 7), len(codes)) == whole).all()
    assert (personal._endless(codes, model) == whole).all()


def test_gradients():
    t = tagger.Tagger.fresh(hidden=4, chars=3)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    r = np.random.default_rng(0)
    t.w["T"] = r.normal(size=t.w["T"].shape)
    x = r.integers(1, 60, (6, 3)).astype(np.int16)
    y = r.integers(0, tagger.TAGS, (6, 3))
    x[4:, 1] = 0
    y[x == 0] = 0
    _, g = t.gradients(x, y)
    for k in ("Uf", "Wr", "V", "T", "S", "Z"):
        i = tuple(r.integers(0, s) for s in t.w[k].shape)
        old, e = t.w[k][i], 1e-4
        t.w[k][i] = old + e
        up = t.gradients(x, y)[0]
        t.w[k][i] = old - e
        down = t.gradients(x, y)[0]
        t.w[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3


def test_training_learns():
    invent = labelled_spans.Inventor(1, [])
    samples = []
    for _ in range(300):
        item = invent.name()
        s = f"by {item} on"
        samples.append((tagger.encode(s), tagger.tag_array(len(s), [(3, 3 + len(item), "name")])))
    t = tagger.Tagger.fresh(hidden=12, chars=8)
    before = t.gradients(samples[0][0][:, None], samples[0][1][:, None])[0]
    t.train(samples, epochs=30, batch=32, drop=0)
    assert t.gradients(samples[0][0][:, None], samples[0][1][:, None])[0] < 0.5 * before


def test_shapes():
    assert shapes.identities("4 00 944 275 733 5") == [] and shapes.identities("tax id 00 944 275 733") == [(7, 21)]
    assert shapes.phones("tel:+61 2 5550 5535") == [(4, 19)] and shapes.phones("502 884 27 118") == []
    assert tagger.encode("a\n é序").tolist()[1:3] == [1, 1]


def test_spans_that_cannot_be_of_their_kind():
    for text, kind in (("6ee08e6e-7ee6-4e6e-9189-670671cd9740", "id_number"), ("34. 65536", "id_number"), ("555-01", "phone"), ("O'Connor", "name"), ("deploy@10.1.2.3", "email"), ("Elm Street", "address")):
        assert personal.settled(text, 0, len(text), kind) is None
    assert personal.settled("see Dr. Anna Weber, please", 4, 17, "name") == (8, 18)
    assert personal.settled("tel +44 20 7946 0018.", 5, 20, "phone") == (4, 20)
