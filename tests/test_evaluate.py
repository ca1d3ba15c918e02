import warnings

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate, metrics, search
from quern.sources import sample

DOC = 'def load(path):\n    """Read every row that stands in the file.\n\n    More.\n    """\n    return open(path).read()\n'


def test_docstring_queries(spark):
    assert evaluate.docstring_of(DOC) == ("Read every row that stands in the file.", "def load(path):\n    return open(path).read()")
    assert evaluate.docstring_of("def f(:\n") is None and evaluate.docstring_of("x = 1") is None and evaluate.docstring_of('def f():\n    """Only this text stands here, no more."""') is None and evaluate.docstring_of("") is None
    rows = [
        ("a.py::load#1", "v", DOC), ("a.py::load#1", "w", DOC), ("b.py::other#1", "v", DOC.replace("load", "other").replace("Read every row", "Write every new row")),
        ("c.py::twin#1", "v", DOC.replace("load", "twin").replace("Read every row", "Drop all the rows")), ("d.py::twin#1", "v", DOC.replace("load", "twin").replace("Read every row", "Drop all the rows").replace("read", "close")),
        ("e.py::leak#1", "v", "def leak():\n    # write every new row that stands in the file.\n    return 1\n"), ("f.js::x#1", "v", DOC), ("g.py::n#1", "v", None), ("h.py::few#1", "v", 'def few():\n    """Too few words."""\n    return 1\n'),
    ]
    df = spark.createDataFrame(rows, "id string, version string, content string")
    got = {(r["query_id"], r["version"], r["text"]) for r in evaluate.docstring_queries(df.where("NOT id LIKE 'f.js%'")).collect()}
    assert got == {("a.py::load#1", v, "Read every row that stands in the file.") for v in "vw"}


def test_handwritten_and_judged(spark):
    spec = spark.createDataFrame([("h1", "where is it", "a.py::f"), ("h2", "and this", "b.py::g")], "query_id string, text string, answer string")
    ids = spark.createDataFrame([("a.py::f#9",), ("a.py::f#10",), ("c.py::f#1",)], "id string")
    found, missing = evaluate.handwritten_queries(spec, ids)
    assert [tuple(r) for r in found.collect()] == [("h1", "where is it", "a.py::f#10")] and [tuple(r) for r in missing.collect()] == [("h2", "b.py::g")]
    corpus = spark.createDataFrame([("d1", "T", "x"), ("d2", None, "y"), ("d3", "", None)], "id string, title string, text string")
    docs, asked, qrels = evaluate.judged(corpus, spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "query_id string, text string"), spark.createDataFrame([("q1", "d1", 1), ("q3", "d2", 1)], "query_id string, id string, rel int"), 1)
    assert {tuple(r) for r in docs.collect()} == {("d1", "T\nx"), ("d2", "y"), ("d3", "")} and [r["query_id"] for r in asked.collect()] == ["q1"] and qrels.count() == 1


def test_call_pairs(spark):
    rows = [("a::load_rows#1", "load_rows(); save_rows(); load_rows(); x.skip_rows()"), ("b::save_rows#1", "if (load_rows (1)) { save_rows(2) }"), ("c::skip_rows#1", "save_rows(load_rows())"), ("d::main#1", "main()"), ("e::w#1", None)]
    got = [tuple(r) for r in evaluate.call_pairs(spark.createDataFrame(rows, "id string, content string")).collect()]
    assert got == [("load_rows", "save_rows", 2)]


def test_samples(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "query_id string")
    evaluate.save_sample(spark, ids, str(tmp_path / "s"))
    with pytest.warns(UserWarning, match="not validated"):
        assert evaluate.load_sample(spark, str(tmp_path / "s")).count() == 2
    evaluate.save_sample(spark, ids, str(tmp_path / "s"), {"preserved": True, "tau": 1.0})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert evaluate.load_sample(spark, str(tmp_path / "s")).count() == 2


def test_sample_collection_is_searched_well(spark):
    corpus, queries, qrels = sample.load_sample(spark)
    runs = evaluate.run_grid(corpus, queries, {k: v for k, v in evaluate.ablation().items() if k in ("lexical", "shipped")})
    table = evaluate.evaluated(spark.createDataFrame(runs.toArrow()), qrels, "lexical", 50)
    rows = {r["config"]: r for r in table.collect()}
    assert rows["lexical"]["ndcg"] > 0.8 and rows["lexical"]["queries"] == len(sample.SAMPLE) and rows["lexical"]["diff"] is None and rows["shipped"]["p"] is not None
    assert evaluate.as_markdown(table).count("\n") == 3
    hits = search.search(corpus, queries)
    assert metrics.means(metrics.per_query(hits, qrels)).first()["ndcg"] > 0.5


def test_timed_reindex(spark, tmp_path):
    before = spark.createDataFrame([("a", DOC)], "id string, text string")
    after = before.unionByName(spark.createDataFrame([("b", "const z = (x) => call(x);")], "id string, text string"))
    report = evaluate.timed_reindex(spark, before, after, str(tmp_path))
    assert report["snippets"] == 2 and report["reused_vectors"] == 2 and report["new_vectors"] == 2 and report["full_seconds"] > 0


def test_token_windows(spark):
    pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    text = " ".join(f"word{k}" for k in range(300))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "id bigint, text string")
    got = {}
    for r in evaluate.token_windows(docs, path, 100, 75).orderBy("id", "window_no").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got[2] == ["short"] and got[4] == [""] and 3 not in got and len(got[1]) > 3
    assert text.startswith(got[1][0]) and text.endswith(got[1][-1]) and all(part.strip() in text for part in got[1])
    with pytest.raises(ValueError):
        evaluate.token_windows(docs, path, 10, 11)
    assert F is not None
