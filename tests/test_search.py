import ast

from pyspark.sql import functions as F

from quern.functions import transforms
from quern.operators import search

PY = "def total(items, start):\n    result = start\n    other = 1\n    for item in items:\n        result += len(item)\n    return result + other\n"


def test_renaming_keeps_meaning():
    spaces = [{}, {}, {}]
    for space, code in zip(spaces, (PY, transforms.rename_python(PY), transforms.reorder_python(PY)), strict=True):
        exec(code, space)  # noqa: S102
    assert {s["total"](["ab", "c"], 2) for s in spaces} == {6}
    assert "items" not in transforms.rename_python(PY) and "len(" in transforms.rename_python(PY) and transforms.reorder_python(PY) != ast.unparse(ast.parse(PY))
    assert transforms.rename_python("def broken(:") == "def broken(:"
    js = "const a = b.a + 'a'; // a\nlet c = a;"
    assert transforms.rename_javascript(js) == "const v0 = b.a + 'a'; // a\nlet v1 = v0;"


def test_leading_comments(spark):
    rows = [("// one\n// two\nfunction f() {}",), ("/** block\n * more */\nclass A {}",), ("x = 1",), ("# py\ndef f(): pass",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(transforms.leading_comment(F.col("s"))).collect()]
    assert got == ["one two", "block more", None, "py"]


DOCS = [
    ("p/a.py::load#1", "load config file from the disk and parse it"), ("p/b.py::sort#1", "sort a list of numbers quickly"),
    ("p/tests/test_b.py::check#1", "sort a list of numbers and check the order"), ("p/c.py::send#1", "send mail to the customer"),
]


def test_search(spark):
    docs = spark.createDataFrame([(*d, "utility", ["load_config"]) for d in DOCS], "id string, text string, category string, identifiers array<string>")
    asked = spark.createDataFrame([("q1", "how do I sort numbers"), ("q2", "send mail")], "query_id string, text string")
    for config in (search.SearchConfig(), search.SearchConfig.lexical_only(), search.SearchConfig.dense_only(), search.SearchConfig(include_tests=False)):
        hits = {(r["query_id"], r["rank_no"]): r["id"] for r in search.search(docs, asked, config).collect()}
        assert hits["q2", 1] == "p/c.py::send#1" and "::" in hits["q1", 1]
    assert not any("tests/" in i for i in hits.values())


def test_answers(spark):
    s = spark.createDataFrame([("a.js::run#1", "function run(x) {\n  loadConfig(x);\n  saveFile(x);\n}"), ("b.js::loadConfig#1", "function loadConfig(p) {\n  return p;\n}")], "id string, content string")
    kind, rows = search.answer(s, "who calls load config?")
    assert kind == "callers" and [(r["unit"], r["line"]) for r in rows.collect()] == [("a.js", 2)]
    kind, rows = search.answer(s, "where is load config defined")
    assert kind == "definition" and [(r["unit"], r["line"]) for r in rows.collect()] == [("b.js", 1)]
    assert search.answer(s, "what calls load config before save file")[1].count() == 1
    assert search.answer(s, "returns the thing unchanged")[0] == "search"


def test_javascript_names():
    cases = {
        "const { a, b: c, d = 1, ...rest } = load(x);\nuse(a, c, d, rest, { a, b: a, rest() {} });": "const { a: v0, b: v1, d: v2 = 1, ...v3 } = load(x);\nuse(v0, v1, v2, v3, { a: v0, b: v0, rest() {} });",
        "function go(p, [q, r], s = p) { return p + q.r + r + s; }": "function go(v0, [v1, v2], v3 = v0) { return v0 + v1.r + v2 + v3; }",
        "const f = (x, y) => x + y.x; list.map(z => z * 2);": "const v0 = (v1, v2) => v1 + v2.x; list.map(v3 => v3 * 2);",
        "try { go(); } catch (err) { log('err', err); }": "try { go(); } catch (v0) { log('err', v0); }",
        "for (const k of keys) { let m = 1, n = f(k, m); n += m }": "for (const v0 of keys) { let v1 = 1, v2 = f(v0, v1); v2 += v1 }",
        "const o = { k: 1 }; const k = o.k; send({ k, o: o });": "const v0 = { k: 1 }; const v1 = v0.k; send({ k: v1, o: v0 });",
        "class A { run(step) { if (step) { return step.run; } } }": "class A { run(v0) { if (v0) { return v0.run; } } }",
        "": "", "if (a) { b(c); }": "if (a) { b(c); }",
    }
    for source, want in cases.items():
        assert transforms.rename_javascript(source) == want


def test_search_explained(spark):
    from quern.operators import search
    from quern.sources import sample

    corpus, queries, _ = sample.load_sample(spark)
    asked = queries.limit(4).unionByName(spark.createDataFrame([("none", "zzzz qqqq")], "query_id string, text string"))
    hits, report, notes = search.explained(corpus, asked, search.SearchConfig(use_dense=False, hub_beta=0.5))
    assert [r["stage"] for r in report.orderBy("place").collect()] == ["sparse", "reranked"] and all(r["seconds"] > 0 for r in report.collect())
    assert "the dense arm is off" in notes and "sparse: 1 of 5 questions without hits" in notes and any("no hubs" in n for n in notes)
    plain = search.search(corpus, asked, search.SearchConfig(use_dense=False, hub_beta=0.5))
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.collect()))
