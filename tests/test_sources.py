import datetime
import json
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators.encode import HashingEncoder, encode, encode_into
from quern.sources import files, git, records, store
from quern.streaming import watch

PY = "import os\n\n\n@wrap\ndef load(path, mode):\n    # read everything there is\n    with open(path) as f:\n        return f.read()\n"
JS = "export const keep = async ({ a, b }) => {\n  if (a) { return call(b); }\n  return other(a, b, 'text');\n};\nfunction second(x) { return x.map(y => y + 1).filter(Boolean); }\n"


def test_extraction():
    got = list(files.snippets_of("lib/a.py", PY))
    assert [g[0] for g in got] == ["lib/a.py::load#4"] and got[0][4].startswith("@wrap")
    names = [g[2] for g in files.snippets_of("b.js", JS)]
    assert names == ["keep", "second"]
    assert [g[2] for g in files.snippets_of("c.go", "func main() {}\n" * 70)] == ["window", "window"]
    broken = "def f(:\n    x = 1  # long enough to be kept as a snippet\n    y = 2\nz = 3\n"
    assert [g[2] for g in files.snippets_of("d.py", broken)] == ["f"]
    assert list(files.snippets_of("e.py", "")) == []
    long = "def f():\n" + "    value = 'x' * 100 + compute_the_next_value()\n" * 200
    assert len(list(files.snippets_of("f.py", long))) == 4


def test_scan(spark):
    rows = [
        ("src/a.py", PY), ("src/b.js", JS), ("node_modules/x/i.js", JS), ("env/pyvenv.cfg", "home"), ("env/lib/m.py", PY), (".env", "A=1"), ("k/id_rsa", "x"), ("web/app.min.js", JS),
        ("readme.md", "text"), ("gen.js", "x" * 2500), ("s.py", "def token_of_service():\n    api_key = 'abcdefghijklmnop1234'\n    return api_key\n"), ("null.py", None),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    reason = {r["path"]: r["reason"] for r in files.classified(df).collect()}
    assert reason["src/a.py"] is None and reason["node_modules/x/i.js"] == "vendored dependencies" and reason["env/lib/m.py"] == "virtual environment"
    assert reason[".env"] == reason["k/id_rsa"] == "secret file" and reason["web/app.min.js"] == reason["gen.js"] == "minified or generated" and reason["null.py"] == "unreadable"
    good, report = files.scan(df)
    assert {r["path"] for r in good.collect()} == {"src/a.py", "src/b.js"}
    assert {(r["what"], r["reason"]): r["n"] for r in report.collect()}[("snippet", "contains a secret")] == 1


@pytest.mark.parametrize(
    "name,text",
    [
        ("r.jsonl", '{"id": "a", "text": "x"}\n{"_id": "b", "code": "y", "path": "p"}\n'),
        ("r.json", json.dumps({"a": "x", "b": "y"})),
        ("l.json", json.dumps([{"id": "a", "text": "x"}, {"id": "b", "text": "y"}])),
        ("r.csv", "\ufeffid,text,path\na,x,\nb,y,p\n"),
        ("r.tsv", "id\ttext\na\tx\nb\ty\n"),
        ("r.txt", '{"id": "a", "text": "x"}\n{"id": "b", "text": "y"}\n'),
    ],
)
def test_record_forms(spark, tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text)
    assert sorted((r["id"], r["text"]) for r in records.read_corpus(spark, str(f)).collect()) == [("a", "x"), ("b", "y")]


def test_record_errors(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"id": "a", "text": "x"}\n{"id": "a", "text": "y"}\n')
    with pytest.raises(Exception, match="duplicate id a"):
        records.read_corpus(spark, str(f)).collect()
    f.write_text('{"text": "x"}\n')
    with pytest.raises(Exception, match="no id"):
        records.read_corpus(spark, str(f)).collect()
    q = tmp_path / "q.txt"
    q.write_text("q1 0 d1 1\nq2 0 d2 2.0\n")
    assert sorted((r["query_id"], r["id"], r["rel"]) for r in records.read_qrels(spark, str(q)).collect()) == [("q1", "d1", 1), ("q2", "d2", 2)]


def test_prediction_ties(spark):
    df = spark.createDataFrame([("q", {"d1": 0.5, "d7": 0.9, "d3": 0.9})], "query_id string, scores map<string,double>")
    assert [r["id"] for r in records.predictions_to_ranks(df).orderBy("rank_no").collect()] == ["d7", "d3", "d1"]


def test_rankings_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q", "b", 0.25, 2), ("q", "a", 0.5, 1)], "query_id string, id string, score double, rank_no bigint")
    records.write_rankings(run, str(tmp_path / "out"))
    assert records.read_rankings(spark, str(tmp_path / "out")).first()["ids"] == ["a", "b"]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(store.NotAnIndex):
        store.load(spark, folder)
    v1 = spark.createDataFrame([("a", PY), ("b", JS)], "id string, text string")
    v2 = spark.createDataFrame([("a", PY), ("b", JS + "// changed"), ("c", "const z = 1;")], "id string, text string")
    first = store.build(spark, v1, folder, "v1", "repo", ("nl", "code", "raw"))
    second = store.build(spark, v2, folder, "v2", "repo", ("nl", "code", "raw"))
    assert first["snippets"] == 2 and second["snippets"] == 3 and second["reused_vectors"] >= 3
    assert store.load(spark, folder, "all")[0].count() == 5 and {r["version"] for r in store.load(spark, folder)[0].collect()} == {"v2"}
    assert store.build(spark, v2, folder, "v2", "repo", ("nl", "code", "raw"))["new_vectors"] == 0
    report = store.export(spark, folder, str(tmp_path / "copy")).collect()
    assert {r["table_name"]: r["rows"] for r in report}["snippets"] == 5
    assert all(r["cosine"] >= 0.9999 for r in store.recheck(spark, folder, HashingEncoder()).collect())


def test_a_build_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", PY), ("b", JS)], "id string, text string")
    store.build(spark, rows, folder, "v1")
    monkeypatch.setattr(store.T, "vector_key", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.build(spark, rows, folder, "v2")
    monkeypatch.undo()
    rows.select("id", F.lit("v2").alias("version"), F.lit("x").alias("content")).write.mode("append").partitionBy("version").parquet(f"{folder}/snippets")  # what a build leaves that dies later
    assert {r["version"] for r in store.load(spark, folder, "all")[0].collect()} == {"v1"} and not store.is_committed(spark, folder, "v2")
    store.build(spark, rows, folder, "v2")
    assert store.load(spark, folder, "v2")[0].count() == 2


def test_migration(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    store.build(spark, spark.createDataFrame([("a", PY)], "id string, text string"), old, "v1")
    bare = spark.createDataFrame(spark.read.parquet(f"{old}/snippets").drop("lang", "identifiers").toArrow())
    bare.write.mode("overwrite").partitionBy("version").parquet(f"{old}/snippets")
    store._write_meta(spark, old, {"schema": "1", "encoder": "e", "kind": "", "views": ["nl"]})
    with pytest.raises(store.NotAnIndex, match="migrate"):
        store.load(spark, old)
    assert store.migrate(spark, old, new)["schema"] == store.SCHEMA
    row = store.load(spark, new)[0].first()
    assert row["id"] == "a" and row["lang"] == "" and row["identifiers"] == []


def test_trees_are_pruned_and_links_left_out(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src/a.py").write_text(PY)
    (root / "node_modules/b.py").write_text(PY)
    (root / "src/big.py").write_text("x = 1\n" * 100_000)
    (tmp_path / "outside.py").write_text(PY)
    (root / "src/link.py").symlink_to(tmp_path / "outside.py")
    rows = {r["path"]: r["reason"] for r in files.classified(files.read_tree(spark, str(root))).collect()}
    assert rows == {"src/a.py": None, "src/big.py": "too large (generated)"}


def test_extraction_keeps_the_order_of_a_file(monkeypatch):
    monkeypatch.setattr(files, "snippets_of", lambda p, s: iter([("x", p, "f", 1, "a long first text"), ("x", p, "f", 1, "last")]))
    (got,) = files._extract(iter([pd.DataFrame({"path": ["p.py"], "content": ["c"], "digest": ["d"]})]))
    assert got["at"].tolist() == [0, 1] and got["text"].tolist()[1] == "last"  # of equal ids the greatest place is kept


def test_encode_with_cache(spark, tmp_path):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "gamma")], "id int, text string")
    cache = encode_into(spark, texts, HashingEncoder(8), str(tmp_path / "cache"), 4)
    assert cache.count() == 2
    out = encode(texts, HashingEncoder(8), cache).collect()
    assert len(out) == 4 and [r["vector"] for r in out if r["id"] == 3] == [None]


def test_commit_source_and_sync(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src/a.py").write_text(PY)
    (repo / "notes.md").write_text("x")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t.test", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    assert [(r["path"], r["content"]) for r in git.read_commit(spark, str(repo)).collect()] == [("src/a.py", PY)]
    folder = str(tmp_path / "index")
    assert git.sync(spark, str(repo), folder)["skipped"] is False and git.sync(spark, str(repo), folder)["skipped"] is True


def test_watch_stream(spark, tmp_path):
    src = tmp_path / "heads"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"repo": "r", "at": f"2025-01-01 00:00:0{i}", "head": h}) for i, h in enumerate(["x", "x", "y"])))
    seen = []
    q = watch.watch(watch.heads_of(spark, str(src)), lambda repo, head: seen.append((repo, head)), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [("r", "y")]
    rows = [("r", datetime.datetime(2025, 1, 1, 0, 0, i), h) for i, h in enumerate(["x", "x", None, "y", "y", "x"])]
    got = watch.head_changes(spark.createDataFrame(rows, "repo string, at timestamp, head string"))
    assert [r["head"] for r in got.orderBy("at").collect()] == ["x", "y", "x"]
    assert F is not None


def test_head_changes_with_state(spark, tmp_path):
    src, out = tmp_path / "seen", str(tmp_path / "changes")
    src.mkdir()

    def arrive(name, heads):
        (src / name).write_text("\n".join(json.dumps({"repo": r, "at": f"2025-01-01 00:00:{at:02}", "head": h}) for r, at, h in heads))
        watch.taken_in(watch.head_changes_stream(watch.heads_of(spark, str(src))), out, str(tmp_path / "progress"))
        return sorted((r["repo"], r["at"].second, r["head"]) for r in spark.read.parquet(out).collect())

    first = arrive("1.json", [("r", 2, "y"), ("r", 1, "x"), ("r", 3, "y"), ("s", 1, "a"), ("s", 2, None)])
    assert first == [("r", 1, "x"), ("r", 2, "y"), ("s", 1, "a")]
    assert arrive("2.json", [("r", 5, "y"), ("r", 6, "z"), ("s", 7, "a")]) == sorted([*first, ("r", 6, "z")])


def test_folders_and_records_are_indexed(spark, tmp_path):
    (tmp_path / "tree/src").mkdir(parents=True)
    (tmp_path / "tree/src/a.py").write_text(PY)
    (tmp_path / "tree/notes.md").write_text("x")
    built, report = store.index_folder(spark, str(tmp_path / "tree"), str(tmp_path / "i1"), "v1")
    assert built["snippets"] == 1 and {(r["what"], r["n"]) for r in report.where("n > 0").collect()} == {("file", 1), ("language", 1)}
    (tmp_path / "r.jsonl").write_text('{"id": "a", "text": "x = 1"}\n{"id": "b", "text": "y = 2"}\n')
    assert store.index_records(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "i2"), "v1")["snippets"] == 2
