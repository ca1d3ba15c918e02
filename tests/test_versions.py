import dataclasses
import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import search
from quern.plans import code

GONE = "def removed_long_ago(items):\n    first = 1\n    second = 2\n    return first + second + len(items)\n"
OLD = "# keeps every ledger row of the month in order\ndef kept_name(items):\n    first = 1\n    second = 2\n    return first + second + len(items)\n"
NEW = OLD.replace("second = 2", "second = 3")
SECRET = "def token_of_service():\n    api_key = 'abcdefghijklmnop1234'\n    return api_key\n"
LEAK = "# sends all pending orders to the archive\ndef send(items):\n    return items\n"
QUOTED = "def other(items):\n    return ' sends all pending orders to the archive '\n"
ROWS = [
    ("p/gone.py::removed_long_ago#1", "v1", GONE), ("p/kept.py::kept_name#1", "v1", OLD), ("p/kept.py::kept_name#5", "v2", NEW), ("p/kept.py::kept_name#1", "v3", OLD),
    ("p/key.py::token_of_service#1", "v1", SECRET), ("p/send.py::send#1", "v3", LEAK), ("p/other.py::other#1", "v1", QUOTED),
]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("versions"))
    at = datetime.datetime(2024, 1, 1)
    day = datetime.timedelta(1)
    columns = "id string, version string, content string, enriched string, category string, identifiers array<string>, start_line int, loaded_at timestamp"
    spark.createDataFrame([(i, v, c, c, "utility", [], int(i.split("#")[1]), at) for i, v, c in ROWS], columns).write.parquet(f"{d}/snippets.parquet")
    spark.createDataFrame([(f"v{k}", at + k * day) for k in (1, 2, 3)], "version string, built_at timestamp").write.parquet(f"{d}/versions.parquet")
    return d


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_every_version_is_worked(spark, data):
    every = sorted((i, v) for i, v, _ in ROWS)
    for query in (code.renamed_code, code.reordered_code):
        assert rows_of(query(spark, data), "id", "version") == every
    renamed = {(r["id"], r["version"]): r["renamed"] for r in code.renamed_code(spark, data).collect()}
    assert renamed["p/kept.py::kept_name#1", "v1"] == renamed["p/kept.py::kept_name#1", "v3"] != renamed["p/kept.py::kept_name#5", "v2"]


def test_files_of_every_version(spark, data):
    assert rows_of(code.scan_files(spark, data), "version", "path") == sorted((v, i.split("::")[0]) for i, v, _ in ROWS)
    texts = {(r["version"], r["id"]): r["text"] for r in code.extract_snippets(spark, data).collect()}
    assert ("v1", "p/gone.py::removed_long_ago#1") in texts and "second = 3" in texts["v2", "p/kept.py::kept_name#2"] and "second = 2" in texts["v3", "p/kept.py::kept_name#2"]
    report = {(r["version"], r["what"], r["reason"]): r["n"] for r in code.scan_report(spark, data).collect()}
    secret = ("snippet", "contains a secret")
    assert report[("v1", *secret)] == 1 and report[("v2", *secret)] == report[("v3", *secret)] == 0 and report["v1", "language", "python"] == 4


def test_comments_of_every_version(spark, data):
    kept = "p/kept.py::kept_name"
    assert rows_of(code.leak_filter(spark, data), "query_id", "version") == [(f"{kept}#1", "v1"), (f"{kept}#1", "v3"), (f"{kept}#5", "v2")]


def test_names_of_every_version(spark, data, monkeypatch):
    from quern.operators import lexical

    seen = {}
    monkeypatch.setattr(lexical, "resolve", lambda vocab, phrases: seen.update(names=rows_of(vocab, "name")))
    code.resolve_names(spark, data)
    assert ("removed_long_ago",) in seen["names"]


def test_search_over_versions(spark):
    docs = [(f"p/a.py::load#{k}", f"v{v}", f"h{v}", "load config file from the disk") for k, v in ((1, 1), (2, 2), (3, 3))]
    docs += [("p/b.py::read#1", "v1", "x", "read config text quickly"), ("p/tests/test_c.py::load#1", "v2", "y", "load config file")]
    docs = spark.createDataFrame(docs, "id string, version string, h string, text string")
    asked = spark.createDataFrame([("q", "load config file")], "query_id string, text string")
    versions = spark.createDataFrame([(f"v{v}", v) for v in (1, 2, 3)], "version string, ord int")
    got = search.search_versions(docs, asked, versions, search.SearchConfig(top_k=3)).collect()
    assert sorted(r["lineage"] for r in got) == ["p/a.py::load", "p/b.py::read", "p/tests/test_c.py::load"]
    assert {r["lineage"]: r["versions"] for r in got}["p/a.py::load"] == "v1 v2 v3" and sorted(r["rank_no"] for r in got) == [1, 2, 3]
    views = docs.select("id", "version", F.lit("code").alias("view_name"), "text").unionByName(docs.select("id", "version", F.lit("nl").alias("view_name"), F.lit("nothing alike").alias("text")))
    got = search.search_versions(docs, asked, versions, dataclasses.replace(search.SearchConfig.shipped(), include_tests=False), views=views).collect()
    assert {r["lineage"] for r in got} == {"p/a.py::load", "p/b.py::read"}
