from pyspark.sql import functions as F

from quern.functions import code as C
from quern.functions import queries as Q
from quern.functions import text as T
from quern.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first()["v"]


def test_tokens_and_parts(spark):
    assert one(spark, T.tokens(F.col("t")), t="parseHTTPResponse x2 snake_case") == ["parsehttpresponse", "parse", "http", "response", "x2", "x", "2", "snake_case", "snake", "case"]
    assert one(spark, T.tokens(F.col("t")), t="ieötz Étion a1")[:1] == ["ieötz"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert one(spark, T.content_tokens(F.col("t")), t="how do I sort the list") == ["sort", "list"]
    assert one(spark, T.content_tokens(F.col("t")), t="how do I") == ["how", "do", "i"]
    assert one(spark, T.bigrams(T.tokens(F.col("t"))), t="a b c") == ["a_b", "b_c"]
    assert one(spark, T.bigrams(T.tokens(F.col("t"))), t="a") == []


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "hello world", "é序"):
        assert one(spark, T.fnv1a(F.col("t")), t=s) == plain(s)


def test_windows_match_plain(spark):
    def plain(words, budget, overlap):
        if len(words) <= budget:
            return [" ".join(words)]
        step, out = max(1, int(budget * (1 - overlap))), []
        for a in range(0, len(words), step):
            out.append(" ".join(words[a : a + budget]))
            if a + budget >= len(words):
                break
        return out

    for n in (0, 1, 7, 8, 9, 14, 15, 40):
        words = [f"w{i}" for i in range(n)]
        for budget, overlap in ((8, 0.25), (3, 0.9), (5, 0.0)):
            assert one(spark, T.windows(F.col("t"), budget, overlap), t=" \n".join(words)) == plain(words, budget, overlap)


def test_parse_python(spark):
    source = 'import os\nfrom a.b import c\n\nclass Tree:\n    """A tree."""\n    def add_node(self, x):\n        # keep it\n        self.items.append(sorted(x))\n        return "done"\n'
    p = one(spark, C.parsed(F.col("t")), t=source)
    assert p["language"] == "python" and p["names"] == ["add_node"] and p["class_names"] == ["Tree"]
    assert p["imports"] == ["os", "a.b"] and p["docstrings"] == ["A tree.", "keep it"] and p["calls"] == ["append", "sorted"]
    assert p["signatures"] == ["def add_node(self, x)"] and p["strings"] == ["done"]
    assert "returns value" in p["control"] and "defines class" in p["control"] and "builds collection" in p["control"]
    assert one(spark, C.category(C.parsed(F.col("t"))), t=source) == "data_structure"


def test_parse_javascript(spark):
    source = "// reads it\nfunction readFile(path) {\n  return fetch(path);\n}\nconst add = (a, b) => a + b;\nconst fs = require('fs');\n"
    p = one(spark, C.parsed(F.col("t")), t=source)
    assert p["language"] == "javascript" and p["names"] == ["readFile", "add"] and p["calls"] == ["fetch", "require"] and p["imports"] == ["fs"] and p["docstrings"] == ["reads it"]
    assert one(spark, C.category(C.parsed(F.col("t"))), t=source) == "io"
    views = one(spark, C.views(F.col("t"), C.parsed(F.col("t")), F.lit("io"), F.col("t")), t=source)
    assert set(views) == {"nl", "code"} and "uses fetch require" in views["nl"] and views["nl"].endswith("a io routine")


def test_questions(spark):
    assert one(spark, Q.category(F.col("t")), t="what calls parse_config") == "identifier_led"
    assert one(spark, Q.category(F.col("t")), t="shortest path in a graph") == "algorithmic"
    assert one(spark, Q.category(F.col("t")), t="nothing at all") == "behavioural"
    assert one(spark, Q.expansions(T.tokens(F.col("t"))), t="sort sort list") == ["order", "sorted", "rank", "arrange", "array", "arr", "sequence"]
    assert one(spark, Q.variants(F.split("t", " ")), t="load user File") == ["loadUserFile", "LoadUserFile", "load_user_file", "LOAD_USER_FILE", "load-user-file", "loaduserfile", "load user File"]
    assert one(spark, Q.route(F.col("t")), t="sort a list\nof numbers") is None


def test_vectors(spark):
    v = one(spark, V.hashed_vector(F.col("t"), 16), t="alpha beta alpha")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 16
    assert one(spark, V.hashed_vector(F.col("t"), 16), t="") == [0.0] * 16
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    pooled = one(spark, V.mean_pooled(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))))
    assert abs(pooled[0] - 0.5**0.5) < 1e-9


def test_very_long_literals_and_comments(spark):
    from quern.functions import code, transforms
    from quern.operators import lexical

    plain, escaped = "x" * 1_000_000, '\\"' * 500_000
    rows = [(1, f'def f(a):\n    g("{plain}")\n    return h("{escaped}")\n'), (2, "let x = '" + "\\'" * 500_000 + "'; call(x)"), (3, '"' * 200_001 + " open('a')"), (4, "# note\n" * 200_000 + "x = 1\n"), (5, "a" + ".b" * 500_000)]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {r["id"]: r["p"] for r in df.select("id", code.parsed(F.col("content")).alias("p")).collect()}
    assert got[1]["calls"] == ["g", "h"] and got[1]["names"] == ["f"] and got[2]["calls"] == ["call"]
    assert df.select(code.summary(F.col("content"))).count() == df.select(transforms.leading_comment(F.col("content"))).count() == 5
    comments = df.where("id = 4").select(transforms.leading_comment(F.col("content")).alias("c")).first()["c"]
    assert len(comments) == 200_000 * 5 - 1
    assert {r["name"] for r in lexical.most_called(df).collect()} >= {"g", "h", "call", "open"}
    assert lexical.vocabulary(df).count() > 5
