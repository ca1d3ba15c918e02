import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dense, fuse, hits, hub, lexical, lineage, metrics, rerank, snapshots, stats
from quern.operators.positions import numbered


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def snapshot_frame(spark, data):
    return spark.createDataFrame(data, "id string, version string, loaded_at timestamp, hash string, content string, extra int")


def versions_frame(spark, names):
    import datetime

    t0 = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(v, t0 + datetime.timedelta(days=i)) for i, v in enumerate(names)], "version string, built_at timestamp")


def test_snapshot_changes_against_brute_force(spark):
    import datetime
    import hashlib

    r = random.Random(4)
    t0, names = datetime.datetime(2025, 1, 1), ["b", "a", "d", "c"]
    data, truth = [], {v: {} for v in names}
    for i in [None, *"pqrstuvwxyz"]:
        for v in names:
            if r.random() < 0.7:
                copies = [(i, v, t0 + datetime.timedelta(hours=k), r.choice([None, " AB ", "ab", "", "cd"]), r.choice(["x", "y"]), k) for k in range(r.randint(1, 3))]
                data += copies + [copies[-1]]
                h = (copies[-1][3] or "").strip().lower() or hashlib.sha256(copies[-1][4].encode()).hexdigest()
                truth[v][i] = h
    want = set()
    for a, b in zip(names, names[1:]):
        for k in set(truth[a]) | set(truth[b]):
            x, y = truth[a].get(k), truth[b].get(k)
            if x != y:
                want.add((b, k, "added" if x is None else "removed" if y is None else "changed"))
    got = snapshots.snapshot_changes(snapshot_frame(spark, data), versions_frame(spark, names)).collect()
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_snapshot_changes_of_nothing(spark):
    empty = snapshot_frame(spark, [])
    assert snapshots.snapshot_changes(empty, versions_frame(spark, ["a", "b"])).count() == 0
    assert snapshots.snapshot_changes(empty, versions_frame(spark, [])).count() == 0


def test_snapshot_between_empty_versions(spark):
    import datetime

    one = snapshot_frame(spark, [("k", "b", datetime.datetime(2025, 1, 1), None, None, 1)])
    got = rows(snapshots.snapshot_changes(one, versions_frame(spark, ["a", "b", "c"])), "version", "id", "change")
    assert got == [("b", "k", "added"), ("c", "k", "removed")]


def test_numbered_positions(spark):
    data = [(i % 3, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(data, "g int, x int")
    got = numbered(df, [F.col("x")]).orderBy("at").collect()
    assert [g["at"] for g in got] == list(range(500)) and [g["x"] for g in got] == sorted(x for _, x in data)
    for g in range(3):
        part = numbered(df, [F.col("x")], ["g"]).where(F.col("g") == g).orderBy("at").collect()
        assert [p["at"] for p in part] == list(range(len(part))) and [p["x"] for p in part] == sorted(x for h, x in data if h == g)


def vectors(spark, name, m, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} bigint, vector array<double>")


def test_dense_against_numpy(spark):
    r = np.random.default_rng(3)
    docs, q = r.normal(size=(120, 8)), r.normal(size=(7, 8))
    docs[5] = docs[6]  # a tie
    got = dense.dense_topk(vectors(spark, "d", q, "query_id"), vectors(spark, "q", docs), 10, None).collect()
    s = np.round(q @ docs.T, 6)
    for i in range(7):
        want = sorted(range(120), key=lambda j: (-s[i, j], j))[:10]
        assert [g["id"] for g in sorted((g for g in got if g["query_id"] == i), key=lambda g: g["rank_no"])] == want
    assert all(g["score"] > 0 for g in dense.dense_topk(vectors(spark, "d", q, "query_id"), vectors(spark, "q", docs), 100).collect())


def test_hubs_by_hand(spark):
    docs = vectors(spark, "d", [[1, 0, 0], [0, 1, 0], [0.6, 0.8, 0], [0, 0, 1]])
    refs = vectors(spark, "r", [[1, 0, 0], [0.8, 0.6, 0], [0, 1, 0], [0, 0.6, 0.8]], "query_id")
    assert rows(hub.hub_scores(docs, refs, 1), "id", "hub") == [(0, 1.0), (1, 1.0), (2, 0.96), (3, 0.8)]
    own = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "id bigint, query_id bigint")
    assert rows(hub.hub_scores(docs, refs, 2, own), "id", "hub")[0] == (0, 0.0)
    assert rows(hub.hub_scores(docs, refs, 2, own, parity=True), "id", "hub")[0] == (0, -math.inf)
    assert sum(x for _, x in rows(hub.reverse_neighbour_counts(docs, 1), "id", "n")) == 4
    with pytest.raises(Exception, match="no hub"):
        hub.penalised_topk(refs, docs, hub.hub_scores(docs, refs, 1).where("id < 3"), 0.5).collect()


def test_separation(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.85, True), (0.1, False), (0.2, False), (0.15, False)], "score double, group boolean")
    assert hub.separation_auc(df).first()[0] == 1.0
    same = spark.createDataFrame([(0.5, i % 2 == 0) for i in range(6)], "score double, group boolean")
    assert hub.separation_auc(same).first()[0] == 0.5
    assert hub.separation_auc(df.where("group")).first()[0] == 0.5
    share = hub.hub_share(spark.createDataFrame([("a",)] * 5 + [("b",), ("c",)], "id string")).first()
    assert abs(share["share"] - 5 / 7) < 1e-9 and share["top_hub"] == "a"


def ranked(spark, ids, q="q"):
    return spark.createDataFrame([(q, x, i + 1) for i, x in enumerate(ids)], "query_id string, id string, rank_no bigint")


def test_fusion(spark):
    got = rows(fuse.fused([ranked(spark, "abc")]), "id", "score")
    assert got == [("a", round(1 / 61, 9)), ("b", round(1 / 62, 9)), ("c", round(1 / 63, 9))]
    got = {r["id"]: r["score"] for r in fuse.fused([ranked(spark, "xy"), ranked(spark, "zy")], 1).collect()}
    assert got["y"] > got["x"]
    got = {r["id"]: r["score"] for r in fuse.fused([ranked(spark, "a"), ranked(spark, "b")], 60, [1.0, 0.0]).collect()}
    assert got["b"] == 0.0
    with pytest.raises(ValueError):
        fuse.fused([ranked(spark, "a")], 60, [1.0, 2.0])


def test_metrics_by_hand(spark):
    run = ranked(spark, "ab", "q1").union(ranked(spark, "cd", "q2"))
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "d", 1), ("q3", "z", 1)], "query_id string, id string, rel int")
    m = metrics.means(metrics.per_query(run, qrels)).first()
    assert m["queries"] == 3 and abs(m["ndcg"] - (1 + 1 / math.log2(3)) / 3) < 1e-5 and abs(m["mrr_at_k"] - 0.5) < 1e-5
    c = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.86, 2), ("b", "x", 0.5, 1), ("c", "x", 0.5, 1), ("c", "y", 0.495, 2)], "query_id string, id string, score double, rank_no int")
    assert rows(hits.confidence(c), "query_id", "label") == [("a", "high"), ("b", "medium"), ("c", "low")]


def test_proximity_against_two_pointers(spark):
    def plain(doc, terms):
        at = [(i, t) for i, t in enumerate(doc) if t in terms]
        if len(at) < 2:
            return float(len(at))
        kinds = {t for _, t in at}
        if len(kinds) < 2:
            return 0.5
        best = min(b - a + 1 for a, _ in at for b, _ in at if b >= a and {t for i, t in at if a <= i <= b} == kinds)
        return len(kinds) / max(len(kinds), best)

    r = random.Random(1)
    data = []
    for k in range(40):
        doc = [r.choice("abcdefgh") for _ in range(r.randint(0, 14))]
        matched = [t for t in "abc" if t in doc]
        data.append((k, doc, matched, plain(doc, set(matched))))
    df = spark.createDataFrame(data, "k int, doc array<string>, m array<string>, want double")
    for x in df.select("want", rerank.proximity(F.col("doc"), F.col("m")).alias("got")).collect():
        assert abs(x["want"] - x["got"]) < 1e-9
    for _, doc, matched, want in data:
        assert abs(rerank._nearest(doc, set(matched)) - want) < 1e-9


JS = "function validateSession(req) {\n  logEvent('start');\n  const url = SETTINGS_URL;\n  return validate(url);\n}\n"


def test_lexical(spark):
    s = spark.createDataFrame([("a.js::validateSession#10", JS), ("a.js::all#1", "\n" * 9 + JS), ("b.js::x#1", "validateSession(r);\nlogEvent(r);\n// Eventual\n")], "id string, content string")
    assert rows(lexical.uses(s, "SETTINGS_URL"), "unit", "line", "id") == [("a.js", 12, "a.js::validateSession#10")]
    assert rows(lexical.uses(s, "Event"), "unit", "line") == []
    assert rows(lexical.callers(s, "validateSession"), "unit", "line") == [("b.js", 1)]
    assert rows(lexical.definitions(s, "validateSession"), "unit", "line") == [("a.js", 10)]
    assert rows(lexical.calls_before(s, "validateSession", "logEvent"), "unit", "first_line", "second_line") == [("a.js", 10, 11), ("b.js", 1, 2)]
    vocab = lexical.vocabulary(s)
    phrases = spark.createDataFrame([("validate session",), ("'literal'",), ("validatesesion",), ("nothing like it zzz",)], "phrase string")
    best = {r["phrase"]: (r["name"], r["how"]) for r in lexical.resolve(vocab, phrases).where("place = 1").collect()}
    assert best["validate session"] == ("validateSession", "variant") and best["'literal'"] == ("literal", "quoted")
    assert best["validatesesion"] == ("validateSession", "fuzzy") and "nothing like it zzz" not in best


def test_lineage(spark):
    import datetime

    t = datetime.datetime(2025, 1, 1)
    data = [("p::f#1", "a", t, None, "one", 1), ("p::f#9", "b", t, None, "one", 1), ("p::f#9", "c", t, None, "two", 1), ("p::g#1", "a", t, None, "x", 1), ("p::g#5", "a", t, None, "y", 1)]
    h = lineage.history(snapshot_frame(spark, data), versions_frame(spark, "abc"))
    assert rows(lineage.history_labels(h), "lineage", "label") == [("p::f", "a = b != c"), ("p::g#1", "a"), ("p::g#5", "a")]
    d = lineage.history_diffs(h).collect()
    assert len(d) == 1 and "-one" in d[0]["diff"] and "+two" in d[0]["diff"]
    r = rows(lineage.release_diff(snapshot_frame(spark, data), versions_frame(spark, "abc")), "version", "added", "removed", "changed", "new_texts")
    assert r == [("b", 1, 3, 0, 0), ("c", 0, 0, 1, 1)]


def test_bootstrap(spark):
    flat = spark.createDataFrame([("s", f"q{i}", 0.4) for i in range(50)], "system string, query_id string, score double")
    b = stats.bootstrap(flat, 50).first()
    assert b["n"] == 50 and b["low"] == b["high"] == 0.4
    up = spark.createDataFrame([("s", f"q{i:03}", i / 100) for i in range(100)], "system string, query_id string, score double")
    b = stats.bootstrap(up, 100).first()
    assert b["low"] < b["mean"] < b["high"]
    two = spark.createDataFrame([(s, f"q{i}", v) for s, v in (("a", 0.5), ("b", 0.1)) for i in range(40)], "system string, query_id string, score double")
    p = stats.paired(two, "a", "b", 50).first()
    assert p["significant"] and abs(p["diff"] - 0.4) < 1e-9 and p["p"] == 0.0
    g = stats.bootstrap_generator(up, 100).first()
    assert g["low"] < 0.495 < g["high"]


def test_names_of_two_letter_pieces(spark):
    vocab = lexical.vocabulary(spark.createDataFrame([("abycd = 1; ab_cd = 2; unrelated = 3; go_up = abcd_ef",)], "content string"))
    phrases = spark.createDataFrame([("abxcd",), ("go up",), ("up go",)], "phrase string")
    got = {(r["phrase"], r["name"], r["how"]) for r in lexical.resolve(vocab, phrases).collect()}
    assert ("abxcd", "abycd", "fuzzy") in got and ("go up", "go_up", "variant") in got and ("up go", "go_up", "contains") in got


def test_best_over_blocks_keeps_ties():
    r = np.random.default_rng(5)
    scores = np.round(r.random((400, 7)), 1)  # many equal ones
    scores[r.random(scores.shape) < 0.2] = -np.inf
    best = dense.Best(3, 7)
    best.room = 50  # cut often
    for a in range(0, 400, 16):
        for b in (0, 4):
            best.add(scores[a : a + 16, b : b + 4], a, b)
    query, doc, score = best.cut()
    got = set(zip(query.tolist(), doc.tolist(), strict=True))
    want = {(q, d) for q in range(7) for d in range(400) if np.isfinite(scores[d, q]) and scores[d, q] >= np.sort(scores[:, q])[-3]}
    assert got == want and len(score) == len(want)
    assert len(dense.Best(3, 0).cut()[0]) == 0
