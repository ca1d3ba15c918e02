import datetime
import math
import random
import unicodedata
from collections import Counter

from quern.llm import splitting, term_counts, top_items

T0 = datetime.datetime(2025, 1, 1)
DF = "version string, shard int, term string, n bigint, loaded_at timestamp, total string, record string"
SNIPPETS = "id string, version string, loaded_at timestamp, content string, digest int, config_name string"
CONFIGS = "config_name string, strategy string, budget_tokens int, window_overlap double"


def df_rows(seed):
    r = random.Random(seed)
    terms = ["a", " a", "A ", "é", "é", "É", "", "  ", None, "b", "　c"]
    return [
        (r.choice(["v1", "v2", None]), r.choice([0, 1, None]), "hot" if r.random() < 0.35 else r.choice(terms), r.choice([None, -3, 0, 1, 2, 5]), T0 + datetime.timedelta(hours=r.randint(0, 5)), "x", "y")
        for _ in range(600)
    ]


def brute_counts(rows):
    last = {}
    for v, s, t, n, at, *_ in rows:
        if t is not None and t.strip() and n is not None and n >= 1:
            last[v, s, t] = max(last.get((v, s, t), (at, n)), (at, n))
    total, records = Counter(), {}
    for (v, s, t), (_, n) in last.items():
        k = unicodedata.normalize("NFC", t.strip()).lower()
        total[k] += n
        records.setdefault(k, set()).add((v, s))
    return {k: (n, len(records[k])) for k, n in total.items()}


def test_term_counts(spark):
    rows = df_rows(1)
    rows += rows[:50]
    got = {r["term"]: (r["total"], r["records"]) for r in term_counts.term_counts(spark.createDataFrame(rows, DF)).collect()}
    assert got == brute_counts(rows)


def test_term_marks(spark):
    rows = [("v", 0, "rare", 9, T0, "", ""), ("v", 0, "edge", 10, T0, "", ""), ("v", 0, "common", 11, T0, "", "")]
    snippets = spark.createDataFrame([(f"i{k}", "v", T0, "x", 1, "") for k in range(200)] + [("i0", "v", T0, "y", 1, "")], SNIPPETS)
    got = {r["term"]: r["mark"] for r in term_counts.marked_terms(spark.createDataFrame(rows, DF), snippets).collect()}
    assert got == {"rare": "rare", "edge": None, "common": "common"}
    assert term_counts.marked_terms(spark.createDataFrame([], DF), snippets).count() == 0


def test_top_items_with_heavy_and_light_groups(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        q = "hot" if r.random() < 0.4 else r.choice([None, "a", "b", "c"])
        hits = r.choice([None, [], [(r.choice([None, f"i{r.randint(0, 60)}"]), r.choice([None, math.nan, -1.0, 0.5, 0.5, 2.0, r.random()])) for _ in range(6)]])
        rows.append((k, q, hits, "x", 1))
    best = {}
    for _, q, hits, *_ in rows:
        for i, s in hits or []:
            if i is not None and s is not None and not math.isnan(s):
                best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, -math.inf))
    want = {(q, i, n + 1) for q, items in best.items() for n, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:10])}
    df = spark.createDataFrame(rows, "result_id int, query_id string, hits array<struct<id:string,score:double>>, hit_id string, rank_no int")
    for heavy in (50, 10_000):
        got = [tuple(x) for x in top_items.top_items(df, 10, heavy).select("query_id", "hit_id", "rank_no").collect()]
        assert len(got) == len(want) and set(got) == want
    assert top_items.top_items(df.where("false")).count() == 0


def test_cut_points_cover_and_overlap():
    r = random.Random(3)
    for _ in range(200):
        words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 300))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\n\n", ".\n", "\t", "　"]) for w in words)
        n = len(text.split())
        budget = r.randint(2, 80)
        overlap = r.randint(0, budget - 1)
        pieces = splitting.cut_points(text, budget, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == n and all(0 < b - a <= budget for a, b, *_ in pieces)
        assert all(y[0] == x[1] - overlap for x, y in zip(pieces, pieces[1:]))
        assert [len(text[x:y].split()) for _, _, x, y in pieces] == [b - a for a, b, *_ in pieces]
    assert splitting.cut_points("", 5, 1) == [] and len(splitting.cut_points("word " * 1000, 10, 0)) == 100


def test_cuts_prefer_natural_seams():
    first, second = "alpha beta gamma delta. " * 8, "one two three four. " * 8
    text = first.strip() + "\n\n" + second.strip()
    (a, b, *_), *_ = splitting.cut_points(text, 40, 0)
    assert (a, b) == (0, 32)


def test_pieces(spark):
    long = "word one two\n" * 60
    rows = [("a", "v1", T0, "short", 1, ""), ("a", "v1", T0 + datetime.timedelta(1), long, 1, ""), ("a", "v2", T0, long, 1, ""), ("b", "v1", T0, None, 1, ""), ("c", "v1", T0, "", 1, ""), ("d", "v1", T0 + datetime.timedelta(1), "x", 1, ""), ("d", "v1", T0, long, 1, "")]
    configs = spark.createDataFrame([("k", "windows", 50, 0.2), ("big", "truncate", 180, None), ("off", "windows", 0, 0.1), ("null", None, None, None)], CONFIGS)
    df = spark.createDataFrame(rows + rows[:2], SNIPPETS)
    got = splitting.pieces(df, configs).collect()
    assert {(p["config_name"], p["id"], p["version"]) for p in got} == {("k", "a", "v1"), ("k", "a", "v2")}
    assert sorted(tuple(r) for r in splitting.oversized(df, configs).collect()) == [("k", "a", "v1"), ("k", "a", "v2")]
    assert splitting.pieces(df.where("false"), configs).count() == 0 and splitting.pieces(df, configs.where("false")).count() == 0


def test_very_long_texts_are_cut_in_little_memory():
    import resource

    text = " ".join(f"w{k % 977}" + ("." if k % 9 == 0 else "") for k in range(1_500_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pieces = splitting.cut_points(text, 50_000, 100)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400
    assert pieces[0][0] == 0 and pieces[-1][1] == 1_500_000 and all(b - a <= 50_000 for a, b, *_ in pieces)
    assert all(x[1] - y[0] == 100 for x, y in zip(pieces, pieces[1:], strict=False))
