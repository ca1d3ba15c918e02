import numpy as np

from quern.llm import neighbours

SCHEMA = "hash string, view_name string, vector array<float>, cell int, cosine double"


def clustered(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    x[n // 2 :] = x[r.integers(0, n // 2, n - n // 2)] + r.normal(size=(n - n // 2, 64)) * 0.2
    return x.astype(np.float32)


def test_graph_recall():
    x = neighbours._unit(clustered(1500))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    found, _ = neighbours.SmallWorld(x).search(x)
    near = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(near[i]) & set(found[i])) / 10 for i in range(len(x))]) > 0.9


def test_small_graphs():
    for n in (1, 2, 5, 33):
        x = neighbours._unit(clustered(max(n, 2))[:n])
        g = neighbours.SmallWorld(x)
        assert (g.search(x)[0][:, 0] == np.arange(n)).all() and len(g.edges()[0]) == (n * (n - 1) // 2 if n <= 13 else len(g.edges()[0]))


def brute(rows):
    out = set()
    for view in {r[1] for r in rows} - {None}:
        good = {}
        for h, v, vec, *_ in rows:
            if v == view and h is not None and vec is not None and len(vec) == 64 and all(x is not None for x in vec) and np.isfinite(vec).all() and any(vec):
                good[h] = max(good.get(h, vec), vec)
        if len(good) < 2:
            continue
        keys = sorted(good)
        x = neighbours._unit(np.array([good[k] for k in keys], np.float32))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(keys)):
            for j in sorted(range(len(keys)), key=lambda j: (-s[i, j], keys[j]))[:10]:
                if s[i, j] >= 0.9:
                    out.add((view, min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 100)
    monkeypatch.setattr(neighbours, "SHARD", 120)  # cells are split by salt
    x = clustered(500, 2).tolist()
    rows = [(f"h{k:04}", "raw" if k % 3 else "code", v, 1, 0.5) for k, v in enumerate(x)]
    rows += rows[:20] + [("bad1", "raw", [0.0] * 64, 1, 0.5), ("bad2", "raw", [1.0] * 63, 1, 0.5), ("bad3", "raw", None, 1, 0.5), ("bad4", "raw", [float("nan")] + [1.0] * 63, 1, 0.5)]
    rows += [("bad5", "raw", [float("inf")] + [1.0] * 63, 1, 0.5), (None, "raw", x[0], 1, 0.5), ("n", None, x[0], 1, 0.5), ("copy", "raw", x[1], 1, 0.5), ("alone", "single", x[2], 1, 0.5)]
    want = brute(rows)
    got = [tuple(r) for r in neighbours.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and len(want & set(got)) >= 0.97 * len(want) and not set(got) - want
    assert neighbours.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_cells_are_divided_again_and_copies_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 60)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 3)
    monkeypatch.setattr(neighbours, "SHARD", 150)
    monkeypatch.setattr(neighbours, "VISITS", 200)
    x = clustered(900, 4).tolist()
    rows = [(f"h{k:04}", "raw", v, 1, 0.5) for k, v in enumerate(x)] + [(f"c{k:04}", "raw", x[7], 1, 0.5) for k in range(300)] + [(f"d{k}", "raw", x[9], 1, 0.5) for k in range(3)]
    want = brute(rows)
    got = {tuple(r) for r in neighbours.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
    near = neighbours.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    of_copy = sorted((r["rank_no"], r["other"]) for r in near if r["query"] == "c0200")
    assert [o for _, o in of_copy] == [f"c{k:04}" for k in range(10)]
