"""The most similar vectors of every vector, by navigable small-world graphs.

Method: vectors are divided into shards by their nearest centroid; each shard
holds a hierarchical navigable small-world graph as flat neighbour arrays; the
results of the shards are merged. Centroids are fitted on a bounded sample
(``SAMPLE`` vectors of a view, by the order of a hash of their key), every
vector is indexed. A cell above ``SHARD`` vectors is divided again by centroids
of its own, fitted on as large a sample of the cell, so shards keep their size
and a vector is copied to 1 + ``PROBES`` of them however many vectors there are.
What is still too large (about 2 billion vectors of a view) is split by a salt,
and the queries of the shard go to all of its parts. A vector searches its own
shard through the links its insertion made, and visits its next ``PROBES`` shards
by beam search. Similarities of what is found are computed anew in double
precision before they are ranked and cut.

Equal vectors are indexed once. Their keys are brought in at the end: of a group
of copies the first keys stand for all of it as neighbours, and every key of it
gets the neighbours of its vector; so a group of any size costs no search.

A shard is streamed: its vectors come first and are bounded, the visiting
queries follow in batches, whatever their number.

Defined cases
  * a vector counts if it has exactly ``dim`` finite components, not all zero; length does not matter.
  * rows with a null key or view are ignored; repeated rows count once, of different
    vectors under one key the greatest (component by component) counts.
  * equal similarities are ranked by key; pairs have the smaller key first.
  * views of a single vector have no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import checkpoint, parallelism

DIM = 64
SAMPLE = 20_000
CELL = 2_000
MOST_CELLS = 1_024
SHARD = 8_000
#: Vectors that look for their shards of a large cell in one task.
VISITS = 50_000
PROBES = 2
LINKS = 12
BEAM = 40
BATCH = 256


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 11):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.beam = beam
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(np.int64), 4)
        top = int(level.max()) if n else 0
        self.order = np.argsort(-level, kind="stable")  # higher layers come first, so that lower ones can be entered through them
        self.layers = [np.full((n, 2 * links if h == 0 else links), -1, np.int32) for h in range(top + 1)]
        self.weights = [np.full(l.shape, -np.inf, np.float32) for l in self.layers]
        self.level = level[self.order]
        done, size = 0, 32
        while done < n:
            batch = self.order[done : done + size]
            self._insert(batch, self.order[:done], level)
            done += len(batch)
            size = min(BATCH, 2 * size)

    def _link(self, layer: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """Add edges a to b of similarity s; each node keeps its most similar ones."""
        nodes = np.unique(a)
        wide = self.layers[layer].shape[1]
        have, w = self.layers[layer][nodes], self.weights[layer][nodes]
        i, j = np.nonzero(have >= 0)
        a = np.concatenate([nodes[i], a])
        b = np.concatenate([have[i, j], b])
        s = np.concatenate([w[i, j], s])
        o = np.lexsort((b, -s, a))
        a, b, s = a[o], b[o], s[o]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, s = a[fresh], b[fresh], s[fresh]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        keep = nth < wide
        self.layers[layer][nodes] = -1
        self.weights[layer][nodes] = -np.inf
        self.layers[layer][a[keep], nth[keep]] = b[keep]
        self.weights[layer][a[keep], nth[keep]] = s[keep]

    def _insert(self, batch: np.ndarray, before: np.ndarray, level: np.ndarray) -> None:
        q = self.x[batch]
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        near = min(len(batch) - 1, self.layers[0].shape[1])
        entry = before[:1]
        for layer in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(level[batch] >= layer)
            wide = self.layers[layer].shape[1] // (2 if layer == 0 else 1)
            if len(before):
                ids, sims = self._beam(layer, q, np.broadcast_to(entry, (len(q), entry.shape[-1])) if entry.ndim == 1 else entry, self.beam if len(here) else 1)
                entry = ids[:, :4].clip(0)
            if not len(here):
                continue
            a, b, s = [], [], []
            if len(before):
                k = min(wide, ids.shape[1])
                i, j = np.nonzero(ids[here, :k] >= 0)
                a.append(batch[here[i]]), b.append(ids[here[i], j].astype(np.int64)), s.append(sims[here[i], j])
            if near > 0 and len(here) > 1:
                inside = within[np.ix_(here, here)]
                k = min(wide, len(here) - 1)
                best = np.argpartition(-inside, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(here)), k)
                a.append(batch[here[i]]), b.append(batch[here[best.ravel()]]), s.append(inside[i, best.ravel()])
            if a:
                a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
                self._link(layer, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of a layer for all queries at once: ids and similarities, best first; -1 where there is none."""
        links, x = self.layers[layer], self.x
        n_q = len(q)
        row = np.arange(n_q)[:, None]
        seen = np.zeros((n_q, len(x) + 1), bool)
        seen[:, -1] = True

        def fresh(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[seen[row[: len(ids)] if len(ids) == n_q else row, ids]] = -1
            seen[row, ids] = True
            return ids, np.where(ids >= 0, np.einsum("bkd,bd->bk", x[ids], q), -np.inf)

        ids, sims = fresh(np.array(entry, np.int64))
        open_ = ids >= 0
        while True:
            rank = np.where(open_, sims, -np.inf)
            k = min(wide, ids.shape[1])
            pick = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < ids.shape[1] else np.broadcast_to(np.arange(k), (n_q, k))
            usable = np.isfinite(rank[row, pick])
            if not usable.any():
                break
            open_[row, pick] = False
            step = np.where(usable[:, :, None], links[ids[row, pick]], -1).reshape(n_q, -1).astype(np.int64)
            new, s = fresh(step)
            ids, sims = np.concatenate([ids, new], axis=1), np.concatenate([sims, s], axis=1)
            open_ = np.concatenate([open_, new >= 0], axis=1)
            if ids.shape[1] > beam:
                best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, open_ = ids[row, best], sims[row, best], open_[row, best]
        o = np.argsort(-sims, axis=1, kind="stable")
        return ids[row, o], sims[row, o]

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        entry = np.broadcast_to(self.order[:1], (len(q), 1))
        for layer in range(len(self.layers) - 1, 0, -1):
            ids, _ = self._beam(layer, q, entry, 4)
            entry = ids[:, :4].clip(0)
        return self._beam(0, q, entry, self.beam)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of the lowest layer, each pair once."""
        i, j = np.nonzero(self.layers[0] >= 0)
        k = self.layers[0][i, j].astype(np.int64)
        pair = np.unique(np.minimum(i, k) * len(self.x) + np.maximum(i, k))
        return pair // len(self.x), pair % len(self.x)


def valid_vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(view_name, hash, vector) of the vectors that count, one for each key."""
    v = F.col("vector")
    inf = float("inf")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    good = rows.where(F.col("hash").isNotNull() & F.col("view_name").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))
    return good.groupBy("view_name", "hash").agg(F.max("vector").alias("vector"))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-6, total / np.maximum(size, 1e-6), c)
    return c.astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(centroids: dict[str, np.ndarray], dim: int, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column("vector"), dim)).astype(np.float32)
            views = np.array(b.column("view_name").to_pylist(), object)
            cells = [[]] * b.num_rows
            for view in set(views.tolist()):
                at = np.flatnonzero(views == view)
                c = centroids[view]
                sims = x[at] @ c.T
                k = min(probes + 1, len(c))
                best = np.argsort(-sims, axis=1)[:, :k]
                for row, near in zip(at.tolist(), best.tolist(), strict=True):
                    cells[row] = near
            yield pa.RecordBatch.from_arrays([b.column("view_name"), b.column("hash"), b.column("vector"), pa.array(cells, pa.list_(pa.int32()))], ["view_name", "hash", "vector", "cells"])

    return run


def _fit(dim: int, cell: int) -> Callable[[pa.Table], pa.Table]:
    """The centroids of one cell, one after the other in an array, from its sample."""

    def run(t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t["vector"].combine_chunks(), dim)).astype(np.float32)
        c = fit_centroids(x, max(1, min(len(x), -(-t["n"][0].as_py() // cell))))
        return pa.table([t["view_name"][:1], t["cell"][:1], pa.array([c.ravel()], pa.list_(pa.float32()))], ["view_name", "cell", "centroids"])

    return run


def _divide(dim: int, probes: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nearest centroids of a cell to the vectors that visit it, and how near they are."""

    def run(visits: pa.Table, fitted: pa.Table) -> pa.Table:
        near, sims = np.zeros(0, np.int32), np.zeros(0, np.float32)
        k = 1
        if visits.num_rows:
            x = _unit(_matrix(visits["vector"].combine_chunks(), dim)).astype(np.float32)
            c = fitted["centroids"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            k = min(probes + 1, len(c))
            all_sims = np.concatenate([x[a : a + 4096] @ c.T for a in range(0, len(x), 4096)])
            near = np.argsort(-all_sims, axis=1)[:, :k].astype(np.int32)
            sims = np.take_along_axis(all_sims, near, 1).ravel()
            near = near.ravel()
        at = np.repeat(np.arange(visits.num_rows), k)
        columns = [visits[c].take(at) for c in ("view_name", "hash", "cell")]
        return pa.table([*columns, pa.array(near, pa.int32()), pa.array(sims, pa.float32())], ["view_name", "hash", "cell", "sub", "near"])

    return run


def _shards(placed: DataFrame, dim: int, probes: int) -> DataFrame:
    """(view_name, hash, vector, probe, cell, sub): the shards of each vector, its own first."""
    every = placed.select("view_name", "hash", "vector", F.posexplode("cells").alias("probe", "cell"))
    sizes = placed.groupBy("view_name", F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > SHARD)  # at most MOST_CELLS rows for each view
    if large.isEmpty():
        return every.withColumn("sub", F.lit(0))
    held = every.join(F.broadcast(large), ["view_name", "cell"])
    share = F.pmod(F.xxhash64(F.lit("sample"), "hash"), F.lit(1_000_000)) < 1_000_000.0 * SAMPLE / F.col("n")
    fitted = held.where((F.col("probe") == 0) & share).groupBy("view_name", "cell").applyInArrow(_fit(dim, CELL), "view_name string, cell int, centroids array<float>")
    fitted = checkpoint(fitted)
    parts = F.ceil(F.col("n") / VISITS).cast("int")
    visits = held.select("view_name", "cell", "hash", "vector", F.pmod(F.xxhash64("hash"), parts).cast("int").alias("part"))
    copies = fitted.join(F.broadcast(large), ["view_name", "cell"]).select("view_name", "cell", "centroids", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    keys = ["view_name", "cell", "part"]
    divided = visits.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_divide(dim, probes), "view_name string, hash string, cell int, sub int, near float")
    # of the parts of large cells, and of small cells, the nearest; those of small cells keep their place among the cells
    small = every.join(F.broadcast(large), ["view_name", "cell"], "left_anti").select("view_name", "hash", "cell", F.lit(0).alias("sub"), F.lit(None).cast("float").alias("near"), "probe")
    order = every.select("view_name", "hash", "cell", "probe")
    choice = divided.join(order, ["view_name", "hash", "cell"]).unionByName(small)
    w = W.partitionBy("view_name", "hash").orderBy(F.when(F.col("near").isNull(), F.col("probe")).otherwise(0), F.col("near").desc_nulls_first(), "probe", "cell", "sub")
    best = choice.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") <= probes)
    return best.join(placed.select("view_name", "hash", "vector"), ["view_name", "hash"]).select("view_name", "hash", "vector", F.col("place").alias("probe"), "cell", "sub")


def _pairs(dim: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["view_name", "query", "other", "cosine"]

    def result(view: str, a: list[str], b: list[str], cos: np.ndarray) -> pa.RecordBatch:
        """Pairs both ways round: what one side found holds for the other."""
        columns = [pa.array([view] * (2 * len(a)), pa.string()), pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(np.r_[cos, cos], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, keys, exact, graph = None, [], [], None, None

        def build() -> pa.RecordBatch:
            """The graph of the shard gathered so far, and the pairs its own links give."""
            nonlocal exact, graph
            exact = _unit(np.concatenate(parts))
            graph = SmallWorld(exact)
            a, b = graph.edges()
            cos = np.einsum("ij,ij->i", exact[a], exact[b])
            at = np.flatnonzero(cos >= least)
            return result(shard[0], [keys[i] for i in a[at]], [keys[i] for i in b[at]], cos[at])

        for batch in batches:
            views, cells, salts = batch.column("view_name").to_pylist(), batch.column("cell").to_pylist(), batch.column("salt").to_pylist()
            visiting = batch.column("visiting").to_numpy(zero_copy_only=False).astype(bool)
            x, hashes = _matrix(batch.column("vector"), dim), batch.column("hash").to_pylist()
            ids = list(zip(views, cells, salts, strict=True))
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and ids[end] == ids[at] and visiting[end] == visiting[at]:
                    end += 1
                if ids[at] != shard:
                    if parts and graph is None:
                        yield build()
                    shard, parts, keys, exact, graph = ids[at], [], [], None, None
                if not visiting[at]:
                    parts.append(x[at:end])
                    keys += hashes[at:end]
                elif parts:
                    if graph is None:
                        yield build()
                    for lo in range(at, end, BATCH):
                        q = _unit(x[lo : min(end, lo + BATCH)])
                        found, _ = graph.search(q)
                        i, j = np.nonzero(found >= 0)
                        other = found[i, j]
                        cos = np.einsum("ij,ij->i", q[i], exact[other])
                        good = cos >= least
                        a = [hashes[lo + r] for r in i[good]]
                        b = [keys[r] for r in other[good]]
                        differ = np.array([p != r for p, r in zip(a, b, strict=True)], bool)
                        yield result(shard[0], [p for p, d in zip(a, differ, strict=True) if d], [p for p, d in zip(b, differ, strict=True) if d], cos[good][differ] if len(differ) else cos[good])
                at = end
        if parts and graph is None:
            yield build()

    return run


def similar_pairs(rows: DataFrame, k: int = 10, least: float = 0.90, dim: int = DIM, probes: int = PROBES) -> DataFrame:
    """(view_name, query, other, cosine, rank_no): of each vector its k most similar others of the view, from ``least`` on."""
    keyed = checkpoint(valid_vectors(rows, dim))
    distinct = keyed.groupBy("view_name", "vector").agg(F.min("hash").alias("hash"), F.count(F.lit(1)).alias("copies"))
    vectors = checkpoint(distinct.select("view_name", "hash", "vector", "copies"))
    both = _indexed(vectors.drop("copies"), least, dim, probes)
    several = vectors.where("copies > 1")
    if not several.isEmpty():
        # the keys of a group of copies; its first k + 1 stand for it as neighbours
        member = several.select("view_name", "vector", F.col("hash").alias("rep")).join(keyed, ["view_name", "vector"]).select("view_name", "rep", F.col("hash").alias("key"))
        among = W.partitionBy("view_name", "rep").orderBy("key")
        first = member.withColumn("n", F.row_number().over(among)).where(F.col("n") <= k + 1).select("view_name", F.col("rep").alias("other"), F.col("key").alias("other_key"))
        inside = several.select("view_name", F.col("hash").alias("query"), F.col("hash").alias("other"), F.lit(1.0).alias("cosine"))
        of = member.select("view_name", F.col("rep").alias("query"), F.col("key").alias("query_key"))
        wide = both.unionByName(inside).join(of, ["view_name", "query"], "left").join(first, ["view_name", "other"], "left")
        both = wide.select("view_name", F.coalesce("query_key", "query").alias("query"), F.coalesce("other_key", "other").alias("other"), "cosine").where("query <> other")
    w = W.partitionBy("view_name", "query").orderBy(F.col("cosine").desc(), "other")
    return both.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def _indexed(vectors: DataFrame, least: float, dim: int, probes: int) -> DataFrame:
    """(view_name, query, other, cosine) of what the graphs find among distinct vectors, from ``least`` on."""
    spark = vectors.sparkSession
    counts = {r["view_name"]: r["n"] for r in vectors.groupBy("view_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "view_name string, query string, other string, cosine double")
    centroids = {}
    for view, n in sorted(counts.items()):
        sample = vectors.where(F.col("view_name") == view).orderBy(F.xxhash64("hash"), "hash").limit(SAMPLE).select("vector").toArrow()
        x = _unit(_matrix(sample.column("vector").combine_chunks(), dim)).astype(np.float32)
        centroids[view] = fit_centroids(x, max(1, min(MOST_CELLS, len(x), n // CELL)))
    placed = vectors.mapInArrow(_assign(centroids, dim, probes), "view_name string, hash string, vector array<float>, cells array<int>")
    every = _shards(placed, dim, probes)
    # how often a shard must still be split: one row for each that must
    sizes = every.where("probe = 0").groupBy("view_name", "cell", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("parts")).where("parts > 1")
    every = every.join(sizes, ["view_name", "cell", "sub"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int")
    spread = every.withColumn("own", own).select(
        "view_name", "hash", "vector", "cell", "sub", "probe", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    ).withColumn("visiting", (F.col("probe") > 0) | (F.col("salt") != F.col("own")))
    shards = (
        spread.select("view_name", "cell", (F.col("sub").cast("bigint") * 1_000_000 + F.col("salt")).alias("salt"), "visiting", "hash", "vector")
        .repartition(parallelism(spark), "view_name", "cell", "salt")
        .sortWithinPartitions("view_name", "cell", "salt", "visiting")
    )
    found = shards.mapInArrow(_pairs(dim, least), "view_name string, query string, other string, cosine double")
    return found.groupBy("view_name", "query", "other").agg(F.max("cosine").alias("cosine"))


def found_pairs(rows: DataFrame) -> DataFrame:
    """(view_name, hash_a, hash_b): different keys, one among the other's ten most similar, cosine 0.90 or more."""
    near = similar_pairs(rows)
    return near.select("view_name", F.least("query", "other").alias("hash_a"), F.greatest("query", "other").alias("hash_b")).distinct()
