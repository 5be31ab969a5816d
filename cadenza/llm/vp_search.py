"""Nearest neighbours by vantage-point trees, a tree per shard.

Largest inner product becomes smallest distance: each vector x gets one more coordinate sqrt(M^2 - |x|^2), M the
longest length, and a query the coordinate 0, so that distance^2 = |q|^2 + M^2 - 2 q.x. A subtree is skipped if the
triangle inequality puts all of it farther than a query's k-th nearest so far; ``relax`` above one multiplies that
bound, skips more and may miss some, one is exact.

Shards are the cells of a vantage-point tree themselves, grown on a bounded sample, so that a query skips whole shards
by the same bound; what it starts from is its k-th nearest in the sample. Each shard builds its own tree once and lets
the queries pass through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, short_batches
from .vectors import element, matrix, packed, runs_of, usable


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes them all sqrt(most) long."""
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def _vantage(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few points the one whose distances to the others differ most."""
    some = rng.choice(rows, min(8, len(rows)), replace=False)
    seen = rng.choice(rows, min(64, len(rows)), replace=False)
    spread = [np.linalg.norm(x[seen] - x[v], axis=1).std() for v in some]
    return x[some[int(np.argmax(spread))]]


class Cells:
    """A vantage-point tree over a sample whose leaves are numbered: every vector has one, by its distances alone."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, most: float, leaves: int, seed: int = 9) -> None:
        self.sample, self.ids, self.most, self.leaves = sample, ids, most, 0
        self.root = self._grow(lifted(sample, most), np.arange(len(sample)), max(1, leaves), np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaves: int, rng: np.random.Generator):
        if leaves < 2 or len(rows) < 4:
            self.leaves += 1
            return self.leaves - 1
        point = _vantage(x, rows, rng)
        d = np.linalg.norm(x[rows] - point, axis=1)
        near = leaves // 2
        at = float(np.sort(d)[len(d) * near // leaves])
        inside = d <= at
        if inside.all() or not inside.any():
            self.leaves += 1
            return self.leaves - 1
        return point, at, self._grow(x, rows[inside], near, rng), self._grow(x, rows[~inside], leaves - near, rng)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        y, out = lifted(x, self.most), np.zeros(len(x), np.int32)

        def down(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                point, at, near, far = node
                inside = np.linalg.norm(y[rows] - point, axis=1) <= at
                down(near, rows[inside])
                down(far, rows[~inside])

        down(self.root, np.arange(len(x)))
        return out

    def best(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[list[list[int]], list[list[float]], np.ndarray]:
        """Ids and scores of each query's k best of the sample, itself left out, and what its k-th best overall must
        reach: nothing if the sample has fewer."""
        score = np.where(q_ids[:, None] == self.ids[None, :], -np.inf, q @ self.sample.T)
        m = min(k, len(self.sample))
        top = np.argpartition(score, -m, axis=1)[:, -m:]
        i = np.repeat(np.arange(len(q)), m)
        exact = (q[i] * self.sample[top.ravel()]).sum(axis=1).reshape(top.shape)
        exact[~np.isfinite(np.take_along_axis(score, top, 1))] = -np.inf
        floor = exact.min(axis=1) if m == k else np.full(len(q), -np.inf)
        there = np.isfinite(exact)
        return [self.ids[t[o]].tolist() for t, o in zip(top, there, strict=True)], [e[o].tolist() for e, o in zip(exact, there, strict=True)], floor

    def near(self, q: np.ndarray, floor: np.ndarray, relax: float) -> list[list[int]]:
        """For each query the leaves that the bound doesn't skip."""
        y = np.hstack([q, np.zeros((len(q), 1))])
        radius = reach((q * q).sum(axis=1) + self.most, floor)
        out: list[list[int]] = [[] for _ in q]

        def walk(node, a: np.ndarray) -> None:
            if not isinstance(node, tuple):
                for i in a.tolist():
                    out[i].append(node)
                return
            point, at, inner, outer = node
            d = np.linalg.norm(y[a] - point, axis=1)
            for gap, sub in ((d - at, inner), (at - d, outer)):
                go = np.maximum(gap, 0) * relax <= radius[a]
                if go.any():
                    walk(sub, a[go])

        walk(self.root, np.arange(len(q)))
        return out


def reach(base: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """How far a query's k-th nearest is at most, with room for rounding; infinite while there are fewer. ``base`` is
    |q|^2 + M^2, ``floor`` what the k-th best score is at least."""
    return np.sqrt(np.maximum(0, base - 2 * floor + 1e-9 * base)) * (1 + 1e-9) + 1e-9


class Tree:
    """Vantage-point tree over the rows of x: inner nodes split at the median distance to a vantage point."""

    def __init__(self, x: np.ndarray, leaf: int = 128, seed: int = 5) -> None:
        self.x, self.leaf = x, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = _vantage(self.x, rows, self.rng)
        d = np.linalg.norm(self.x[rows] - point, axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return point, (d[near].min(), d[near].max()), (d[far].min(), d[far].max()), self._grow(rows[near]), self._grow(rows[far])


class Shard:
    """The vectors of a shard and their tree; ``visits`` counts leaves that queries looked at, ``skips`` those not."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 128) -> None:
        self.x, self.ids = x, ids
        self.most = (x * x).sum(axis=1).max()
        self.tree = Tree(lifted(x, self.most), leaf)
        self.visits = 0

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int, relax: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), nearest first, ties to the smaller id; unfilled places hold -inf. Rows that
        score less than ``start``, what is known of the k-th best overall, are not looked for."""
        x, ids = self.x, self.ids
        qx = np.hstack([q, np.zeros((len(q), 1))])
        base = (q * q).sum(axis=1) + self.most
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        floor = np.full(len(q), -np.inf) if start is None else start - 1e-9 * base

        def kth(a: np.ndarray) -> np.ndarray:
            return np.maximum(best[a, -1], floor[a])

        def radius(a: np.ndarray) -> np.ndarray:
            return reach(base[a], kth(a))

        def visit(rows: np.ndarray, a: np.ndarray) -> None:
            self.visits += len(a)
            rough = q[a] @ x[rows].T
            near = (rough >= kth(a)[:, None] - 1e-9 * base[a][:, None]) & (q_ids[a][:, None] != ids[rows][None, :])
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                return
            a, near = a[some], near[some]
            i, j = np.nonzero(near)
            exact = np.full(near.shape, -np.inf)
            exact[i, j] = (q[a[i]] * x[rows[j]]).sum(axis=1)
            score = np.hstack([best[a], exact])
            name = np.hstack([who[a], np.where(near, ids[rows][None, :], np.iinfo(np.int64).max)])
            order = np.lexsort((name, -score), axis=-1)[:, :k]
            best[a], who[a] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)

        def home(node, a: np.ndarray) -> None:
            """Each query's own leaf first, so that the search starts with a radius."""
            if not isinstance(node, tuple):
                visit(node, a)
                return
            point, inner, outer, near, far = node
            d = np.linalg.norm(qx[a] - point, axis=1)
            left = d <= (inner[1] + outer[0]) / 2
            for side, sub in ((left, near), (~left, far)):
                if side.any():
                    home(sub, a[side])

        def walk(node, a: np.ndarray) -> None:
            if not isinstance(node, tuple):
                visit(node, a)
                return
            point, inner, outer, near, far = node
            d = np.linalg.norm(qx[a] - point, axis=1)
            for (low, high), sub in ((inner, near), (outer, far)):
                gap = np.maximum(d - high, low - d)
                go = gap * relax <= radius(a)
                if go.any():
                    walk(sub, a[go])

        everyone = np.arange(len(q))
        home(self.tree.root, everyone)
        start_best, start_who = best.copy(), who.copy()
        floor = np.maximum(floor, best[:, -1])
        best[:], who[:] = -np.inf, np.iinfo(np.int64).max
        walk(self.tree.root, everyone)
        # a relaxed walk may have skipped a row that the start had: merge, each row once
        score, name = np.hstack([best, start_best]), np.hstack([who, start_who])
        order = np.lexsort((name, -score), axis=-1)
        score, name = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
        again = np.zeros(name.shape, bool)
        again[:, 1:] = (name[:, 1:] == name[:, :-1]) & (score[:, 1:] == score[:, :-1])
        score[again] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(name, order, 1), np.take_along_axis(score, order, 1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, relax: float = 1.05, shard_rows: int = 8192, sample_rows: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose key is divisible by ``every``: query_id, rank, key, score.

    Scores are inner products in double precision on the vectors as given; ties go to the smaller key. A query's own
    row is no candidate. Vectors that are null, empty, zero or hold null or non-finite components and rows with null
    keys take no part, neither do pairs of different lengths. Fewer candidates give fewer rows, an empty table none.
    Keys are taken as unique; a key that repeats counts once per distinct score.

    The sample (the ``sample_rows`` rows with the smallest hashes of their keys) gives the cells and a start for each
    query; all rows are indexed. A cell of more than ``shard_rows`` rows, equal vectors say, is dealt to several shards by
    hash. Each row goes to one shard; a query goes to the shards of the cells that it can't skip, and passes through
    their trees in batches, so a task holds one shard.
    """
    spark = vectors.sparkSession
    short_batches(spark, 2000)
    scratch = Scratch(spark, "vantage-point")
    kind = element(vectors, vector)
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    rows = rows.where(usable(F.col("id"), F.col("v"))).withColumn("dims", F.size("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = {r["dims"]: (r["n"], r["most"]) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(length).alias("most")).collect()}
    # about twice the sample by hash, so that no task sends more than its share; of a repeated key one row
    total = sum(n for n, _ in lengths.values())
    bound = min((1 << 63) - 1, -(1 << 63) + (2 * sample_rows << 64) // max(1, total))
    small = rows.where(F.xxhash64("id") <= bound).groupBy("dims", "id").agg(F.min("v").alias("v"))
    taken: dict[int, list] = {}
    for r in small.orderBy(F.xxhash64("id"), "id", "dims").limit(sample_rows).collect():
        taken.setdefault(r["dims"], []).append((r["id"], r["v"]))
    cells = {
        d: Cells(np.asarray([v for _, v in own], np.float64), np.asarray([i for i, _ in own], np.int64), lengths[d][1] * (1 + 1e-12), min(-(-lengths[d][0] // shard_rows), max(1, len(own) // 4)))
        for d, own in taken.items()}

    def by_length(batch: pa.RecordBatch):
        """(rows, matrix) for each length of vector in the batch (id, v)."""
        raw = packed(batch.column(1), kind)
        lens = np.asarray([len(r) for r in raw])
        for size in np.unique(lens).tolist():
            at = np.flatnonzero(lens == size)
            yield at, matrix([raw[i] for i in at], kind)

    def deal(batches):
        for batch in batches:
            cell, dims = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for at, x in by_length(batch):
                dims[at] = x.shape[1]
                if x.shape[1] in cells:
                    cell[at] = cells[x.shape[1]].of(x)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), batch.column(0), batch.column(1)], names=["dims", "cell", "id", "v"])

    def ask(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            to: list[list[int]] = [[0]] * batch.num_rows
            hits: list[list[int]] = [[]] * batch.num_rows
            scores: list[list[float]] = [[]] * batch.num_rows
            dims, floor = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -np.inf)
            for at, x in by_length(batch):
                dims[at] = x.shape[1]
                if x.shape[1] in cells:
                    c = cells[x.shape[1]]
                    own, own_scores, floor[at] = c.best(x, ids[at], k)
                    for i, near, h, sc in zip(at.tolist(), c.near(x, floor[at], relax), own, own_scores, strict=True):
                        to[i], hits[i], scores[i] = near, h, sc
            lists = [pa.array(to, pa.list_(pa.int32())), batch.column(0), batch.column(1), pa.array(floor), pa.array(hits, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(dims), *lists], names=["dims", "cells", "id", "v", "floor", "hits", "scores"])

    typed = f"id long, v {vectors.schema[vector].dataType.simpleString()}"
    data = scratch.write(rows.select("id", "v").mapInArrow(deal, f"dims int, cell int, {typed}"), "dealt")
    # at most sample_rows / 4 cells a length of vector
    parts = data.groupBy("dims", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    data = data.join(F.broadcast(parts), ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    told = rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(ask, f"dims int, cells array<int>, {typed}, floor double, hits array<long>, scores array<double>")
    told = scratch.write(told, "asks")
    asks = told.withColumn("cell", F.explode("cells")).join(F.broadcast(parts), ["dims", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = data.select("dims", "cell", "part", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("floor"))
    met = met.union(asks.select("dims", "cell", "part", F.lit(True), "id", "v", "floor"))
    met = met.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part", "asks", "id")

    def run(batches):
        shard, held, at = None, [], None
        for (*here, asking), batch in runs_of(batches, 4):
            if here != at:
                shard, held, at = None, [], here
            if not asking:
                held.append((batch.column(4).to_numpy(), matrix(packed(batch.column(5), kind), kind)))
                continue
            if shard is None:
                if not held:
                    continue
                shard, held = Shard(np.concatenate([x for _, x in held]), np.concatenate([i for i, _ in held])), []
            ids = batch.column(4).to_numpy()
            who, score = shard.search(matrix(packed(batch.column(5), kind), kind), ids, k, relax, batch.column(6).to_numpy())
            there = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(who[there]), pa.array(score[there])], names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score double")
    # a relaxed bound may skip rows that the sample has shown already
    hits = told.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("hits", "scores")).alias("h")).select("query_id", "h.hits", "h.scores")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # rows found twice share their place
    ranked = found.union(hits).withColumn("rank", F.dense_rank().over(first)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
