"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of few dimensions. If two of them differ by a squared distance of at most
D, then in some block they differ by at most the block's share of D. Each block is range-joined under that share on a
grid over its first dimensions; the union of the candidates is then verified exactly.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, short_batches
from .vectors import element, groups_of, matrix, packed, unit, usable

#: Room for rounding in squared distances, which only adds candidates.
SLACK = 1e-9
#: Crowded cells that may be broadcast (a label and five numbers each).
BROADCAST_CELLS = 50_000


class Blocks:
    """The rotation and the blocks for vectors of one length."""

    def __init__(self, dims: int, threshold: float, blocks: int, grid_dims: int, seed: int) -> None:
        rng = np.random.default_rng(seed + dims)
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        cuts = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
        self.spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        far = max(0.0, 2 - 2 * threshold)
        self.budget = [far * (b - a) / dims + SLACK for a, b in self.spans]
        self.grid = [min(grid_dims, b - a) for a, b in self.spans]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that a vector's coordinates are the same wherever they are computed."""
        out = np.empty_like(x)
        for k in range(x.shape[1]):
            out[:, k] = (x * self.turn[:, k]).sum(axis=1)
        return out

    def cells(self, y: np.ndarray, j: int):
        """(rows, cells, at home) for block j: each row's own cell and the later neighbours that its range reaches."""
        a, g, r = self.spans[j][0], self.grid[j], self.budget[j] ** 0.5
        low = np.floor(y[:, a : a + g] / r)
        into = y[:, a : a + g] / r - low
        cell = low.astype(np.int64)
        for step in product((-1, 0, 1), repeat=g):
            if step < (0,) * g:
                continue
            s = np.asarray(step)
            gap = np.where(s > 0, 1 - into, np.where(s < 0, into, 0.0))
            rows = np.flatnonzero((gap * gap).sum(axis=1) <= 1 + 1e-6)
            yield rows, cell[rows] + s, not any(step)


def _mixed(cells: np.ndarray) -> np.ndarray:
    """One long per cell; cells that collide only add candidates."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, blocks: int = 4, grid_dims: int = 2, tile: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row of ``vectors``: key, n_links (other vectors linked directly), component_id, kept (key = component_id).

    Vectors link if their labels are equal and not null and their cosine, in double precision on the vectors as given,
    is at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, rows with null
    keys or labels, and vectors of different length link with nothing. Equal vectors are joined once, whatever their
    number, and count as links of each other; rows that repeat a key count as vectors of their own but share its links.
    A cell with many vectors is cut into tiles of ``tile`` rows that meet in pairs, so no task holds a cell; links come
    out as counts and a spanning forest, never as pairs. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    short_batches(spark, 2000)
    scratch = Scratch(spark, "near-vectors")
    kind = element(vectors, vector)
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"), vectors[label].cast("string").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("id"), F.col("v")) & F.col("label").isNotNull())
    copies = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = scratch.write(copies, "copies")

    made: dict[int, Blocks] = {}

    def plan(dims: int) -> Blocks:
        if dims not in made:
            made[dims] = Blocks(dims, threshold, blocks, grid_dims, seed)
        return made[dims]

    def emit(narrow: bool):
        def run(batches):
            for batch in batches:
                raw = packed(batch.column(2), kind)
                lens = np.asarray([len(x) for x in raw])
                ids, n, labels = (batch.column(c) for c in (0, 1, 3))
                for size in np.unique(lens).tolist():
                    at = np.flatnonzero(lens == size)
                    p = plan(size // int(kind[-1]))
                    y = p.rotate(unit(matrix([raw[i] for i in at], kind)))
                    for j in range(len(p.spans)):
                        for which, cells, home in p.cells(y, j):
                            if not len(which):
                                continue
                            take = pa.array(at[which])
                            cols = [labels.take(take), pa.array(np.full(len(which), size * 1000 + j, np.int32)), pa.array(_mixed(cells)), pa.array(np.full(len(which), home))]
                            if not narrow:
                                cols += [ids.take(take), n.take(take), pa.array([raw[i] for i in at[which]], pa.binary())]
                            yield pa.RecordBatch.from_arrays(cols, names=["label", "block", "cell", "home", "id", "n", "v"][: len(cols)])

        return run

    base = copies.select("rep", "copies", "v", "label")
    size = F.count("*")
    crowded = base.mapInArrow(emit(True), "label string, block int, cell long, home boolean").groupBy("label", "block", "cell").agg(F.count_if("home").alias("homes"), size.alias("all"))
    crowded = crowded.where((F.col("all") > tile) & (F.col("homes") > 0))
    crowded = crowded.select("label", "block", "cell", F.ceil(F.col("homes") / tile).cast("int").alias("tl"), F.ceil(F.col("all") / tile).cast("int").alias("tr"))
    crowded, many = scratch.counted(crowded, "crowded", F.count("*").alias("cells"))
    # few crowded cells are sent to where vectors are, so that these travel once; many are met by a join
    crowded = F.broadcast(crowded) if many["cells"] <= BROADCAST_CELLS else crowded.hint("merge")
    spread = base.mapInArrow(emit(False), "label string, block int, cell long, home boolean, id long, n long, v binary").join(crowded, ["label", "block", "cell"], "left")
    tl, tr = F.coalesce("tl", F.lit(1)), F.coalesce("tr", F.lit(1))
    own_l, own_r = F.pmod(F.xxhash64(F.lit(1), "id"), tl).cast("int"), F.pmod(F.xxhash64(F.lit(2), "id"), tr).cast("int")
    spread = spread.withColumns({"tl": tl, "tr": tr, "l": own_l, "r": own_r})
    one = lambda a, b, left, right: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), left.alias("left"), right.alias("right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("tr") - 1), lambda b: one(F.col("l"), b, F.lit(True), b == F.col("r")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("tl") - 1), lambda a: one(a, F.col("r"), F.lit(False), F.lit(True)))
    both = F.when(F.col("home"), F.concat(as_left, F.filter(as_right, lambda u: u["a"] != F.col("l")))).otherwise(as_right)
    units = spread.withColumn("u", F.explode(both)).select("label", "block", "cell", "u.a", "u.b", "id", "n", "home", "u.left", "u.right", "v")
    units = units.repartition("label", "block", "cell", "a", "b").sortWithinPartitions("label", "block", "cell", "a", "b", "id")

    def join(batches):
        for (_, block, *_rest), t in groups_of(batches, 5):
            if t.num_rows < 2:
                continue
            ids, n = (t.column(c).to_numpy() for c in ("id", "n"))
            home, left, right = (t.column(c).to_numpy() for c in ("home", "left", "right"))
            x = matrix(t.column("v").to_pylist(), kind)
            p, j = plan(block // 1000 // int(kind[-1])), block % 1000
            u = unit(x)
            y = p.rotate(u)
            lo, hi = np.flatnonzero(left), np.flatnonzero(right)
            if not len(lo) or not len(hi):
                continue
            found_a, found_b = [], []
            for at in range(0, len(lo), 512):
                part = lo[at : at + 512]
                once = ~home[hi][None, :] | (ids[part][:, None] < ids[hi][None, :])  # a pair of homes meets in either order
                i, k = np.nonzero((_apart(y, part[:, None], hi[None, :], p.spans[j]) <= p.budget[j]) & once & (ids[part][:, None] != ids[hi][None, :]))
                i, k = part[i], hi[k]
                for e in range(j):  # an earlier block that has the pair counts it
                    later = _apart(y, i, k, p.spans[e]) > p.budget[e]
                    i, k = i[later], k[later]
                if len(i):
                    near = (u[i] * u[k]).sum(axis=1) >= threshold
                    found_a.append(i[near])
                    found_b.append(k[near])
            a, b = np.concatenate(found_a or [np.empty(0, int)]), np.concatenate(found_b or [np.empty(0, int)])
            if not len(a):
                continue
            links = np.bincount(a, weights=n[b], minlength=len(ids)) + np.bincount(b, weights=n[a], minlength=len(ids))
            some = np.flatnonzero(links)
            fa, fb = forest(ids[a], ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], fa])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(fa), np.int64)])), pa.array(np.concatenate([ids[some], fb]))], names=["id", "links", "other"])

    found = scratch.write(units.mapInArrow(join, "id long, links long, other long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    per_rep = copies.join(counts, copies["rep"] == counts["id"], "left").drop("id").join(comp, F.col("rep") == F.col("node"), "left")
    per_rep = per_rep.select(F.col("label").alias("gl"), F.col("v").alias("gv"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.where("ok").join(per_rep, (F.col("label") == F.col("gl")) & (F.col("v") == F.col("gv"))).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _apart(y: np.ndarray, i: np.ndarray, k: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Squared distances within a block, summed in the block's order and equal for either order of a pair."""
    total = 0.0
    for d in range(*span):
        gap = y[i, d] - y[k, d]
        total = total + gap * gap
    return total
