"""Embedding near-dedup by a random-projection tree forest (operator 1).

Each tree splits the space again and again along a random direction, at the median of a sample, and rows near the
split go to both sides (spill). Vectors of one label meet in the cells of several trees; all that meet are compared
there in double precision, and what reaches the threshold is linked. A pair is counted in the least cell
that it shares, so no pairs are written out: a cell yields for each vector its number of links and one edge to the least
vector it hangs together with.

A pair at cosine 0.98 in 64 dimensions lies about 0.02 apart on a random direction; with the default margin one tree
of depth five misses about 4 % of such pairs and six trees together fewer than one in a million. The margin is the same
everywhere: where it would send more than ``MOST_SPILL`` of a node's sample both ways, as in a dense label, the node is
not split and its rows are compared in blocks. Samples only place the splits; every row is indexed.

The upper part of the trees is grown on the driver from at most ``sample`` vectors (those with the least hashes of
vec_id). Cells that still hold more than ``LARGE`` blocks are split on, on the executors: a sample of each cell's own
vectors gives its medians, along directions made from a seed, until all cells are small or too dense to split. So cells
do not grow with the table. Rows travel as ids and cells; vectors are joined once, when cells are final.

Copies of a vector are one node with a weight. A cell of more than ``block`` nodes is dealt out as pairs of blocks,
so that no task holds more than two blocks; the work of a dense cell stays quadratic, as exact link counts need, but
spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .workspace import Workspace, least_hashes

THRESHOLD, TREES, CELL, BLOCK, SAMPLE, MARGIN, MOST_SPILL, SEED = 0.98, 6, 256, 512, 50_000, 0.015, 0.2, 20240501
#: Blocks that a cell may hold before it is split on, levels of a splitting round, vectors of a cell that place its splits.
LARGE, LEVELS, OWN_SAMPLE, MOST_ROUNDS = 4, 4, 1024, 40


@dataclass
class Tree:
    directions: np.ndarray  # (inner nodes, dim), node k has the children 2k+1 and 2k+2
    thresholds: np.ndarray
    margins: np.ndarray
    depth: int


def grow(sample: np.ndarray, depth: int, seed: int, margin: float = MARGIN, most_spill: float = MOST_SPILL, directions: np.ndarray | None = None) -> Tree:
    """Split the sample up to ``depth`` times along random directions, at the medians; all rows of a node without a split go left."""
    inner = 2**depth - 1
    if directions is None:
        directions = np.random.default_rng(seed).standard_normal((max(inner, 1), sample.shape[1])).astype(np.float32)
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    thresholds, margins = np.full(max(inner, 1), np.inf), np.full(max(inner, 1), margin)
    rows = {0: np.arange(len(sample))}
    for k in range(inner):
        own = rows.pop(k, np.zeros(0, dtype=int))
        if len(own):
            p = sample[own] @ directions[k]
            middle = np.median(p)
            # no more than most_spill of the rows may go both ways
            if np.mean(np.abs(p - middle) <= margin) <= most_spill:
                thresholds[k] = middle
                rows[2 * k + 1], rows[2 * k + 2] = own[p < middle], own[p >= middle]
    return Tree(directions, thresholds, margins, depth)


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that the rows fall into."""
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for _ in range(tree.depth):
        off = np.einsum("ij,ij->i", x[row], tree.directions[node]) - tree.thresholds[node]
        left, right = off < tree.margins[node], off >= -tree.margins[node]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def _numbers(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1), dtype=flat.dtype)


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of any length at unit length, the first ``dim`` components."""
    lens = np.diff(vectors.offsets.to_numpy())
    x = np.zeros((len(vectors), dim), dtype=np.float32)
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        w = _numbers(vectors.take(pa.array(at))).astype(np.float64)
        w /= np.sqrt((w * w).sum(axis=1))[:, None]
        x[at, : min(dim, n)] = w[:, :dim]
    return x


def _router(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2), trees[0].directions.shape[1])
            for t, tree in enumerate(trees):
                row, cell = route(tree, x)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), t, dtype=np.int32)), pa.array(cell), *(batch.column(k).take(at) for k in (0, 1, 3))], ["tree", "cell", "label", "node", "dim"])
    return run


def _directions(dim: int, levels: int, seed: int) -> np.ndarray:
    directions = np.random.default_rng(seed).standard_normal((2**levels - 1, dim)).astype(np.float32)
    return directions / np.linalg.norm(directions, axis=1, keepdims=True)


def _splitter(levels: int, seed: int):
    """The sample of one cell -> the thresholds of its subtree (infinite where a node is too dense to split)."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        tree, cell, label, dim = (k.as_py() for k in key)
        x = _unit(group.column("vector").combine_chunks(), dim)
        own = grow(x, levels, 0, directions=_directions(dim, levels, seed + 1000 * tree))
        return pa.table({"tree": pa.array([tree], pa.int32()), "cell": pa.array([cell], pa.int64()), "label": pa.array([label], group.column("label").type), "dim": pa.array([dim], pa.int32()),
                         "thresholds": pa.array([own.thresholds.tolist()], pa.list_(pa.float64()))})
    return run


def _resplit(levels: int, seed: int):
    """(tree, cell, label, node, dim, vector, thresholds) -> the cells below; ``done`` where the cell is too dense."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, cells, dims = (batch.column(k).to_numpy() for k in (0, 1, 4))
            cuts = _numbers(batch.column(6))
            for tree, dim in sorted(set(zip(trees.tolist(), dims.tolist(), strict=True))):
                own = np.flatnonzero((trees == tree) & (dims == dim))
                if (tree, dim) not in held:
                    held[tree, dim] = _directions(dim, levels, seed + 1000 * tree)
                x = _unit(batch.column(5).take(pa.array(own)), dim)
                off = x @ held[tree, dim].T - cuts[own]
                row, node = np.arange(len(own)), np.zeros(len(own), dtype=np.int64)
                for _ in range(levels):
                    left, right = off[row, node] < MARGIN, off[row, node] >= -MARGIN
                    row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
                at = pa.array(own[row])
                done = np.isinf(cuts[own[row], 0])
                with np.errstate(over="ignore"):  # another number for each cell below
                    below = np.where(done, cells[own[row]], (cells[own[row]] * np.int64(0x9E3779B97F4A7C1) + node + 1) ^ np.int64(seed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(below), batch.column(2).take(at), batch.column(3).take(at), batch.column(4).take(at), pa.array(done)], ["tree", "cell", "label", "node", "dim", "done"])
    return run


def compare(vectors: np.ndarray, nodes: np.ndarray, copies: np.ndarray, cells: list, cell: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors that meet in a cell: the links whose least common cell it is, by weight, and the least node
    that each hangs together with. ``cells`` holds all cells of each vector. Where ``side`` has two values only pairs
    across are compared."""
    x = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    near = x @ x.T >= threshold
    near &= (side[:, None] != side[None, :]) if side.any() else ~np.eye(len(x), dtype=bool)
    links = np.zeros(len(x), dtype=np.int64)
    a, b = np.nonzero(near)
    if len(a):
        some = np.unique(a)  # pairs are symmetric
        less = {k: [y for y in cells[k] if y < cell] for k in some.tolist()}
        wide = max(map(len, less.values()))
        own = np.zeros((len(x), max(wide, 1)), dtype=np.int64)
        known = np.zeros(own.shape, dtype=bool)
        for k, c in less.items():
            own[k, : len(c)], known[k, : len(c)] = c, True
        new = np.ones(len(a), dtype=bool)
        for j in range(wide):
            for k in range(wide):
                new &= (own[a, j] != own[b, k]) | ~known[a, j] | ~known[b, k]
        np.add.at(links, a[new], copies[b[new]])
    root = nodes.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        if (low == root).all():
            break
        root = low
    return links, root


def _comparer(threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        sides = group.column("side").to_numpy()
        if len(nodes) > 1:
            vectors = _numbers(group.column("vector").combine_chunks()).astype(np.float64)
            links, root = compare(vectors, nodes, copies, _Lists(group.column("cells").combine_chunks()), key[2].as_py(), sides - sides.min(), threshold)
        else:
            links, root = np.zeros(len(nodes), dtype=np.int64), nodes
        some = (links > 0) | (root != nodes)
        return pa.table({"node": nodes[some], "links": links[some], "root": root[some]})
    return run


class _Lists:
    """A list column, read by row."""

    def __init__(self, column: pa.ListArray):
        self.ends, self.flat = column.offsets.to_numpy(), column.values.to_numpy()

    def __getitem__(self, k: int) -> list[int]:
        return self.flat[self.ends[k] : self.ends[k + 1]].tolist()


def _split_on(work: Workspace, placed: DataFrame, classes: DataFrame, large: int, levels: int, own_sample: int, seed: int) -> DataFrame:
    """``placed`` (tree, cell, label, node, dim) with all cells of more than ``large`` rows split on until they are
    smaller or too dense."""
    at = ["tree", "cell", "label", "dim"]
    label = placed.schema["label"].dataType.simpleString()
    vectors = classes.select(F.col("node").alias("of"), "vector")
    final, held = [], None
    for k in range(MOST_ROUNDS):
        sizes = work.save(placed.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") > large), f"large{k}")
        if not sizes.limit(1).count():
            break
        keyed = sizes.select(*(F.col(c).alias(f"{c}_") for c in at), "n").hint("merge")
        same = (F.col("tree") == F.col("tree_")) & (F.col("cell") == F.col("cell_")) & (F.col("label") == F.col("label_")) & (F.col("dim") == F.col("dim_"))
        inside = placed.join(keyed, same).select(*placed.columns, "n")
        hashed = F.pmod(F.xxhash64("node", F.lit(seed + k)), F.lit(1 << 52)) / float(1 << 52)
        drawn = inside.filter(hashed * F.col("n") < own_sample).join(vectors.hint("merge"), F.col("node") == F.col("of")).select(*at, "vector")
        cuts = work.save(drawn.groupBy(*at).applyInArrow(_splitter(levels, seed + k), f"tree int, cell long, label {label}, dim int, thresholds array<double>"), f"cuts{k}")
        cuts = cuts.select(*(F.col(c).alias(f"{c}_") for c in at), "thresholds")
        moved = placed.join(cuts.hint("merge"), same).join(vectors.hint("merge"), F.col("node") == F.col("of")).select("tree", "cell", "label", "node", "dim", "vector", "thresholds")
        below = work.save(moved.mapInArrow(_resplit(levels, seed + k), f"tree int, cell long, label {label}, node long, dim int, done boolean"), f"below{k}")
        # cells without a cut stay as they are: the small ones, and, at worst, one of which no row was drawn
        final.append(work.save(placed.join(cuts.select("tree_", "cell_", "label_", "dim_").hint("merge"), same, "left_anti"), f"small{k}"))
        final.append(below.filter("done").drop("done"))
        placed = below.filter("not done").drop("done")
        work.drop(f"large{k}", f"cuts{k}")
        held = below
    if held is None:
        return placed
    out = placed
    for part in final:
        out = out.unionByName(part)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE, large: int = LARGE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label; others ignored).

    Two vectors link when their labels are equal and not null and their cosine is ``threshold`` or more. Vectors that
    are null, empty, zero or hold null or non-finite components, and vectors without a label, link with nothing, as
    do vectors of different lengths. Repeated rows count as vectors of their own that share a vec_id. A row without a
    vec_id links with nothing, has a null component_id, and is kept. An empty table gives an empty result."""
    work = Workspace(vectors.sparkSession, "embeddings")
    kind = "float" if "float" in dict(vectors.dtypes)["embedding"] else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    keyed = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64("vector", F.lit(7), "label").alias("b"))))
    keyed = keyed.select("vec_id", "label", "vector", "ok", F.col("key.a").alias("ka"), F.col("key.b").alias("kb"))
    classes = work.save(
        keyed.filter("ok").groupBy("ka", "kb").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "classes")
    largest = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    n, total = largest[0] or 0, largest[1] or 0
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    dim = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    held = np.zeros((0, dim), dtype=np.float32)
    if depth:
        drawn = least_hashes(classes.select("node", "vector"), F.col("node"), sample, total).select("vector").toArrow().column(0)
        held = _unit(drawn.combine_chunks(), dim)
    depth = min(depth, max(0, int(np.log2(max(len(held), 1) / 16))))
    grown = [grow(held, depth, seed + t) for t in range(trees)]
    whole = [t for t in grown if np.isinf(t.thresholds[0])][:1]  # a tree without a split compares all pairs by itself
    forest = work.broadcast(whole or grown)
    label_type = classes.schema["label"].dataType.simpleString()
    placed = work.save(
        classes.select("label", "node", "vector", F.size("vector").alias("dim")).mapInArrow(_router(forest), f"tree int, cell long, label {label_type}, node long, dim int"), "placed")
    placed = _split_on(work, placed, classes, large * block, LEVELS, OWN_SAMPLE, seed) if not whole else placed
    # a cell's number holds its tree; a vector's cells are sorted
    cells = placed.groupBy("node").agg(F.array_sort(F.collect_list(F.xxhash64("tree", "cell"))).alias("cells"))
    full = classes.select("label", "node", "copies", "vector").join(cells.withColumnRenamed("node", "of").hint("merge"), F.col("node") == F.col("of"))
    full = full.select("label", F.size("vector").alias("dim"), "node", "copies", "vector", "cells", F.explode("cells").alias("cell"))
    at = ["label", "dim", "cell"]
    sizes = placed.groupBy("label", "dim", F.xxhash64("tree", "cell").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = work.save(sizes, "sizes")
    # a large cell: every pair of its blocks is a group of its own
    dealt = (
        full.join(sizes.hint("merge"), at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(*at, "node", "copies", "vector", "cells", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"))
    )
    found = work.save(dealt.groupBy(*at, "lo", "hi").applyInArrow(_comparer(threshold), "node long, links long, root long"), "found")
    work.drop("sizes")
    parts = work.save(components(work, found.select(F.col("node").alias("u"), F.col("root").alias("v"))), "parts")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = work.save(
        classes.select("ka", "kb", "node", "copies").join(counts.hint("merge"), "node", "left").join(parts.hint("merge"), "node", "left")
        .select("ka", "kb", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    out = keyed.select("vec_id", "ka", "kb").join(named.hint("merge"), ["ka", "kb"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
