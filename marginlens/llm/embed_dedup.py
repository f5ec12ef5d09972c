"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits vectors of a label again and again by their place along a random direction; a vector within ``SPILL`` of a
split goes to both sides, so two vectors part only if they differ by more than twice that along the direction and the split
falls between them. Vectors that share a leaf of any tree are compared exactly, in double precision, and the links are
united to components. Links between vectors of one component are then counted in one comparison of the component with
itself, which also finds what the trees have missed inside it.

Equal vectors of a label are one class with a number of copies before anything is compared. Leaves and components of more
than ``CHUNK`` classes are compared in blocks of two chunks, each a task's group of its own, and a block gives back at most
one link per class, never its pairs.

Split places are fitted on the ``SAMPLE`` vectors of the smallest hash; every vector is indexed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import Batches, map_batches, ship
from marginlens.llm.components import components

THRESHOLD = 0.98
TREES = 8
SPILL = 0.015
LEAF = 64
CHUNK = 512
#: Bound of the fitted sample, and the number of levels that have split places of their own for every node.
SAMPLE, NODE_LEVELS = 20_000, 9
LEVELS = 40
SEED = 7

_LEAVES = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("tree", pa.int32()), ("path", pa.int64()),
                     ("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64()))])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_COUNTS = pa.schema([("id", pa.int64()), ("linked", pa.int64())])


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors as rows; scaled by the largest component first, so that no square overflows."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Forest:
    """Directions of every level and split places of every node, for vectors of one dimension."""

    def __init__(self, dim: int, sample: np.ndarray):
        rng = np.random.default_rng([SEED, dim])
        directions = rng.standard_normal((TREES, LEVELS, dim))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.splits: list[list[np.ndarray]] = []
        for tree in range(TREES):
            node, levels = np.zeros(len(sample), np.int64), []
            for level in range(LEVELS):
                along = sample @ self.directions[tree, level]
                middle = float(np.median(along)) if len(along) else 0.0
                if level >= NODE_LEVELS:
                    levels.append(np.array([middle]))
                    continue
                places = np.full(1 << level, middle)
                order = np.argsort(node, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
                    places[node[own[0]]] = np.median(along[own])
                node = 2 * node + (along >= places[node])
                levels.append(places)
            self.splits.append(levels)

    def leaves(self, tree: int, vectors: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) for every leaf of a tree that a row belongs to; rows of a depth go down that many levels."""
        rows, path = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
        for level in range(int(depth.max(initial=0))):
            places, along = self.splits[tree][level], vectors @ self.directions[tree, level]
            going = depth[rows] > level
            at = places[path[going] - (1 << level)] if len(places) > 1 else places[0]
            value = along[rows[going]]
            left, right = value < at + SPILL, value >= at - SPILL
            on_rows, on_path = rows[going], path[going] * 2
            rows = np.concatenate([rows[~going], on_rows[left], on_rows[right]])
            path = np.concatenate([path[~going], on_path[left], on_path[right] + 1])
        return rows, path


def usable(vector: str = "embedding") -> Column:
    """Whether a vector can be linked: not null, with finite components only and not all of them zero."""
    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _leaf_batches(batches: Batches, forests: dict[int, Forest]) -> Batches:
    for rows in batches:
        dims = rows.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = rows.filter(pa.array(dims == dim))
            vectors = matrix(part.column("vector"), int(dim))
            depth = part.column("depth").to_numpy()
            forest = forests.get(int(dim))
            for tree in range(TREES if forest else 1):
                at, path = forest.leaves(tree, vectors, depth) if forest else (np.arange(len(vectors)), np.ones(len(vectors), np.int64))
                for some in range(0, len(at), 8192):
                    own = part.take(pa.array(at[some : some + 8192]))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("label").cast(pa.string()), own.column("dim"), pa.array(np.full(own.num_rows, tree), pa.int32()),
                         pa.array(path[some : some + 8192]), own.column("id"), own.column("copies"),
                         own.column("vector").cast(pa.list_(pa.float64()))], schema=_LEAVES)


def _near(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and copies of a block and its linked pairs as places; a block of one chunk gives each pair once."""
    ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
    chunk = group.column("chunk").to_numpy()
    vectors = matrix(group.column("vector").combine_chunks(), group.column("dim")[0].as_py())
    one, other = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    near = vectors[one] @ vectors[other].T >= THRESHOLD
    if chunk.min() == chunk.max():
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    return ids, copies, one[i], other[j]


def _forest_links(group: pa.Table) -> pa.Table:
    """Links of a block that connect what its pairs connect, fewer than its classes."""
    ids, _, i, j = _near(group)
    root = np.arange(len(ids))
    while True:  # every class takes the smallest place among those it is linked to
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = root != np.arange(len(ids))
    return pa.table([ids[moved], ids[root[moved]]], schema=_LINKS)


def _link_counts(group: pa.Table) -> pa.Table:
    ids, copies, i, j = _near(group)
    linked = np.zeros(len(ids), np.int64)
    np.add.at(linked, i, copies[j])
    np.add.at(linked, j, copies[i])
    some = linked > 0
    return pa.table([ids[some], linked[some]], schema=_COUNTS)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows once for every block of two chunks of their group; groups of one row are left out."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("of")).filter("of > 1").withColumn("chunks", F.ceil(F.col("of") / CHUNK))
    dealt = rows.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))
    dealt = dealt.withColumn("other", other)
    return dealt.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("of", "chunks", "other")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label; others are not read).

    Two vectors are linked if they have the same label, of whatever type, and the same dimension and their cosine is THRESHOLD or more. A vector
    that is null, empty, zero, or holds a null or non-finite component, a null label and a null vec_id link with nothing:
    n_links 0, component_id its vec_id, kept. Equal rows are vectors of their own that are linked; rows that repeat a vec_id
    share its component. ``kept`` is true for the smallest vec_id of a component. No rows in, no rows out.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), "embedding",
                          (usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("usable"))
    classes = rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stage(classes.select("label", F.size("embedding").alias("dim"), "id", "copies", F.col("embedding").alias("vector")),
                    "vector-classes")
    sample = classes.select("dim", "vector", F.xxhash64(F.lit(SEED), "id").alias("draw")).orderBy("draw").limit(SAMPLE)
    drawn: dict[int, list] = {}
    for dim, vector in sample.select("dim", "vector").toLocalIterator():
        drawn.setdefault(dim, []).append(vector)
    forests = {d: Forest(d, matrix(pa.array(v, pa.list_(pa.float64())), d)) for d, v in drawn.items()}

    per_label = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    depth = F.greatest(F.ceil(F.log2(F.col("n") / LEAF)), F.lit(0)).cast("int")
    deep = classes.join(per_label, ["label", "dim"]).withColumn("depth", F.least(depth, F.lit(LEVELS)))
    placed = map_batches(deep.select("label", "dim", "depth", "id", "copies", "vector"), partial(_leaf_batches, forests=forests),
                         "label string, dim int, tree int, path bigint, id bigint, copies bigint, vector array<double>")
    leaf = ["label", "dim", "tree", "path"]
    found = _blocks(stage(placed, "vector-leaves"), leaf).groupBy(*leaf, "low", "high").applyInArrow(_forest_links, "a bigint, b bigint")
    roots = stage(components(stage(found, "vector-links")), "vector-roots")

    joined = classes.join(roots, F.col("id") == F.col("node")).drop("node")
    counted = _blocks(joined, ["root"]).groupBy("root", "low", "high").applyInArrow(_link_counts, "id bigint, linked bigint")
    counted = counted.groupBy(F.col("id").alias("of")).agg(F.sum("linked").alias("linked"))
    of_class = classes.join(roots, F.col("id") == F.col("node"), "left").join(counted, F.col("id") == F.col("of"), "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), F.coalesce("root", "id").alias("component"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    own = rows.filter("usable").join(of_class, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_vector")))
    single = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    every = own.select("vec_id", "links", "component").unionByName(single)
    return every.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
