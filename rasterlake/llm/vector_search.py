"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and every vector is put into its leaf; the number of leaves follows the number of
vectors as far as the sample bears it. A query takes nodes from a priority queue, the one first whose vectors' inner
products reach highest by their mean and spread, until it has visited so many leaves; that number is widened on the sample
until recall against brute force reaches its target. Leaves lie in blocks of bounded size. Each block goes to one task with
the queries that visit one of its leaves behind it, which pass through: vectors are copied only where a block has very
many queries, and what a task holds is one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded_batches, lean, materialize, table

#: Bounds of the sample that the tree is fitted on and of the queries that it is calibrated with.
SAMPLE, CALIBRATED = 20_000, 300
#: Vectors a leaf, about, in trees of up to FINE leaves and beyond; leaves at most; rows of a block of vectors; queries that
#: one copy of a block serves, about.
FINE_ROWS, FINE, LEAF_ROWS, MOST_LEAVES, BLOCK, SERVED = 16, 500, 100, 2000, 8192, 100_000
#: Standard deviations above the mean at which a node's best vectors are expected.
REACH = 2.0
#: Recall that calibration asks for; it is measured on the sample.
RECALL = 0.96


def valid(embedding: str) -> F.Column:
    """Not null, not empty, finite, and not all zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's centre, by Lloyd's algorithm from distinct rows; empty centres are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        own = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
        used, own = np.unique(own, return_inverse=True)
        centres = np.stack([x[own == j].mean(0) for j in range(len(used))])
    return centres, own


@dataclass
class Tree:
    """Level by level: nodes' centres, variances of their rows, and parents. The last level's nodes are the leaves."""

    centres: list[np.ndarray]
    spreads: list[np.ndarray]
    parents: list[np.ndarray]

    @property
    def leaves(self) -> int:
        return len(self.centres[-1])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root, always the child with the nearest centre."""
        at = np.zeros(len(x), np.int64)
        for c, p in zip(self.centres, self.parents):
            score = x @ c.T - 0.5 * (c * c).sum(1)
            score[at[:, None] != p[None, :]] = -np.inf
            at = np.argmax(score, 1)
        return at

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """Leaves (rows x most) in the order in which each row's priority queue gives them; -1 where there are no more."""
        scores = [(x @ c.T + REACH * np.sqrt((x * x) @ v.T)).tolist() for c, v in zip(self.centres, self.spreads)]
        children = [[np.flatnonzero(p == j).tolist() for j in range(int(p.max()) + 1)] for p in self.parents]
        out = np.full((len(x), most), -1, np.int64)
        last = len(self.centres) - 1
        for r in range(len(x)):
            queue = [(-scores[0][r][j], 0, j) for j in children[0][0]]
            heapq.heapify(queue)
            n = 0
            while queue and n < most:
                _, level, node = heapq.heappop(queue)
                if level == last:
                    out[r, n] = node
                    n += 1
                else:
                    for j in children[level + 1][node]:
                        heapq.heappush(queue, (-scores[level + 1][r][j], level + 1, j))
        return out


def leaves_of(vectors: int) -> int:
    """How many leaves a tree over so many vectors has, about."""
    return min(MOST_LEAVES, max(vectors // LEAF_ROWS, min(FINE, vectors // FINE_ROWS)))


def fit(x: np.ndarray, leaves: int = 0) -> Tree:
    """A tree of about so many leaves (0: by the rows) over the rows of a sample (doubles), the same at every run."""
    rng, x = np.random.default_rng(5), np.unique(x, axis=0)
    leaves = max(1, min(leaves or leaves_of(len(x)), len(x) // 4))
    levels = 1 if leaves <= 8 else 2 if leaves <= 1000 else 3
    branches = max(2, round(leaves ** (1 / levels)))
    centres, spreads, parents, own = [], [], [], np.zeros(len(x), np.int64)
    for _ in range(levels):
        level_c, level_v, level_p, new = [], [], [], np.zeros(len(x), np.int64)
        for node in range(int(own.max()) + 1):
            rows = np.flatnonzero(own == node)
            c, o = _means(x[rows], branches, rng)
            new[rows] = o + sum(map(len, level_c))
            level_c.append(c)
            level_v.append(np.stack([x[rows[o == j]].var(0) for j in range(len(c))]))
            level_p += [node] * len(c)
        centres.append(np.concatenate(level_c))
        spreads.append(np.concatenate(level_v))
        parents.append(np.array(level_p))
        own = new
    return Tree(centres, spreads, parents)


def calibrate(tree: Tree, x: np.ndarray, k: int) -> int:
    """The least number of leaves to visit at which the sample's own queries find RECALL of their k nearest."""
    x = np.unique(x, axis=0)
    if len(x) < 2:
        return tree.leaves
    q = np.random.default_rng(3).choice(len(x), min(CALIBRATED, len(x)), replace=False)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-scores, 1)[:, : min(k, len(x) - 1)]
    leaf, order = tree.leaf_of(x), tree.visits(x[q], tree.leaves)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(tree.leaves)[None, :].repeat(len(q), 0), 1)
    at = np.take_along_axis(place, leaf[near], 1)
    found = np.cumsum(np.bincount(at.ravel(), minlength=tree.leaves)) / at.size
    return int(np.argmax(found >= RECALL)) + 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, added up one component after another: equal vectors score equally wherever they lie."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += q[j] * v[:, j]
    return out


_FOUND = "query_id long, vec_id long, score double"


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's k best among the vectors of a block that are in leaves that it visits.

    Rows come block by block, vectors (kind 0, by leaf) before queries (kind 1); only one block's vectors are held.
    """
    key, ids, leaf, v = None, [], [], []
    block: tuple = ()

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("branch", "block", "part"))))
        rows = zip(keys, b.column("kind").to_pylist(), b.column("id").to_pylist(), b.column("vec").to_pylist(), b.column("leaf").to_pylist(), b.column("leaves").to_pylist())
        out: list[tuple] = []
        for own, kind, i, vec, at_leaf, leaves in rows:
            if own != key:
                key, ids, leaf, v, block = own, [], [], [], ()
            if kind == 0:
                ids.append(i)
                leaf.append(at_leaf)
                v.append(vec)
                continue
            if not ids:
                continue
            if not block:
                names = np.array(ids, np.int64)
                block = names, np.frombuffer(b"".join(v), np.float64).reshape(len(ids), -1), {int(n): (int(x), int(y)) for n, x, y in zip(*_spans(np.array(leaf)))}
            names, m, starts = block
            spans = [starts[n] for n in leaves if n in starts]
            if not spans:
                continue
            at = np.concatenate([np.arange(x, y) for x, y in spans])
            at = at[names[at] != i]
            if not len(at):
                continue
            q = np.frombuffer(vec, np.float64)
            near = m[at] @ q
            if len(at) > k:
                at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - 1e-9 * (1 + np.abs(near).max())]
            score = _exact(q, m[at])
            best = np.lexsort((names[at], -score))[:k]
            out += zip([i] * len(best), names[at][best].tolist(), score[best].tolist())
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def _spans(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, first, count = np.unique(leaf, return_index=True, return_counts=True)
    return names, first, first + count


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, visited, leaves: the k nearest found of each row for which is_query(vec_id) holds.

    Nearness is the inner product in doubles; ties go to the smaller vec_id. Rows with a null id, or with a vector that
    is null, empty, zero, not finite or of another length than the commonest, take no part. Rows with a query's id are
    its own and no candidates; a repeated query is answered once, by its smallest vector; other repeated rows are
    candidates each. An empty table gives an empty result. Columns other than vec_id and embedding are ignored.
    Each query visits `visited` of the tree's `leaves`.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col("vec_id").isNotNull() & valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    sizes = clean.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited int, leaves int")
    bounded_batches(spark, 2048)
    clean = clean.where(F.size("x") == sizes[0]["n"])
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").toArrow()
    x = _matrix(sample["x"]).astype(np.float64)
    tree = fit(x, leaves_of(sizes[0]["count"]))
    most = calibrate(tree, x, k)
    shared = spark.sparkContext.broadcast((tree.centres, tree.spreads, tree.parents))
    branch = tree.parents[-1]  # of each leaf

    @lean()
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*shared.value)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("x")).astype(np.float64)
                leaf = t.leaf_of(m)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(leaf.astype(np.int32)), pa.array(branch[leaf].astype(np.int32))], ["vec_id", "vec", "leaf", "branch"])

    @lean()
    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*shared.value)
        for b in batches:
            m = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(b.num_rows, -1)
            for name, vec, leaves in zip(b.column("query_id").to_pylist(), b.column("vec").to_pylist(), t.visits(m, most) if len(m) else []):
                leaves = leaves[leaves >= 0]
                own = branch[leaves]
                parts = np.unique(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.int64()), pa.array([vec] * len(parts), pa.binary()), pa.array(parts.astype(np.int32)), pa.array([leaves[own == p].astype(np.int32).tolist() for p in parts], pa.list_(pa.int32()))],
                    ["query_id", "vec", "branch", "leaves"],
                )

    @lean()
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(k, batches)

    placed = materialize(clean.mapInArrow(assign, "vec_id long, vec binary, leaf int, branch int"), "leaves")
    queries = placed.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    asked = materialize(queries.mapInArrow(traverse, "query_id long, vec binary, branch int, leaves array<int>"), "asked")
    # branches are as many as the tree has at most; a large one is dealt into blocks, and one with many queries into parts
    counts = placed.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    served = asked.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("parts"))
    counts = materialize(counts.join(served, "branch"), "blocks")
    behind = asked.join(F.broadcast(counts), "branch").select(
        "branch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vec", F.lit(-1).alias("leaf"), "leaves",
    )
    ahead = placed.join(F.broadcast(counts), "branch").select(
        "branch", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", "leaf", F.lit(None).cast("array<int>").alias("leaves"),
    )
    key = ["branch", "block", "part"]
    found = ahead.unionByName(behind).repartition(*key).sortWithinPartitions(*key, "kind", "leaf", "id").mapInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.lit(most).alias("visited"), F.lit(tree.leaves).alias("leaves"))


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """nearest() over all embeddings for the ids divisible by 20; see there for what takes no part, ties and repeated ids."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
