"""Exact nearest templates: L1 distance over small grey bitmaps plus weighted scalars, the best k labels within a margin.

Templates are dealt into blocks by their total ink, and each block has a box around its members: the sums of a few cells
of their bitmaps, and their scalars. The distance of a query to a box is never above its distance to any member. A query
is first measured against the block with the nearest box; what it finds there bounds what is still of interest, and
only blocks whose box lies within the bound are searched after it. In a block, the distance of cell sums goes first, and
exact distances are added up quarter by quarter for the templates that are still within the bound.

An atlas is a dimension table: up to LOCAL templates, its blocks are broadcast and queries are answered where they lie.
Beyond, blocks and queries are dealt to tasks and stream past each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators.cut import cut
from rasterlake.operators.shapes import ASPECT, COMPONENTS, HOLES, SHAPE_ASPECT, SHAPE_FILL

#: Templates of a block, about; blocks at most (their boxes are broadcast); queries that a copy of a block serves; cells.
BLOCK, MOST_BLOCKS, SERVED, CELLS = 1024, 20_000, 100_000, 16
#: Templates that are broadcast at most (some 1 KB each), and those of a block of them.
LOCAL, LOCAL_BLOCK = 65_536, 256
#: Distances are compared to so many decimals, so that sums in another order are ties.
DECIMALS = 9


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two integer arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)


def block_sums(v: Column, width: int = 8, cell: int = 2) -> Column:
    """Sums of the cells of an image that is given by rows: the coarse vector."""
    n = width // cell
    cells = [[(cell * cy + dy) * width + cell * cx + dx for dy in range(cell) for dx in range(cell)] for cy in range(n) for cx in range(n)]
    return F.array(*[sum((F.element_at(v, i + 1) for i in own[1:]), F.element_at(v, own[0] + 1)) for own in cells])


def coarse_bound(a: Column, b: Column) -> Column:
    """A lower bound of l1_distance of two images: the distance of their block sums."""
    return l1_distance(block_sums(a), block_sums(b))


def _coarse(m: np.ndarray) -> np.ndarray:
    """Sums of CELLS parts of each row: square cells of a square image, else stretches."""
    n, d = m.shape
    side, cell = round(d**0.5), round(CELLS**0.5)
    if side * side == d and side % cell == 0:
        return m.reshape(n, cell, side // cell, cell, side // cell).sum((2, 4)).reshape(n, -1)
    return np.add.reduceat(m, np.arange(CELLS) * d // CELLS, axis=1) if d >= CELLS else m


class Metric:
    """L1 of integer vectors over `unit`, plus the weighted differences of scalars."""

    def __init__(self, weights: tuple[float, ...] = (), unit: int = 1) -> None:
        self.weights, self.unit = np.array(weights, np.float64), unit

    def scalar(self, s: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (np.abs(s - of) * self.weights).sum(1) if len(self.weights) else np.zeros(len(s))

    def box(self, v: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Lower and upper ends of the cell sums and scalars of a block, one row."""
        c = np.concatenate([_coarse(v).astype(np.float64), s], 1)
        return np.concatenate([c.min(0), c.max(0)])

    def to_boxes(self, v: np.ndarray, s: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """queries x boxes: never above the distance to a member of the block."""
        c = np.concatenate([_coarse(v).astype(np.float64), s], 1)
        w = np.concatenate([np.full(c.shape[1] - len(self.weights), 1 / self.unit), self.weights])
        low, high = boxes[:, : c.shape[1]], boxes[:, c.shape[1] :]
        out = np.empty((len(c), len(boxes)))
        for i, row in enumerate(c):
            out[i] = (np.maximum(0, np.maximum(low - row, row - high)) * w).sum(1)
        return out

    def within(self, v: np.ndarray, s: np.ndarray, block: dict, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Members of a block within `most` of a query, and their distances; others are left as soon as they are beyond."""
        acc = self.scalar(block["s"], s)
        at = np.flatnonzero(np.abs(block["c"] - _coarse(v[None])[0]).sum(1) / self.unit + acc <= most + 1e-9)
        total = np.zeros(len(at), np.int64)
        for own in np.array_split(np.arange(len(v)), 4):
            total += np.abs(block["v"][at][:, own] - v[own]).sum(1)
            keep = total / self.unit + acc[at] <= most + 1e-9
            at, total = at[keep], total[keep]
        return at, np.round(total / self.unit + acc[at], DECIMALS)


def _best(block: dict, at: np.ndarray, dist: np.ndarray, k: int, distinct: bool) -> np.ndarray:
    """Places in `at` of the k best, by distance and id; one for each label if they must be distinct."""
    order = np.lexsort((block["id"][at], dist))
    if distinct:
        _, first = np.unique(block["label"][at][order], return_index=True)
        order = order[np.sort(first)]
    return order[:k]


class Index:
    """The blocks of a broadcast table of templates."""

    def __init__(self, metric: Metric, v: np.ndarray, s: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.metric, self.blocks = metric, []
        order = np.lexsort((ids, v.sum(1)))
        for k in range(0, len(order), LOCAL_BLOCK):
            own = order[k : k + LOCAL_BLOCK]
            self.blocks.append({"v": v[own], "c": _coarse(v[own]), "s": s[own], "id": ids[own], "label": labels[own]})
        self.boxes = np.array([metric.box(b["v"], b["s"]) for b in self.blocks])

    def nearest(self, v: np.ndarray, s: np.ndarray, far: np.ndarray, k: int, margin: float, distinct: bool) -> dict[str, np.ndarray]:
        """label, dist and id of the k best, nearest first; far: the distances to the boxes."""
        best = {"id": np.zeros(0, np.int64), "label": np.zeros(0, np.int64), "dist": np.zeros(0)}
        most = float("inf")
        for n in np.argsort(far, kind="stable").tolist():
            if far[n] > most + 1e-9:
                break
            b = self.blocks[n]
            at, dist = self.metric.within(v, s, b, most)
            both = {"id": np.concatenate([best["id"], b["id"][at]]), "label": np.concatenate([best["label"], b["label"][at]]), "dist": np.concatenate([best["dist"], dist])}
            own = _best(both, np.arange(len(both["id"])), both["dist"], k, distinct)
            best = {c: x[own] for c, x in both.items()}
            if len(own):
                most = best["dist"][0] + margin if len(own) < k else min(best["dist"][-1], best["dist"][0] + margin)
        keep = best["dist"] <= (round(best["dist"][0] + margin, DECIMALS) if len(best["dist"]) else 0.0)
        return {c: x[keep] for c, x in best.items()}


_FOUND = "query long, label long, dist double, tmpl long"


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, kind).reshape(len(rows), -1)


def _local(queries: DataFrame, rows: pa.Table, metric: Metric, k: int, margin: float, distinct: bool) -> DataFrame:
    """search() with a broadcast index: no shuffle."""
    of = _matrix(rows["v"], np.int64), _matrix(rows["s"], np.float64), rows["id"].to_numpy(), rows["label"].to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(metric, *shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            v, s = _matrix(b.column("v"), np.int64), _matrix(b.column("s"), np.float64)
            far = metric.to_boxes(v, s, index.boxes)
            found = [index.nearest(v[i], s[i], far[i], k, margin, distinct) for i in range(len(v))]
            n = [len(f["id"]) for f in found]
            flat = lambda c: np.concatenate([f[c] for f in found])  # noqa: E731, B023
            rk = np.concatenate([np.arange(1, x + 1) for x in n]).astype(np.int32)
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat("label")), pa.array(flat("dist")), pa.array(flat("id")), pa.array(rk)], ["query", "label", "dist", "tmpl", "rk"])

    return queries.mapInArrow(run, _FOUND + ", rk int")


def _searched(metric: Metric, k: int, margin: float, distinct: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's k best in a block. Rows come block by block, templates (kind 0) before queries (kind 1)."""
    key, rows, block = None, [], {}
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            if (r["block"], r["part"]) != key:
                key, rows, block = (r["block"], r["part"]), [], {}
            if r["kind"] == 0:
                rows.append(r)
                continue
            if not rows:
                continue
            if not block:
                v = np.array([t["v"] for t in rows], np.int64)
                block = {"v": v, "c": _coarse(v), "s": np.array([t["s"] for t in rows], np.float64).reshape(len(rows), -1), "id": np.array([t["id"] for t in rows], np.int64), "label": np.array([t["label"] for t in rows], np.int64)}
            q, s, most = np.array(r["v"], np.int64), np.array(r["s"], np.float64), r["most"]
            if most == float("inf") and len(rows) > 4 * k:  # a first bound from the members with the nearest cell sums
                near = np.argsort(np.abs(block["c"] - _coarse(q[None])[0]).sum(1) / metric.unit + metric.scalar(block["s"], s), kind="stable")[: 16 * k]
                part = {n: x[near] for n, x in block.items()}
                at, dist = metric.within(q, s, part, most)
                own = _best(part, at, dist, k, distinct)
                if len(own) == k:
                    most = min(dist[own[-1]], dist[own[0]] + margin)
            at, dist = metric.within(q, s, block, most)
            own = _best(block, at, dist, k, distinct)
            out += zip([r["id"]] * len(own), block["label"][at[own]].tolist(), dist[own].tolist(), block["id"][at[own]].tolist())
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["query", "label", "dist", "tmpl"]).astype({"query": "int64", "label": "int64", "dist": "float64", "tmpl": "int64"}), preserve_index=False)


def search(queries: DataFrame, templates: DataFrame, k: int, margin: float = float("inf"), metric: Metric | None = None, distinct: bool = True) -> DataFrame:
    """query, label, dist, tmpl, rk: exactly the k nearest templates of each query, or the nearest of the k nearest labels.

    queries: id, v (array<int>) and s (array<double>, as many as the metric weighs); templates: also label. Ties go to the
    smaller id; what is farther than the best by more than margin is left out. Above LOCAL templates, both sides are dealt
    anew, never joined all with all; templates are copied only where a block has very many queries.
    """
    spark, metric = queries.sparkSession, metric or Metric()
    q = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<int>").alias("v"), F.col("s").cast("array<double>").alias("s"))
    few = templates.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v"), F.col("s").cast("array<double>").alias("s")).limit(LOCAL + 1).toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], _FOUND + ", rk int")
    if few.num_rows <= LOCAL:
        return _local(q, few, metric, k, margin, distinct)
    total = templates.count()
    size = max(BLOCK, -(-total // MOST_BLOCKS))
    ink = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    n = -(-total // size)
    cuts = templates.select(ink.cast("double").alias("ink")).approxQuantile("ink", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    dealt = F.lit(0)
    for c in sorted(set(cuts)):
        dealt = dealt + (ink > c).cast("int")
    ranged = templates.select("id", "label", "v", "s", dealt.alias("range"))
    parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).cast("int").alias("parts"))  # many of equal ink
    member = ranged.join(F.broadcast(parts), "range").withColumn("block", F.col("range") * total + F.pmod(F.xxhash64("id"), F.col("parts")))

    def boxed(g: pa.Table) -> pa.Table:
        v = np.array(g["v"].to_pylist(), np.int64)
        return pa.table({"block": g["block"][:1], "box": pa.array([metric.box(v, np.array(g["s"].to_pylist(), np.float64).reshape(len(v), -1)).tolist()], pa.list_(pa.float64()))})

    boxes = member.select("block", "v", "s").groupBy("block").applyInArrow(boxed, "block long, box array<double>").orderBy("block").toArrow()
    shared = spark.sparkContext.broadcast((boxes["block"].to_numpy(), np.array(boxes["box"].to_pylist())))
    copies = max(1, -(-queries.count() // SERVED))

    def sent(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ends = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.array(b.column("v").to_pylist(), np.int64)
                far = metric.to_boxes(v, np.array(b.column("s").to_pylist(), np.float64).reshape(len(v), -1), ends)
                home = far.argmin(1)
                if first:
                    rows, cols = np.arange(len(v)), home
                else:
                    near = far <= b.column("most").to_numpy()[:, None] + 1e-9
                    near[np.arange(len(v)), home] = False
                    rows, cols = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(names[cols]), *(b.column(c).take(pa.array(rows)) for c in ("id", "v", "s", "most"))], ["block", "id", "v", "s", "most"])

        return run

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(metric, k, margin, distinct, batches)

    own = member.select("block", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), F.lit(0).alias("kind"), "id", "label", "v", "s", F.lit(0.0).alias("most"))

    def met(asked: DataFrame, first: bool) -> DataFrame:
        out = asked.select("id", "v", "s", "most").mapInArrow(sent(first), "block long, id long, v array<int>, s array<double>, most double")
        out = out.select("block", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias("label"), "v", "s", "most")
        # only blocks that are asked for move
        used = own.join(F.broadcast(out.select("block").distinct()), "block", "left_semi") if not first else own
        return used.unionByName(out).repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(visit, _FOUND)

    found = cut(met(q.withColumn("most", F.lit(float("inf"))), True))
    w = Window.partitionBy("query").orderBy("dist", "tmpl")
    kth = found.withColumn("rk", F.row_number().over(w)).groupBy("query").agg(F.min("dist").alias("best"), F.max("dist").alias("last"), F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("n") >= k, F.least("last", F.col("best") + margin)).otherwise(F.col("best") + margin)
    again = q.join(kth.withColumnRenamed("query", "id"), "id", "left").select("id", "v", "s", F.coalesce(most, F.lit(float("inf"))).alias("most"))
    every = found.unionByName(met(again, False))
    if distinct:
        every = every.groupBy("query", "label").agg(F.min(F.struct("dist", "tmpl")).alias("t")).select("query", "label", "t.dist", "t.tmpl")
    ranked = every.withColumn("rk", F.row_number().over(w)).withColumn("best", F.min("dist").over(Window.partitionBy("query")))
    return ranked.where((F.col("rk") <= k) & (F.col("dist") <= F.round(F.col("best") + margin, DECIMALS))).select("query", "label", "dist", "tmpl", "rk")


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.array().cast("array<double>"))


def _whole(df: DataFrame) -> DataFrame:
    return df.select("query", "label", F.col("dist").cast("long").alias("dist"), "tmpl", "rk")


def nearest_labels(queries: DataFrame, templates: DataFrame, k: int = 4, margin: int = 120) -> DataFrame:
    """query, label, dist, tmpl, rk: the k nearest labels of each query (id, v) among templates (id, label, v), by L1.

    A label is as near as its nearest template; ties go to the smaller template id. Labels farther than the best by
    more than margin are left out.
    """
    return _whole(search(_plain(queries), _plain(templates), k, margin))


def neighbours(queries: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """query, label, dist, tmpl, rk: the k nearest exemplars of each query by L1, ties to the smaller id."""
    return _whole(search(_plain(queries), _plain(exemplars), k, distinct=False))


def glyph_rows(df: DataFrame, feature: str, *others: str) -> DataFrame:
    """id, v, s (and others) of glyph features, for nearest_glyphs()."""
    f = F.col(feature)
    return df.select("id", *others, f["bmp"].alias("v"), F.array(f["log_aspect"], f["holes"].cast("double"), f["ncomp"].cast("double")).alias("s"))


def nearest_glyphs(queries: DataFrame, templates: DataFrame, k: int = 4, margin: float = 15.0) -> DataFrame:
    """search() by the distance of glyphs: pixels, aspect, holes and components; rows as glyph_rows() makes them."""
    return search(queries, templates, k, margin, Metric((ASPECT, HOLES, COMPONENTS), 255))


def shape_rows(df: DataFrame, feature: str, *others: str) -> DataFrame:
    """id, v, s (and others) of shape descriptors, for shape_votes(): orientations count 10 where ink counts 6."""
    f = F.col(feature)
    v = F.concat(F.transform(f["hog"], lambda x: x * 10), F.transform(f["ink"], lambda x: x * 6))
    return df.select("id", *others, v.alias("v"), F.array(f["log_aspect"], f["fill"]).alias("s"))


def nearest_shapes(queries: DataFrame, exemplars: DataFrame, k: int = 5) -> DataFrame:
    """search() by the distance of shapes: orientations, ink, aspect and fill; any exemplar counts."""
    return search(queries, exemplars, k, metric=Metric((SHAPE_ASPECT, SHAPE_FILL), 2550), distinct=False)


def pruned(templates: DataFrame, tau: int) -> DataFrame:
    """Templates (id, label, v) without those within tau of an earlier kept one of their label; greedy in order of id."""

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        m = np.array(g["v"].tolist(), np.int32)
        kept: list[int] = []
        for i in range(len(m)):
            if not kept or np.abs(m[kept] - m[i]).sum(1).min() > tau:
                kept.append(i)
        return g.iloc[kept][["id", "label"]]

    return templates.groupBy("label").applyInPandas(keep, "id long, label long")


def voted(near: DataFrame) -> DataFrame:
    """query, label, n, dist_sum, weight, confidence, rk of neighbours (query, label, dist): each votes for its label.

    A vote weighs 1 / (1 + dist); confidence is a label's share of all votes; the order is confidence, then label.
    """
    by = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("dist_sum"), F.sum(F.lit(1.0) / (1 + F.col("dist"))).alias("weight"))
    w = Window.partitionBy("query")
    shared = by.withColumn("confidence", F.col("weight") / F.sum("weight").over(w))
    return shared.withColumn("rk", F.row_number().over(w.orderBy(F.desc(F.round("confidence", 9)), "label")))


def votes(queries: DataFrame, exemplars: DataFrame, k: int = 5) -> DataFrame:
    """voted() by the k nearest exemplars of each query by L1."""
    return voted(neighbours(queries, exemplars, k))


def shape_votes(queries: DataFrame, exemplars: DataFrame, k: int = 5) -> DataFrame:
    """voted() by the k nearest exemplars of each query by the distance of shapes; rows as shape_rows() makes them."""
    return voted(nearest_shapes(queries, exemplars, k))


def means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """The cluster of each row by Lloyd's rounds: seeds evenly spaced, ties to the lowest cluster, empty ones stay put."""
    n = len(x)
    centres = x[(2 * np.arange(k) + 1) * n // (2 * k)].astype(float)
    own = np.zeros(n, int)
    for _ in range(rounds):
        far = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        own = far.argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return own


def leaves(x: np.ndarray, rows: int = 15) -> np.ndarray:
    """The leaf of each row, of about so many rows, by clusters of clusters; leaves are numbered cluster by cluster."""
    n = len(x)
    out = np.zeros(n, int)
    if not n:
        return out
    top, base = means(x, min(n, max(1, round((n / rows) ** 0.5)))), 0
    for cluster in np.unique(top):
        at = np.flatnonzero(top == cluster)
        _, own = np.unique(means(x[at], -(-len(at) // rows)), return_inverse=True)
        out[at] = base + own
        base += int(own.max()) + 1
    return out
