"""Operators over tables of boxes (frame, id, x, y, w, h): forests, matches, groups and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.geometry import Box
from rasterlake.operators.graph import frame_components
from rasterlake.operators.layout import nested
from rasterlake.operators.ranges import overlap_join, with_bands

BAND = 64


def _as(df: DataFrame, prefix: str) -> DataFrame:
    """Columns frame, and id, x, y, w, h, top, end with a prefix."""
    b = Box.named()
    return df.select("frame", F.col("id").alias(f"{prefix}id"), *b.columns(prefix), b.y.alias(f"{prefix}top"), b.bottom.alias(f"{prefix}end"))


def containers(boxes: DataFrame) -> DataFrame:
    """frame, id, container, area: every box that may be the parent of another: it holds it, and is larger or as large and earlier."""
    b = Box.named()
    inner = boxes.select("frame", "id", *b.columns(), F.floor(b.y / BAND).alias("band"))
    outer = with_bands(_as(boxes.where("w > 0 and h > 0"), "o"), F.col("otop"), F.col("oend"), BAND)
    o = Box.named("o")
    older = (o.area > b.area) | ((o.area == b.area) & (F.col("oid") < F.col("id")))
    return inner.join(outer, ["frame", "band"]).where(o.contains(b) & older).select("frame", "id", F.col("oid").alias("container"), o.area.alias("area"))


def forest(boxes: DataFrame) -> DataFrame:
    """frame, id, parent (-1 for roots), depth: each box's parent is the smallest box that holds it.

    Of equally large ones, it is the latest; equal boxes nest in order of id. A frame's boxes, which are bounded, are
    nested in one pass, largest first; containers() gives all pairs where frames are too large for that.
    """

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        ids, (up, depth) = g["id"].to_numpy(), nested(g[["x", "y", "w", "h"]].to_numpy())
        return pd.DataFrame({"frame": g["frame"].iloc[0], "id": ids, "parent": [ids[k] if k >= 0 else -1 for k in up], "depth": depth})

    return boxes.select("frame", "id", "x", "y", "w", "h").groupBy("frame").applyInPandas(settle, "frame long, id int, parent int, depth int")


def overlapping(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """frame, gid, pid, shared, garea, parea for all pairs of boxes of a frame that share area."""
    g, p = Box.named("g"), Box.named("p")
    pairs = overlap_join(_as(gt, "g"), _as(pred, "p"), ["frame"], ("gtop", "gend"), ("ptop", "pend"), BAND)
    return pairs.where(g.x_overlap(p) > 0).select("frame", "gid", "pid", g.shared_area(p).alias("shared"), g.area.alias("garea"), p.area.alias("parea"))


def matches(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """frame, gid, pid: greedy one-to-one matches of overlapping() pairs with IoU >= num / den.

    In descending IoU, then ascending gid, then pid; the order is part of the result, so a frame's candidates are
    settled together.
    """
    joint = F.col("garea") + F.col("parea") - F.col("shared")
    able = pairs.where(den * F.col("shared") >= num * joint).select("frame", "gid", "pid", (F.col("shared") / joint).alias("iou"))

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["iou", "gid", "pid"], ascending=[False, True, True], kind="stable")
        one, two, keep = set(), set(), []
        for a, b in zip(g["gid"], g["pid"]):
            free = a not in one and b not in two
            keep.append(free)
            if free:
                one.add(a)
                two.add(b)
        return g.loc[keep, ["frame", "gid", "pid"]]

    return able.groupBy("frame").applyInPandas(settle, "frame long, gid int, pid int")


def best_iou(gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """frame, id, pid, best: each box's best IoU with any prediction, 0 and -1 if none; ties go to the smaller pid."""
    iou = (F.col("shared") / (F.col("garea") + F.col("parea") - F.col("shared"))).alias("iou")
    best = pairs.select("frame", "gid", "pid", iou).groupBy("frame", "gid").agg(F.max("iou").alias("best"), F.max_by("pid", F.struct("iou", (-F.col("pid")).alias("k"))).alias("pid"))
    return gt.select("frame", "id").join(best.withColumnRenamed("gid", "id"), ["frame", "id"], "left").select("frame", "id", F.coalesce("pid", F.lit(-1)).alias("pid"), F.coalesce("best", F.lit(0.0)).alias("best"))


def readings(gt: DataFrame, read: DataFrame, least: float = 0.3) -> DataFrame:
    """frame, id, pid, text: the text of the box (frame, id, x, y, w, h, text) that overlaps most, empty below `least` IoU."""
    best = best_iou(gt, overlapping(gt, read)).withColumn("pid", F.when(F.col("best") >= least, F.col("pid")).otherwise(F.lit(-1)))
    texts = read.select("frame", F.col("id").alias("pid"), "text")
    return best.join(texts, ["frame", "pid"], "left").select("frame", "id", "pid", F.coalesce("text", F.lit("")).alias("text"))


def ratio(num: str, den: str):
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))


def _ious(g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in g and p, shared area and area of both together, of the boxes (x, y, w, h) of a frame that share any."""
    found = []
    for at in range(0, len(g), 512):
        own = g[at : at + 512, None].astype(np.int64)
        shared = np.maximum(0, np.minimum(own[..., 0] + own[..., 2], p[:, 0] + p[:, 2]) - np.maximum(own[..., 0], p[:, 0]))
        shared = shared * np.maximum(0, np.minimum(own[..., 1] + own[..., 3], p[:, 1] + p[:, 3]) - np.maximum(own[..., 1], p[:, 1]))
        i, j = np.nonzero(shared)
        found.append((i + at, j, shared[i, j]))
    i, j, shared = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (list(zip(*found)) or [(), (), ()]))
    area = lambda b: b[:, 2].astype(np.int64) * b[:, 3]
    return i, j, shared, area(g)[i] + area(p)[j] - shared


def _greedy(i: np.ndarray, j: np.ndarray, shared: np.ndarray, joint: np.ndarray, gid: np.ndarray, pid: np.ndarray) -> list[int]:
    """Pairs of a greedy one-to-one match, IoU >= 1 / 2, by falling IoU, then ids. At a higher threshold it is the same, cut short."""
    order = np.lexsort((pid[j], gid[i], -(shared / joint)))
    one, two, kept = set(), set(), []
    for k in order[2 * shared[order] >= joint[order]].tolist():
        if i[k] not in one and j[k] not in two:
            one.add(i[k])
            two.add(j[k])
            kept.append(k)
    return kept


def _sides(gt: DataFrame, pred: DataFrame):
    cols = ["frame", "id", "x", "y", "w", "h"]
    return gt.select(*cols).groupBy("frame").cogroup(pred.select(*cols).groupBy("frame"))


def detection_score(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: counts, true positives at .50 and .75, precision, recall, F1 and mean best IoU, over all frames.

    Both sides of a frame meet in one task, where pairs, best IoU and both thresholds come from one pass.
    """

    def score(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        a, b = g[["x", "y", "w", "h"]].to_numpy(), p[["x", "y", "w", "h"]].to_numpy()
        i, j, shared, joint = _ious(a, b)
        best = np.zeros(len(g))
        np.maximum.at(best, i, shared / np.maximum(joint, 1))
        kept = _greedy(i, j, shared, joint, g["id"].to_numpy(), p["id"].to_numpy())
        more = int((4 * shared[kept] >= 3 * joint[kept]).sum()) if kept else 0
        return pd.DataFrame({"n_gt": [len(g)], "n_pred": [len(p)], "tp50": [len(kept)], "tp75": [more], "iou6": [int(np.floor(best * 1_000_000 + 0.5).sum())]})

    each = _sides(gt, pred).applyInPandas(score, "n_gt long, n_pred long, tp50 long, tp75 long, iou6 long")
    rows = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns))
    rows = rows.withColumn("recall50", ratio("tp50", "n_gt")).withColumn("recall75", ratio("tp75", "n_gt")).withColumn("precision50", ratio("tp50", "n_pred"))
    f1 = F.when(F.col("tp50") > 0, 2 * F.col("tp50") / (F.col("n_gt") + F.col("n_pred"))).otherwise(F.lit(0.0))
    return rows.withColumn("f1_50", f1).withColumn("mean_best_iou", F.when(F.col("n_gt") > 0, F.col("iou6") / F.col("n_gt") / 1e6).otherwise(F.lit(0.0))).drop("iou6")


def grouping_counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: boxes met by exactly one, several or no prediction of their own, predictions over several boxes, overlap.

    A prediction belongs to a box that holds half of it or more; it covers a box of which it holds half or more.
    """
    pairs = overlapping(gt, pred)
    of = pairs.where(2 * F.col("shared") >= F.col("parea")).groupBy("frame", "gid").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("covered"))
    own = gt.select("frame", F.col("id").alias("gid"), Box.named().area.alias("area")).join(of, ["frame", "gid"], "left")
    n = F.coalesce("n", F.lit(0))
    share = F.when(F.col("area") > 0, F.least(F.lit(1_000_000), F.expr("coalesce(covered, 0) * 1000000 div nullif(area, 0)"))).otherwise(F.lit(0))
    left = own.agg(F.count(F.lit(1)).alias("n_gt"), F.count_if(n == 1).alias("one_to_one"), F.count_if(n > 1).alias("split"), F.count_if(n == 0).alias("miss"), F.sum(share).alias("overlap_ppm"))
    over = pairs.where(2 * F.col("shared") >= F.col("garea")).groupBy("frame", "pid").count().agg(F.count_if(F.col("count") > 1).alias("merge"))
    return left.join(over).join(pred.agg(F.count(F.lit(1)).alias("n_pred")))


def depth_score(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: of boxes matched at IoU .50, how many lie equally deep, and how many have matched parents (or none).

    Both sides of a frame meet in one task, which nests and matches them.
    """

    def score(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g, p = g.sort_values("id", kind="stable"), p.sort_values("id", kind="stable")
        a, b = g[["x", "y", "w", "h"]].to_numpy(), p[["x", "y", "w", "h"]].to_numpy()
        i, j, shared, joint = _ious(a, b)
        kept = _greedy(i, j, shared, joint, g["id"].to_numpy(), p["id"].to_numpy())
        (up, deep), (over, low) = nested(a), nested(b)
        other = {int(i[k]): int(j[k]) for k in kept}
        same = sum(deep[m] == low[n] for m, n in other.items())
        parent = sum(over[n] < 0 if up[m] < 0 else other.get(up[m], -2) == over[n] for m, n in other.items())
        return pd.DataFrame({"matched": [len(kept)], "same_depth": [same], "parent_ok": [parent]})

    each = _sides(gt, pred).applyInPandas(score, "matched long, same_depth long, parent_ok long")
    out = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns))
    return out.withColumn("depth_precision", ratio("same_depth", "matched")).withColumn("parent_precision", ratio("parent_ok", "matched"))


def line_links(boxes: DataFrame, gap_pm: int, ratio_pm: int = 2600, overlap_pm: int = 550) -> DataFrame:
    """frame, u, v: pairs of boxes that lie on one line, u before v in the order of (x, y, id).

    Per-mille parameters keep all tests in integers: the gap, in heights; the largest ratio of heights; the least
    shared height. How far a box reaches goes by its own height, so the earlier of a pair decides.
    """
    a, b = Box.named("a"), Box.named("b")
    pairs = overlap_join(_as(boxes, "a"), _as(boxes, "b"), ["frame"], ("atop", "aend"), ("btop", "bend"), BAND)
    before = (a.x < b.x) | ((a.x == b.x) & ((a.y < b.y) | ((a.y == b.y) & (F.col("aid") < F.col("bid")))))
    reach = a.right + F.expr(f"(({gap_pm} * ah + 500) div 1000)")
    low, high = F.least(a.h, b.h), F.greatest(a.h, b.h)
    gap = (b.x - a.right) * 1000 <= gap_pm * high
    return pairs.where(before & (b.x <= reach) & (1000 * high <= ratio_pm * low) & (1000 * a.y_overlap(b) >= overlap_pm * low) & gap).select(
        "frame", F.col("aid").alias("u"), F.col("bid").alias("v")
    )


def block_links(lines: DataFrame, leading_pm: int = 900) -> DataFrame:
    """frame, u, v: pairs of stacked lines that belong to one paragraph: near, of similar height, and aligned or mostly overlapping."""
    reach = F.expr(f"y + h + ({leading_pm} * h) div 1000")
    upper = _as(lines, "a").drop("atop", "aend").join(lines.select("frame", F.col("id").alias("aid"), F.expr("y + h - h div 3").alias("atop"), (reach + 1).alias("aend")), ["frame", "aid"])
    lower = _as(lines, "b").withColumn("bend", F.col("btop") + 1)
    pairs = overlap_join(upper, lower, ["frame"], ("atop", "aend"), ("btop", "bend"), BAND)
    a, b = Box.named("a"), Box.named("b")
    after = (a.y < b.y) | ((a.y == b.y) & ((a.x < b.x) | ((a.x == b.x) & (F.col("aid") < F.col("bid")))))
    low, high = F.least(a.h, b.h), F.greatest(a.h, b.h)
    beside = (F.abs(a.x - b.x) <= low) | (a.x_overlap(b) >= F.expr("(least(aw, bw) * 3) div 4"))
    near = (b.y - a.bottom) * 1000 <= leading_pm * a.h
    return pairs.where(after & near & (2 * high <= 3 * low) & beside).select("frame", F.col("aid").alias("u"), F.col("bid").alias("v"))


def grouped(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """frame, grp, n, x, y, w, h: the groups that links join boxes to; grp is the smallest id of a group."""
    roots = frame_components(boxes.select("frame", "id"), links)
    from rasterlake.functions.geometry import union_of

    return boxes.join(roots, ["frame", "id"]).groupBy("frame", "grp").agg(F.count(F.lit(1)).alias("n"), *union_of())


def kept_by_centre(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of words whose centre lies in a line of their frame."""
    w = Box.named("a")
    lines = with_bands(_as(lines, "b"), F.col("btop"), F.col("bend"), BAND)
    mid = F.floor(F.col("ay") + F.col("ah") / 2).cast("int")
    a = _as(words, "a").withColumn("band", F.floor(mid / BAND))
    centre = Box.named("b").contains_point(F.expr("ax + aw div 2"), F.expr("ay + ah div 2"))
    return a.join(lines.select("frame", "band", "bx", "by", "bw", "bh"), (a["frame"] == lines["frame"]) & (a["band"] == lines["band"]) & centre, "left_semi").select("frame", F.col("aid").alias("id"), *w.columns())


def deduped_greedily(boxes: DataFrame, num: int = 9, den: int = 10) -> DataFrame:
    """Boxes of each frame in order of id, without those whose IoU with a kept one is above num / den."""

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        x, y, w, h = (g[c].to_numpy(np.int64) for c in "xywh")
        kept: list[int] = []
        for i in range(len(g)):
            k = np.array(kept, int)
            ix = np.minimum(x[i] + w[i], x[k] + w[k]) - np.maximum(x[i], x[k])
            iy = np.minimum(y[i] + h[i], y[k] + h[k]) - np.maximum(y[i], y[k])
            shared = np.maximum(ix, 0) * np.maximum(iy, 0)
            if not (den * shared > num * (w[i] * h[i] + w[k] * h[k] - shared)).any():
                kept.append(i)
        return g.iloc[kept][["frame", "id", "x", "y", "w", "h"]]

    return boxes.select("frame", "id", "x", "y", "w", "h").groupBy("frame").applyInPandas(keep, "frame long, id int, x int, y int, w int, h int")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with id: the place of a row in its frame, from 0."""
    return df.withColumn("id", F.row_number().over(Window.partitionBy("frame").orderBy(*order)) - 1)
