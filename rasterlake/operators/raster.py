"""Pixels as rows of arrays (frame, y, v) or as single pixels (frame, x, y, v); all arithmetic in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators.graph import rooted

# Bytes of a pixel and the places of red, green and blue in it, by format.
FORMATS = {"Gray8": (1, 0, 0, 0), "RGB24": (3, 0, 1, 2), "BGR24": (3, 2, 1, 0), "RGBA32": (4, 0, 1, 2), "BGRA32": (4, 2, 1, 0)}


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a colour: weights 77, 150 and 29 of 256, rounded."""
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def planes(width: int, height: int, form: str, pixels: bytes) -> np.ndarray:
    """Red, green and blue (height, width, 3) of packed pixels; grey ones are alike."""
    size, *places = FORMATS[form]
    return np.frombuffer(pixels, np.uint8, width * height * size).reshape(height, width, size)[..., places]


def grey(rgb: np.ndarray) -> np.ndarray:
    """luma() of planes; where all three are equal, as it is: the weights add up to 256, and sums stay below 65536."""
    r, g, b = (rgb[..., k].astype(np.uint16) for k in range(3))
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.int32)


def scanlines(frames: DataFrame) -> DataFrame:
    """frame, y, v from frames (frame, width, height, format, pixels): brightness by rows; Gray8 as it is.

    A frame is decoded in one piece where it lies; its rows are passed on as they are, so nothing is shuffled.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["width"] and r["height"] and r["width"] > 0 and r["height"] > 0:
                    v = grey(planes(r["width"], r["height"], r["format"], r["pixels"])).astype(np.int32)
                    lines = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([r["frame"]] * len(v), pa.int64()), pa.array(np.arange(len(v), dtype=np.int32)), lines], ["frame", "y", "v"])

    return frames.select(F.col("frame").cast("long").alias("frame"), "width", "height", "format", "pixels").mapInArrow(decode, "frame long, y int, v array<int>")


def cropped(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of scanlines inside a box, moved to the origin; the box is clipped to the frame."""
    x0, y0 = max(x, 0), max(y, 0)
    own = F.slice("v", x0 + 1, F.lit(max(0, x + w - x0)))
    return rows.where((F.col("y") >= y0) & (F.col("y") < y + h)).select("frame", (F.col("y") - y0).alias("y"), own.alias("v"))


def edge_strength(rows: DataFrame) -> DataFrame:
    """frame, y, v: each pixel's largest step to one of its four neighbours; beyond the border there is none."""
    w = Window.partitionBy("frame").orderBy("y")
    zero = F.transform("v", lambda x: x * 0)
    step = lambda a: F.coalesce(F.zip_with("v", a, lambda p, q: F.abs(p - q)), zero)
    t = rows.withColumn("up", step(F.lag("v").over(w))).withColumn("down", step(F.lead("v").over(w)))
    right = F.transform("v", lambda p, i: F.coalesce(F.abs(F.try_element_at("v", i + 2) - p), F.lit(0)))
    t = t.withColumn("right", right)
    both = F.transform("right", lambda r, i: F.greatest(r, F.when(i > 0, F.try_element_at("right", F.greatest(i, F.lit(1)))).otherwise(F.lit(0))))
    most = lambda p, q: F.greatest(p, q)
    return t.select("frame", "y", F.zip_with(F.zip_with("up", "down", most), both, most).alias("v"))


def above(rows: DataFrame, threshold: int) -> DataFrame:
    """frame, y, v: 1 where a value is above the threshold, else 0."""
    return rows.withColumn("v", F.transform("v", lambda x: (x > threshold).cast("int")))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("frame", F.posexplode("v").alias("x", "v"), "y")


def histogram(pixels: DataFrame) -> DataFrame:
    """frame, v, n."""
    return pixels.groupBy("frame", "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """frame, threshold: the lowest value up to which one class best parts from the rest; 127 where there is one value.

    The variance between classes is compared as it stands in doubles; only values that occur can be first at it.
    """
    w = Window.partitionBy("frame").orderBy("v")
    whole = Window.partitionBy("frame")
    h = hist.select(
        "frame", "v", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s")
    ).where("w0 < n")
    m0, m1 = F.col("s0").cast("double") / F.col("w0"), (F.col("s") - F.col("s0")).cast("double") / (F.col("n") - F.col("w0"))
    between = F.col("w0").cast("double") * (F.col("n") - F.col("w0")).cast("double") * (m0 - m1) * (m0 - m1)
    best = h.groupBy("frame").agg(F.max_by("v", F.struct(between.alias("b"), (-F.col("v")).alias("k"))).alias("threshold"))
    return hist.select("frame").distinct().join(best, "frame", "left").select("frame", F.coalesce("threshold", F.lit(127)).alias("threshold"))


def percentile(hist: DataFrame, q: int, name: str) -> DataFrame:
    """frame, name: the smallest value with q hundredths of the pixels at or below it."""
    w = Window.partitionBy("frame")
    c = hist.withColumn("c", F.sum("n").over(w.orderBy("v"))).withColumn("t", F.sum("n").over(w))
    return c.where(F.col("c") * 100 >= q * F.col("t")).groupBy("frame").agg(F.min("v").alias(name))


def class_medians(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """frame, low, high: the lower medians of the values up to the threshold and of those above it.

    Where no pixel is above, high is the first value above the threshold, as the first at which half of nothing is.
    """
    part = hist.join(thresholds, "frame").withColumn("up", F.col("v") > F.col("threshold"))
    w = Window.partitionBy("frame", "up")
    c = part.withColumn("c", F.sum("n").over(w.orderBy("v"))).withColumn("t", F.sum("n").over(w)).where("2 * c >= t")
    m = c.groupBy("frame", "threshold").agg(F.min(F.when(~F.col("up"), F.col("v"))).alias("low"), F.min(F.when(F.col("up"), F.col("v"))).alias("high"))
    return m.select("frame", "threshold", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.col("threshold") + 1).alias("high"))


def upper_median(values: Column) -> Column:
    """Of a group's values: the one at half their number, from 0, in order."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def border(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixels of each frame's outermost rows and columns. A corner counts once, but each pixel of a single row twice."""
    p = pixels.join(sizes, "frame")
    edge = p.where("y = 0 or y = height - 1 or x = 0 or x = width - 1")
    return edge.withColumn("again", F.explode(F.when((F.col("height") == 1) | ((F.col("width") == 1) & (F.col("y") > 0) & (F.col("y") < F.col("height") - 1)), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("again")


def runs(pixels: DataFrame) -> DataFrame:
    """frame, y, x0, x1, v: maximal stretches of equal values in rows, [x0, x1)."""
    w = Window.partitionBy("frame", "y").orderBy("x")
    same = Window.partitionBy("frame", "y", "v").orderBy("x")
    island = pixels.withColumn("k", F.row_number().over(w) - F.row_number().over(same))
    return island.groupBy("frame", "y", "v", "k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("k")


def polarity(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """frame, above, below, dark_text: which class has the border, and whether text is the darker one.

    Where neither class has three quarters of the border, the class with the shorter stretches inside rows is text.
    """
    sizes = pixels.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    cls = pixels.join(thresholds, "frame").withColumn("up", F.col("v") > F.col("threshold"))
    votes = border(cls, sizes).groupBy("frame").agg(F.count_if("up").alias("above"), F.count_if(~F.col("up")).alias("below"))
    inner = runs(cls.select("frame", "x", "y", F.col("up").cast("int").alias("v"))).join(sizes, "frame").where("x0 > 0 and x1 < width")
    n = lambda v, c: F.coalesce(F.sum(F.when(F.col("v") == v, c)), F.lit(0))
    strokes = inner.groupBy("frame").agg(n(0, F.lit(1)).alias("n0"), n(1, F.lit(1)).alias("n1"), n(0, F.col("x1") - F.col("x0")).alias("l0"), n(1, F.col("x1") - F.col("x0")).alias("l1"))
    unsure = F.greatest("above", "below") * 4 < (F.col("above") + F.col("below")) * 3
    thin = (F.col("n0") > 0) & (F.col("n1") > 0) & unsure
    dark = F.when(F.coalesce(thin, F.lit(False)), F.col("l0") * F.col("n1") < F.col("l1") * F.col("n0")).otherwise(F.col("above") >= F.col("below"))
    return votes.join(strokes, "frame", "left").select("frame", "above", "below", dark.alias("dark_text"))


def ink(pixels: DataFrame) -> DataFrame:
    """frame, x, y, ink, mask: how far each pixel is from the background's level to the text's, 0 to 255, and if half way.

    Levels are the medians of the two classes at Otsu's threshold; shadows aside.
    """
    hist = histogram(pixels)
    cut = otsu(hist)
    level = class_medians(hist, cut).join(polarity(pixels, cut), "frame")
    bg, fg = F.when(F.col("dark_text"), F.col("high")).otherwise(F.col("low")), F.when(F.col("dark_text"), F.col("low")).otherwise(F.col("high"))
    p = pixels.join(level.select("frame", bg.alias("bg"), fg.alias("fg"), "dark_text"), "frame")
    soft = F.expr("(case when dark_text then bg - v else v - bg end) * 255 div greatest(1, abs(bg - fg))")
    soft = F.least(F.lit(255), F.greatest(F.lit(0), soft)).cast("int")
    return p.select("frame", "x", "y", soft.alias("ink"), (soft >= 128).cast("int").alias("mask"))


def euler_number(mask: DataFrame) -> DataFrame:
    """frame, euler: components less holes of mask pixels (frame, x, y, v in 0, 1), corners joining: from 2 by 2 quads."""
    on = mask.where("v = 1")
    corner = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(1 << (2 * dy + dx)).alias("b")) for dy in (0, 1) for dx in (0, 1)])
    quads = on.select("frame", F.explode(corner).alias("c")).groupBy("frame", "c.x", "c.y").agg(F.sum("c.b").alias("bits"), F.count(F.lit(1)).alias("k"))
    diagonal = F.col("bits").isin(6, 9)
    n = quads.groupBy("frame").agg((F.count_if(F.col("k") == 1) - F.count_if(F.col("k") == 3) - 2 * F.count_if(diagonal)).alias("q"))
    return mask.select("frame").distinct().join(n, "frame", "left").select("frame", F.expr("cast(coalesce(q, 0) div 4 as int)").alias("euler"))


def labelled_runs(runs_: DataFrame, connectivity: int = 8) -> DataFrame:
    """runs (frame, y, x0, x1) with comp: components of runs that touch in neighbouring rows, numbered as they first appear.

    A frame's runs, not its pixels, are joined in one task; with 8 neighbours, corners touch, too.
    """
    slack = 1 if connectivity == 8 else 0

    def label(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "x0"], kind="stable").reset_index(drop=True)
        y, x0, x1 = g["y"].tolist(), g["x0"].tolist(), g["x1"].tolist()
        first: dict[int, int] = {}
        for i, row in enumerate(y):
            first.setdefault(row, i)
        pairs = []
        for i, row in enumerate(y):
            j = first.get(row - 1)
            if j is None:
                continue
            while j < i and y[j] == row - 1 and x1[j] + slack <= x0[i]:
                j += 1
            first_j = j
            while j < i and y[j] == row - 1 and x0[j] < x1[i] + slack:
                pairs.append((j, i))
                j += 1
            if i + 1 < len(y) and y[i + 1] == row:
                first[row - 1] = first_j
        root = rooted(list(range(len(y))), pairs)
        number: dict[int, int] = {}
        return g.assign(comp=[number.setdefault(root[i], len(number)) for i in range(len(y))])[["frame", "y", "x0", "x1", "comp"]]

    return runs_.select("frame", "y", "x0", "x1").groupBy("frame").applyInPandas(label, "frame long, y int, x0 int, x1 int, comp int")


def components(runs_: DataFrame) -> DataFrame:
    """frame, comp, x, y, w, h, area of labelled runs."""
    return runs_.groupBy("frame", "comp").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area")
    )


def border_share(labelled: DataFrame, band: int = 3) -> DataFrame:
    """frame, comp, on_border, area: a component's pixels within a band along its box; narrow boxes count some twice."""
    c = components(labelled)
    beside = F.greatest(F.lit(0), F.least(F.col("x1"), F.col("x") + band) - F.col("x0")) + F.greatest(F.lit(0), F.col("x1") - F.greatest(F.col("x0"), F.col("x") + F.col("w") - band))
    r = labelled.join(c.withColumnRenamed("y", "cy"), ["frame", "comp"])
    own = F.when((F.col("y") < F.col("cy") + band) | (F.col("y") >= F.col("cy") + F.col("h") - band), F.col("x1") - F.col("x0")).otherwise(beside)
    return r.groupBy("frame", "comp").agg(F.sum(own.cast("long")).alias("on_border"), F.max("area").alias("area"))


def hysteresis(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Labelled weak runs whose component meets a strong run (frame, y, x0, x1)."""
    s = strong.select("frame", "y", F.col("x0").alias("s0"), F.col("x1").alias("s1"))
    hit = weak.join(s, ["frame", "y"]).where("x0 < s1 and s0 < x1").select("frame", "comp").distinct()
    return weak.join(hit, ["frame", "comp"], "left_semi")


def cell_colours(pixels: DataFrame, cell: int) -> DataFrame:
    """frame, cx, cy, colours, n, variance: distinct values, pixels and population variance of square cells."""
    key = ["frame", F.expr(f"x div {cell}").alias("cx"), F.expr(f"y div {cell}").alias("cy")]
    s, q, n = F.sum("v"), F.sum(F.col("v") * F.col("v")), F.count(F.lit(1))
    return pixels.groupBy(*key).agg(F.countDistinct("v").alias("colours"), n.alias("n"), (n * q - s * s).alias("n2_variance"))


def inpainted(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Scanlines with a box filled by blending, row by row, from the pixel left of it to the one right of it.

    Where the box meets the frame's edge, its own outermost pixel stands in for the one beside it.
    """
    x, w = max(x, 0), w + min(x, 0)
    left, last = max(0, x - 1), F.size("v") - 1
    right = F.least(last, F.lit(x + w))
    a, b = F.try_element_at("v", F.lit(left + 1)), F.try_element_at("v", right + 1)
    span = F.greatest(F.lit(1), right - left)
    blend = lambda i: F.floor((a * (span - (i - left)) + b * (i - left)) / span).cast("int")
    fill = F.transform("v", lambda p, i: F.when((i >= x) & (i < x + w), blend(i)).otherwise(p))
    return rows.withColumn("v", F.when((F.col("y") >= y) & (F.col("y") < y + h), fill).otherwise(F.col("v")))
